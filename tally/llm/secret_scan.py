"""Secret scans: rules are regular expressions; a trigram index says which documents can match.

Each rule's Boolean trigram query is derived from its expression. The index holds a posting
(trigram, document) for each trigram of the rules, over lower-cased text; postings that
satisfy a rule's query make the document its candidate, and the expression is verified on
the whole text. Rules without mandatory trigrams scan every document. Expressions only:
matches are marked in the text, and the pieces between the marks give code-point offsets.

Defined cases: a null text is empty and has no spans; rows that share a doc_id are scanned
one by one, repeated rows as often as given; a null doc_id is carried
through; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .trigrams import Query, query


@dataclass(frozen=True)
class Rule:
    """A match counts if its group `group` has at least `least` characters.

    Where the matches that count have an expression of their own, it is `scan`: it spares
    the many that don't.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    fold_case: bool = False
    scan: str = ""

    def trigrams(self) -> Query:
        return query(self.pattern)

    def java(self) -> str:
        return ("(?i)" if self.fold_case else "") + (self.scan or self.pattern)


ASSIGN = Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8, fold_case=True)
# A run that is too short has no long enough part, so these two find the same spans.
ACCESS = Rule("access", r"AKIA[A-Z0-9]+", least=16, scan=r"AKIA[A-Z0-9]{12,}")
HEX = Rule("hex", r"[0-9a-f]+", least=32, scan=r"[0-9a-f]{32,}")
BASE = (ASSIGN, ACCESS, HEX)
#: Public formats of keys and tokens.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("live_key", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[a-z]+://[A-Za-z0-9._-]+:[^\x20\x09-\x0D@/:]{4,}@"),
)
RULES = BASE + MORE

# Private-use characters, in no rule; those in a text become the third, which keeps every offset.
_OPEN, _CLOSE, _OTHER = "\ue000", "\ue001", "\ue002"


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(trigram, did, key): the inverted index over the trigrams that the rules ask for."""
    wanted = sorted({t for r in rules for clause in r.trigrams() for a in clause for t in a})
    if not wanted:
        return docs.select(F.lit("").alias("trigram"), "did", "key").limit(0)
    low = docs.select("did", "key", F.lower("text").alias("low"))
    return low.select(F.explode(F.filter(F.array(*map(F.lit, wanted)), lambda t: F.contains(F.col("low"), t))).alias("trigram"), "did", "key")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(did, key, rules): the rules whose trigram queries a document satisfies, by position."""
    spark = index.sparkSession
    asked = [(i, c, a, t, len(alternative)) for i, r in enumerate(rules) for c, clause in enumerate(r.trigrams()) for a, alternative in enumerate(clause) for t in sorted(alternative)]
    table = spark.createDataFrame(asked, "rule int, clause int, alternative int, trigram string, need int")
    needed = spark.createDataFrame([(i, len(r.trigrams())) for i, r in enumerate(rules)], "rule int, clauses int")
    # Both tables are as large as the rules, not the data.
    met = index.join(F.broadcast(table), "trigram").groupBy("did", "key", "rule", "clause", "alternative").agg(F.count_distinct("trigram").alias("n"), F.max("need").alias("need")).filter("n = need")
    whole = met.groupBy("did", "key", "rule").agg(F.count_distinct("clause").alias("n")).join(F.broadcast(needed), "rule").filter("n = clauses")
    return whole.groupBy("did", "key").agg(F.collect_set("rule").alias("rules"))


def _pieces(text: Column, rule: Rule) -> Column:
    """The text cut before each match, with a mark after the match."""
    return F.split(F.regexp_replace(text, rule.java(), f"{_OPEN}$0{_CLOSE}"), _OPEN)


def spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, did, key, copy, spans): each row with its spans (start, order of the rule, end) in order."""
    plain = C.keyed(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    scan = [i for i, r in enumerate(rules) if not r.trigrams()]
    # The few candidates are the hashed side, so that texts are dealt out but never sorted. Repeated rows
    # are told apart by a number, which only has to differ between rows of one task: none is dealt out again.
    rows = plain.join(candidates(postings(C.keyed(docs), rules), rules).hint("shuffle_hash"), ["did", "key"], "left").withColumn("copy", F.monotonically_increasing_id())
    text = F.replace(F.replace(F.col("text"), F.lit(_OPEN), F.lit(_OTHER)), F.lit(_CLOSE), F.lit(_OTHER))
    due = [F.struct(F.lit(i).alias("rule"), F.when(F.lit(i in scan) | F.coalesce(F.array_contains("rules", i), F.lit(False)), _pieces(text, r)).alias("pieces")) for i, r in enumerate(rules)]
    cut = rows.select("doc_id", "did", "key", "copy", F.filter(F.array(*due), lambda x: F.size(x["pieces"]) > 1).alias("found"))
    per_rule = cut.select("doc_id", "did", "key", "copy", F.explode_outer("found").alias("f"))
    # Columns of their own, so that a piece's row doesn't have all pieces with it.
    per_rule = per_rule.select("doc_id", "did", "key", "copy", "f.rule", "f.pieces")
    per_piece = per_rule.select("doc_id", "did", "key", "copy", "rule", F.posexplode_outer("pieces").alias("at", "piece"))
    # The first piece has no match; of the others, what stands before the mark is one.
    match = F.when(F.col("at") > 0, F.substring_index("piece", _CLOSE, 1))
    group = F.lit(None).cast("string")
    for i, r in enumerate(rules):
        group = F.when(F.col("rule") == i, F.regexp_extract("match", r.java(), r.group) if r.group else F.col("match")).otherwise(group)
    least = F.element_at(F.array(*(F.lit(r.least) for r in rules)), F.col("rule") + 1)
    sized = per_piece.withColumn("match", match).select("doc_id", "did", "key", "copy", "rule", "at", F.length("match").alias("n"), (F.length("piece") - F.when(F.col("at") > 0, 1).otherwise(0)).alias("size"), (F.length(group) >= least).alias("counts"))
    before = Window.partitionBy("did", "key", "copy", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    span = F.when(F.col("counts") & (F.col("at") > 0), F.struct("start", "rule", (F.col("start") + F.col("n")).alias("end")))
    return placed.groupBy("did", "key", "copy").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(span)).alias("spans"))


def _joined(found: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["rule"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = MORE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs: the base rules and `rules`."""
    every = BASE + tuple(rules)
    found = spans(docs, every)
    count = lambda i: F.size(F.filter("spans", lambda s: s["rule"] == i)).cast("long")
    base = _joined(F.filter("spans", lambda s: s["rule"] < len(BASE)), every)
    return found.select("doc_id", *(count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)), F.sha2(base, 256).alias("base_sha256"), _joined(F.col("spans"), every).alias("spans"))


def oracle_sql(rules: tuple[Rule, ...] = MORE) -> str:
    """report() in DuckDB's SQL: pieces between the matches and the matches themselves give the offsets."""
    every = BASE + tuple(rules)
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    whole = lambda x: ("(?i)" if x.fold_case else "") + x.pattern
    found = "\n  UNION ALL ".join(f"SELECT r, {i} AS rule, {quoted(x.kind)} AS kind, {x.least} AS least, string_split_regex(text, {quoted(whole(x))}) AS pieces, regexp_extract_all(text, {quoted(whole(x))}) AS matches, regexp_extract_all(text, {quoted(whole(x))}, {x.group}) AS groups FROM d" for i, x in enumerate(every))
    joined = lambda where: f"coalesce(string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, rule) FILTER (WHERE {where}), '')"
    counts = ", ".join(f"count(*) FILTER (WHERE rule = {i})::BIGINT AS n_{x.kind}" for i, x in enumerate(BASE))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found}),
u AS (SELECT r, rule, kind, least, unnest(range(len(matches))) AS i, unnest(pieces[1:len(matches)]) AS piece, unnest(matches) AS match, unnest(groups) AS part FROM f WHERE len(matches) > 0),
p AS (SELECT r, rule, kind, length(match) AS n, length(part) >= least AS counts,
  (sum(length(piece) + length(match)) OVER (PARTITION BY r, rule ORDER BY i))::BIGINT - length(match) AS start FROM u),
s AS (SELECT r, {counts}, {joined(f"rule < {len(BASE)}")} AS base, {joined("true")} AS spans FROM p WHERE counts GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{x.kind}, 0) AS n_{x.kind}" for x in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (r)"""
