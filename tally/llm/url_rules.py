"""URL filters: host and path rules first, then association rules over URL tokens.

FP-growth mines token combinations from labelled URLs, whose label is one more item. Rules
that conclude a label are pruned by support and confidence, those that depart from the
default verdict by lift as well, and a rule that is no surer than one with a token less
goes. The rest match by an inverted index that has each rule under its rarest token: the
rules found there fire if a URL has all of their tokens. Of those that fire the surest
decides, of equally sure ones one that blocks. Expressions and the built-in FP-growth only.

Defined cases: a null url, or one without ://, has empty host and path, no rule and no
tokens, and gets the default verdict; a null page_id is carried through; repeated rows are
judged alike; without labels no rule is mined; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

# Rule, verdict.
SITE_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Share of the labelled URLs, and number of them, that a rule rests on at least.
MIN_SUPPORT = 0.0005
MIN_ROWS = 20
MIN_CONFIDENCE = 0.5
#: How much likelier than among all labelled URLs its verdict has to be, if it isn't the default.
MIN_LIFT = 1.5
DEFAULT = "allow"
_LABEL = "label="


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.expr("substring(url, instr(url, '://') + 3)"), r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(_lower(host), F.lit("")), F.coalesce(F.when(rest.isNotNull(), path), F.lit(""))


def site_rule(host: Column, path: Column, rules=SITE_RULES) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: scheme, host labels and their parts at -, suffixes, path words with 0 for each run of digits, query keys."""
    scheme = F.concat(F.lit("scheme:"), F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    labels = F.transform(F.array_union(F.split(host, r"\."), F.split(host, r"[.-]")), lambda x: F.concat(F.lit("host:"), x))
    suffix = F.concat(F.lit("site:"), F.substring_index(host, ".", -3))
    words = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "0")))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), 1), lambda x: F.concat(F.lit("query:"), x))
    mark = F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(F.array(scheme, suffix), labels, words, keys, mark))).otherwise(F.array().cast("array<string>"))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, tokens."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    return plain.withColumns({"host": host, "path": path}).withColumn("tokens", tokens(F.col("host"), F.col("path"), F.col("url")))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_rows: int = MIN_ROWS, default: str = DEFAULT) -> DataFrame:
    """(rule, verdict, tokens, confidence, support) from labelled (tokens, verdict)."""
    baskets = labelled.filter(F.col("verdict").isNotNull()).select(F.array_append("tokens", F.concat(F.lit(_LABEL), "verdict")).alias("items"))
    support = min(1.0, max(min_support, min_rows / max(1, baskets.count())))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(F.startswith(F.col("consequent")[0], F.lit(_LABEL)) & ((F.col("lift") >= min_lift) | (F.col("consequent")[0] == _LABEL + default)))
    rules = C.staged(rules.select(F.sort_array("antecedent").alias("tokens"), F.expr(f"substring(consequent[0], {len(_LABEL) + 1})").alias("verdict"), "confidence", "support"), "mined")
    # Each rule meets those with one token less by their whole token lists.
    shorter = F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x)))
    fewer = rules.select("verdict", shorter.alias("less"), "tokens", "confidence")
    known = rules.select("verdict", F.col("tokens").alias("less"), F.col("confidence").alias("c"))
    beaten = fewer.join(known, ["verdict", "less"]).filter("confidence <= c").select("tokens", "verdict").distinct()
    kept = rules.join(beaten, ["tokens", "verdict"], "left_anti")
    return kept.select(F.xxhash64("tokens", "verdict").alias("rule"), "verdict", "tokens", "confidence", "support")


def fired(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, method): the verdict of the surest rule that fires on a url, for urls on which one does."""
    urls = pages.select("url", "tokens").distinct()
    postings = urls.select("url", "tokens", F.explode("tokens").alias("token"))
    # Rules are few beside pages. Under its rarest token a rule meets the fewest of them.
    terms = rules.select("rule", F.explode("tokens").alias("token"))
    counts = postings.join(terms.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarest = terms.join(counts, "token").groupBy("rule").agg(F.min(F.struct("count", "token")).alias("t")).select("rule", F.col("t.token").alias("token"))
    index = rules.join(rarest, "rule").select("token", F.col("tokens").alias("needed"), "verdict", "confidence")
    hits = postings.join(index, "token").filter(F.size(F.array_except("needed", "tokens")) == 0)
    return hits.groupBy("url").agg(F.max(F.struct("confidence", "verdict")).alias("best")).select("url", F.col("best.verdict").alias("method"))


def verdicts(pages: DataFrame, rules: DataFrame, site_rules=SITE_RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (parsed)."""
    judged = pages.withColumn("site", site_rule(F.col("host"), F.col("path"), site_rules))
    decided = F.lit(None).cast("string")
    for rule, verdict in site_rules:
        decided = F.when(F.col("site") == rule, F.lit(verdict)).otherwise(decided)
    found = fired(judged.filter(F.col("site").isNull()), rules)
    rows = judged.join(found, "url", "left")
    return rows.select("page_id", "host", "path", F.col("site").alias("rule"), F.coalesce(decided, F.col("method"), F.lit(default)).alias("verdict"))


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, verdict) of the pages whose url ends in the number of a labelled document: block if it is poor or toxic."""
    number = F.regexp_extract("path", r"/([0-9]{1,18})(?:[^0-9/][^/]*)?/?$", 1)
    doc = F.when(number != "", number.cast("long"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "block").otherwise("allow")
    known = labels.filter(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull())).select(F.col("doc_id").cast("long").alias("doc"), bad.alias("verdict"))
    return pages.withColumn("doc", doc).join(known, "doc").select("tokens", "verdict")


def report(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """verdicts() of pages, with rules mined from labels."""
    rows = parsed(pages)
    rules = C.staged(mine(page_labels(rows, labels)), "url-rules")
    return verdicts(rows, rules)
