"""Mixing sources to target weights: whole copies plus a Pareto order sample.

A source's target over its size gives the expected copies of its documents: the whole part
is taken for certain, the rest is an inclusion probability. Documents are ranked by random
odds over inclusion odds, and those of the lowest ranks are taken until the source's words
reach its target. Ranks are cut into cells by the random number, whose word sums find the
cell where the target falls; only documents of that cell are put in order one by one, so no
source is ever sorted as a whole. Expressions only: nothing leaves the JVM.

Random numbers come from a hash of doc_id and the seed, so reruns agree.

Defined cases: a null text has size 0 and is taken 0 words; a null source is one more
source, after all others; a null doc_id draws like an id of its own; rows with equal ids
draw equal numbers and are ordered by size; sources without words, and what is left of a
source at its cap, give no further copies; an empty table gives no rows; other columns are
passed on by ``apply``, but for one named n_copies, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
SEED = "mix"
CELLS = 4096


def word_count(text: str = "text"):
    return F.regexp_count(C.text_col(text), F.lit(C.WORD)).cast("long")


def targets(sizes: DataFrame, max_copies: int = MAX_COPIES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares of all words by weight, none above max_copies of its size.

    Filling by weight until a cap binds is solved in closed form: with sources in the order
    of cap over weight, the capped ones are a prefix. One row for each source is ordered.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("w", weight).withColumn("cap", (F.col("source_size") * max_copies).cast("double"))
    order = [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    leveled = ranked.withColumn("level", level).withColumn("free", F.col("cap") >= F.col("level") * F.col("w"))
    final = F.max(F.when(F.col("free"), F.col("level"))).over(everything)
    return leveled.withColumn("target", F.least("cap", final * F.col("w"))).select("source", "source_size", "target")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, did, key, source, size) of every row of docs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.id_col().alias("did"), C.text_key().alias("key"), F.col("source").cast("string").alias("source"), word_count().alias("size"))


def uniform(did, seed: str = SEED):
    """A number inside (0, 1) from 52 bits of a hash."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), did.cast("string"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def plan(docs: DataFrame, seed: str = SEED, max_copies: int = MAX_COPIES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, did, key, source, size, source_size, target, copies) of every row of docs."""
    rows = C.staged(sizes(docs), "sizes").withColumn("u", uniform(F.col("did"), seed)).withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    cells = rows.groupBy("source", "cell").agg(F.sum("size").cast("long").alias("words"))
    goal = targets(cells.groupBy("source").agg(F.sum("words").cast("long").alias("source_size")), max_copies, weights)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("sure", F.floor(expected)).withColumn("inclusion", expected - F.col("sure")).withColumn("want", F.col("target") - F.col("sure") * F.col("source_size"))
    so_far = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counted = cells.withColumn("before", F.coalesce(F.sum("words").over(so_far), F.lit(0)))
    steps = counted.alias("c").join(goal.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select(F.col("c.source").alias("p_source"), F.col("cell").alias("p_cell"), "before", (F.col("before") + F.col("words")).alias("after"), "source_size", "target", "sure", "inclusion", "want")
    joined = rows.join(steps, rows["source"].eqNullSafe(F.col("p_source")) & (rows["cell"] == F.col("p_cell")))
    # Within a source the inclusion odds are equal, so the order of the ranks is that of u and each cell is a range of ranks.
    rank = (F.col("u") / (1 - F.col("u"))) / (F.col("inclusion") / (1 - F.col("inclusion")))
    done = joined.filter("after <= want OR before >= want").withColumn("extra", F.expr("after <= want AND want > 0").cast("long"))
    cut = joined.filter("after > want AND before < want")
    in_cell = Window.partitionBy("source", "cell").orderBy(rank, "did", "size", "key").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("size").over(in_cell), F.lit(0))
    cut = cut.withColumn("extra", (ahead + F.col("size") / 2 <= F.col("want")).cast("long"))
    names = ["doc_id", "did", "key", "source", "size", "source_size", "target", "sure", "extra"]
    return done.select(*names).unionByName(cut.select(*names)).select(*names[:-2], (F.col("sure") + F.col("extra")).cast("long").alias("copies"))


def report(docs: DataFrame, seed: str = SEED, max_copies: int = MAX_COPIES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs."""
    got = plan(docs, seed, max_copies, weights)
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def apply(docs: DataFrame, seed: str = SEED, max_copies: int = MAX_COPIES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of docs that the mix takes, with n_copies; equal rows that draw differently share the copies of the luckiest."""
    got = plan(docs, seed, max_copies, weights).groupBy("did", "key").agg(F.max("copies").alias("n_copies")).filter("n_copies > 0")
    took = C.wrapped(docs, did=C.id_col(), key=C.text_key()).join(got, ["did", "key"])
    return took.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != "n_copies"), "n_copies")


def oracle_sql(seed: str = SEED) -> str:
    """report() in DuckDB's SQL, for the default weights and copies."""
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('{seed}:' || coalesce(doc_id, {C.NO_ID})::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, (source_size * 3)::DOUBLE AS cap FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM w)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM l WHERE cap >= level * w) * w) AS target FROM l),
e AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)::BIGINT AS sure FROM t),
r AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.sure, e.target - e.sure * e.source_size AS want,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY u, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, ((sure + CASE WHEN want > 0 AND ahead + size / 2 <= want THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r"""
