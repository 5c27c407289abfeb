"""Each stage of the pipeline on what the one before it kept, against brute force."""

import math
from collections import Counter

import brute
import corpus_pipeline
import pytest

from tally.llm import common as C
from tally.llm import quality_rules


def walked(forest, x):
    """A tree at a time, a node at a time."""
    total = forest.base
    for node in forest.roots:
        while forest.feature[node] >= 0:
            node = forest.left[node] + (x[forest.feature[node]] > forest.threshold[node])
        total += forest.value[node]
    return total


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def stages(spark, request):
    """(input rows, output rows) by stage, as dicts."""
    sf = f"/root/testdata/{request.param}"
    docs = C.documents(spark, sf)
    out, before = {}, [r.asDict() for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = C.staged(stage(spark, docs, sf), "test")
        after = [r.asDict() for r in docs.collect()]
        out[name] = before, after
        before = after
    return sf, out


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_stages_keep_the_columns(stages):
    for name, (before, after) in list(stages[1].items())[:-1]:
        assert after and list(after[0]) == list(before[0]), name
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages[1])


def test_quality(spark, stages):
    sf, out = stages
    before, after = out["quality rules"]
    forest = quality_rules.train(C.documents(spark, sf), C.table(spark, sf, "labels"))
    kept = []
    for r in before:
        stats, x = quality_rules.statistics((r["text"] or "").encode())
        assert stats == brute.stats(r["text"])
        n, repeated = stats[0], stats[4]
        if n >= 50 and 100 * repeated <= 50 * n and walked(forest, x) >= math.log(quality_rules.THRESHOLD / (1 - quality_rules.THRESHOLD)):
            kept.append(r)
    assert ids(after) == ids(kept) and len(after) < len(before)


def test_clean_documents_stay(spark, stages):
    sf, out = stages
    good = {r.doc_id for r in C.table(spark, sf, "labels").filter("quality = 1").collect()}
    before, after = out["quality rules"]
    eligible = {r["doc_id"] for r in before if r["doc_id"] in good and brute.stats(r["text"])[0] >= 50}
    assert len(eligible - {r["doc_id"] for r in after}) <= 0.01 * len(eligible)


def test_lines(stages):
    before, after = stages[1]["line dedup"]
    want = {d: x for d, *x in brute.line_dedup([(r["doc_id"], r["text"]) for r in before])}
    assert ids(before) == ids(after)
    assert all(brute.sha(r["text"]) == want[r["doc_id"]][2] and r["n_chars"] == len(r["text"]) for r in after)


def test_near_duplicates(stages):
    before, after = stages[1]["near dedup"]
    rows = sorted(before, key=lambda r: r["doc_id"])
    roots = brute.groups([r["text"] for r in rows])
    assert ids(after) == [r["doc_id"] for i, r in enumerate(rows) if roots[i] == i]


def test_benchmark(spark, stages):
    sf, out = stages
    before, after = out["decontamination"]
    items = [(r.item_id, r.text) for r in C.table(spark, sf, "benchmark").collect()]
    gone = {d for d, *_ in brute.contained([(r["doc_id"], r["text"]) for r in before], items)}
    assert gone and ids(after) == sorted(set(ids(before)) - gone)


def test_mix(stages):
    before, after = stages[1]["mixing"]
    want = brute.mix([(r["doc_id"], r["text"], r["source"]) for r in before])
    assert sorted((r["doc_id"], r["n_copies"]) for r in after) == sorted((d, c) for d, *_, c in want if c)


def test_run_and_edge_rows(spark, stages, tmp_path):
    """run() gives the last stage's rows; nulls, empty tables and clashing columns pass through every stage."""
    sf, out = stages
    last = Counter((r["doc_id"], r["n_copies"]) for r in out["mixing"][1])
    assert Counter((r.doc_id, r.n_copies) for r in corpus_pipeline.run(spark, sf).collect()) == last
    odd = C.documents(spark, sf).limit(60).selectExpr("*", "'x' AS did", "1 AS key", "'y' AS keep", "2 AS n_copies", "3 AS row", "4 AS u", "5 AS size", "6 AS `a.b`", "7 AS _nd_did", "8 AS _mx_copies")
    nulls = odd.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "CAST(NULL AS BIGINT) AS n_chars", "did", "key", "keep", "n_copies", "row", "u", "size", "`a.b`", "_nd_did", "_mx_copies").limit(2)
    for docs in (odd.unionByName(nulls).unionByName(odd.limit(5)), odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = C.staged(stage(spark, docs, sf), "odd")
            assert set(odd.columns) <= set(docs.columns)
            assert not docs.filter("did <> 'x' OR key <> 1 OR keep <> 'y' OR row <> 3 OR u <> 4 OR size <> 5 OR `a.b` <> 6 OR _nd_did <> 7 OR _mx_copies <> 8").count()
