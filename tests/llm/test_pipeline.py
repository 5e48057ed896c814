import corpus_pipeline
from pyspark.sql import functions as F

from tessera.llm import pii, queries
from tessera.llm.common import written

from .test_dedup import brute

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, before, SF), "test")
        if name != "packing":
            assert docs.columns == columns
        kept.append((name, before, docs))
    found = {name: (before.collect(), after.collect()) for name, before, after in kept}
    before, after = found["quality classifier"]
    good = {r.doc_id for r in queries.op1_attention_quality(spark, SF).where("predicted = 1").collect()}
    assert {r.doc_id for r in after} == good and len(after) < len(before)
    before, after = found["exact dedup"]
    best = {}
    for r in before:
        best.setdefault("".join(r.text.split()), []).append((-len(r.text), r.doc_id))
    assert {r.doc_id for r in after} == {min(own)[1] for own in best.values()}
    before, after = found["n-gram Jaccard join"]
    assert {r.doc_id for r in after} == {i for i, (_, c) in brute([(r.doc_id, r.text) for r in before], 5, 80, 100).items() if i == c}
    before, after = found["PII"]
    texts = {r.doc_id: r.text for r in before}
    assert len(before) == len(after)
    assert all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in after)
    assert all(r.text == texts[r.doc_id] for r in after if not any(f"[{k.upper()}]" in r.text for k in pii.KINDS))
    assert any("[EMAIL]" in r.text for r in after)
    before, after = found["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before} and sum(r.length for r in after) == sum({r.doc_id: r.doc_tokens for r in after}.values())


def test_stages_take_nulls_and_no_rows(spark):
    rows = [(1, "a b c d e f", None, "s", 11), (1, "a b c d e f", None, "s", 11), (None, None, None, None, None), (2, "", "en", None, 0), (3, "w " * 30000, "en", "s", 60000)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for own in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, own, SF)
            assert name == "packing" or out.columns == docs.columns
            assert out.agg(F.count(F.lit(1))).first()[0] <= (100 if own is docs else 0)


def test_whole_run_leaves_only_results(spark):
    from pathlib import Path

    from tessera.llm import common

    first = common.marked()
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and {r.doc_id for r in rows.select("doc_id").distinct().collect()}
    left = [p for p in common.PATHS[first:] if Path(p).exists()]
    assert len(left) == len(corpus_pipeline.STAGES)
