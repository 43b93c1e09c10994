"""The pipeline and its registration."""

import corpus_pipeline
import parity  # noqa: F401
from pyspark.sql import functions as F
from test_llm_minhash import expected

from tabloom.llm import minhash, mixing, quality, secrets
from tabloom.llm.base import stored


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    names = docs.columns
    seen = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stored(stage(spark, docs, tiny), "stage")
        seen[name] = (before.collect(), docs.collect())
        assert number == 4 or docs.columns == names
    before, after = seen["quality rules"]
    want = {r.doc_id for r in quality.assess(spark.read.parquet(f"{tiny}/documents.parquet")).where("kept").collect()}
    assert {r.doc_id for r in after} == want and len(after) == len(want) < len(before)
    before, after = seen["near-duplicate removal"]
    groups = expected([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted({c for _, c in groups.values()})
    before, after = seen["secret scans"]
    texts = {r.doc_id: r.text for r in after}
    assert len(after) == len(before) and all(texts[r.doc_id] == secrets.redact(r.text) for r in before)
    assert not any(secrets.base_spans(t) for t in texts.values())
    before, after = seen["source mixing"]
    old = {r.doc_id: r.text for r in before}
    assert 0 < len(after) < len(before) and all(old[r.doc_id] == r.text for r in after)
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert words(after) <= mixing.SHARE * words(before) * 1.01
    before, after = seen["best-fit packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}


def test_run(spark, tiny):
    out = corpus_pipeline.run(spark, tiny)
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_second_deduplication_changes_nothing(spark, tiny):
    once = stored(minhash.deduplicated(spark.read.parquet(f"{tiny}/documents.parquet")), "once")
    twice = minhash.deduplicated(once)
    assert twice.count() == once.count() and twice.select(F.sum("doc_id")).first() == once.select(F.sum("doc_id")).first()
