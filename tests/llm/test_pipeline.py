"""The pipeline's rows against the plain versions of its stages."""

import corpus_pipeline
from pyspark.sql import functions as F

from kickframe.llm import packing
from tests.llm import plain
from tests.llm.conftest import SF


def test_run(spark, documents):
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    good = [(i, t) for i, t in documents if not plain.quality_row(i, t)[-1] and not plain.other_rules(t)]
    first = {r[0] for r in plain.near_duplicate_rows(good, 5) if r[3]}
    clean = [(i, t) for i, t in good if i in first and not plain.decontaminated_row(i, t, bench)[-1]]
    want = set()
    for i, t in clean:
        ids = plain.ids_of(plain.redacted(t), "byte_bpe_50k.json", 0)
        want |= {(i, a, n, plain.crc(ids[a : a + n]), len(ids)) for a, n in packing.cuts(len(ids))}
    got = corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", F.crc32("ids"), "doc_tokens").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema == docs.schema
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_odd_rows_through_all_stages(spark, odd):
    """Nulls, empty and very long texts, repeated rows and columns with clashing names: every stage keeps the columns and its rule."""
    docs, kept = odd, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.schema == odd.schema, name
        kept.append(sorted((r.doc_id for r in docs.select("doc_id").collect()), key=repr))
    good = [r for r in odd.collect() if not plain.quality_row(r.doc_id, r.text)[-1] and not plain.other_rules(r.text)]
    assert kept[0] == sorted((r.doc_id for r in good), key=repr)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(kept[-1])
