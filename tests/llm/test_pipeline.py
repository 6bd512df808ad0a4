"""The stages one after another against brute force on a small table."""

import corpus_pipeline
import numpy as np
from .test_exact import brute_components, by_sql

from hitfold.llm import mixing


def test_stages(spark, docs, tmp_path):
    seen, now = {}, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, "unused")
        out.write.parquet(f"{tmp_path}/{i}")
        seen[name] = now = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert now.columns == docs.columns
    known, cut, fresh, mix, packed = seen.values()
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in known.collect()} == {r.doc_id for r in docs.collect() if not any(c.isalpha() for c in r.text or "")}
    import hashlib

    assert {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in cut.collect()} == {k: v[2] for k, v in by_sql(known, spark).items()}
    groups = brute_components({r.doc_id: r.text for r in cut.collect()}, 5)
    assert {r.doc_id for r in fresh.collect()} == {i for i, (_, _, kept) in groups.items() if kept}
    expected = {r.doc_id: r.copies for r in mixing.mix(fresh).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()} == expected
    got = packed.toPandas().sort_values(["sequence_id", "offset"])
    end = got.offset + got.length
    assert (got.offset == end.groupby(got.sequence_id).shift(1).fillna(0)).all() and end.max() <= 4096
    assert len(got[got.piece == 0]) == mix.count() and np.isfinite(got.length).all()


def test_odd_rows_pass(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, "unused").count() >= 0, name
        assert stage(spark, empty, "unused").count() == 0, name
