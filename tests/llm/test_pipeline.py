"""The pipeline, stage by stage, against plain versions on the smallest tables."""

import os
import shutil

import numpy as np
import pytest

import corpus_pipeline
from rangekeep.llm import quality, secrets, spiece

from .test_set_operators import brute_classes, brute_decontamination, brute_links

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not (os.path.isdir(DATA) and os.path.exists(spiece.MODEL)), reason="no test tables or model")


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(docs, labels)
    every = docs.collect()
    good = quality.probabilities(model, np.array([quality.statistics(r.text or "") for r in every])) >= quality.THRESHOLD
    rows = {r.doc_id: r.text for r, g in zip(every, good) if g}
    pairs = sorted(rows.items())
    classes = brute_classes(pairs, brute_links(pairs))
    kept = [(i, t) for i, t in pairs if classes[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = [(x[0], rows[x[0]]) for x in brute_decontamination(kept, items) if not x[5]]
    with open(spiece.MODEL, "rb") as f:
        codec = spiece.Codec(f.read())
    want = sorted((i, codec.slow.encode(secrets._redact(t)[0])) for i, t in kept)
    got = sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, DATA).collect())
    assert 0 < len(got) < docs.count() and got == want


def test_stages_on_awkward_documents(spark, tmp_path):
    from .helpers import clashing, empty

    for name in ("labels", "benchmark"):
        shutil.copy(f"{DATA}/{name}.parquet", tmp_path / f"{name}.parquet")
    for docs in (clashing(spark), empty(spark)):
        for k, (_, step) in enumerate(corpus_pipeline.STAGES):
            out = step(spark, docs, str(tmp_path))
            if k + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == docs.columns and out.schema == docs.schema
            assert out.count() <= docs.count()


def test_secrets_are_gone(spark):
    docs = spark.createDataFrame([(1, 'a token = "deadbeefdeadbeefdeadbeefdead" b', 41), (2, None, None)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in corpus_pipeline.without_secrets(spark, docs, "").collect()}
    assert out[1].text == 'a <assign>" b' and out[1].n_chars == len(out[1].text) and out[2].text is None and out[2].n_chars is None
    assert not secrets.base_spans(out[1].text)


def test_tables_of_a_stage_go_when_it_is_done(spark):
    from rangekeep.functions import storage
    from rangekeep.llm.common import passing, stage

    at = lambda df: df.inputFiles()[0].rsplit("/", 1)[0]
    there = lambda path: bool(storage.list_names(spark, path))
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(setting)
    with passing(spark):
        with passing(spark):
            inner, kept = stage(spark, spark.range(3), "x"), stage(spark, spark.range(4), "y", keep=True)
            paths = [at(inner), at(kept)]
        assert not there(paths[0]) and there(paths[1]) and kept.count() == 4
    assert not there(paths[1]) and spark.conf.get(setting) == own
