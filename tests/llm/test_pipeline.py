"""The pipeline's stages, each against a plain version of its decision on its own input."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_near_duplicates import plain_classes
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from cellscape.llm import mixing, quality, toxicity
from cellscape.session import cut_lineage

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = (docs, cut_lineage(stage(spark, docs, SF)))
        docs = out[name][1]
        if name != "encode":
            assert docs.columns == columns

    before, after = out["toxicity"]
    field = toxicity.fit_toxicity(before, labels, where=~toxicity.held_out(F.col("doc_id")))
    want = {r.doc_id for r in toxicity.score_toxicity(before, field).where("predicted = 0").collect()}
    assert {r.doc_id for r in after.select("doc_id").collect()} == want and 0 < len(want) < before.count()

    before, after = out["quality"]
    want = {r.doc_id for r in quality.score_quality(before, labels).where("kept").collect()}
    assert {r.doc_id for r in after.select("doc_id").collect()} == want

    before, after = out["near_copies"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = plain_classes(rows)
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, t in rows if want[t] == i)

    before, after = out["mix"]
    want = Counter({r.doc_id: r.copies for r in mixing.mix_sources(before).collect()})
    assert Counter(r.doc_id for r in after.select("doc_id").collect()) == +want

    before, after = out["encode"]
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert len(rows) == before.count()
    for r in rows:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = cut_lineage(stage(spark, docs, SF))
            assert name == "encode" or docs.columns == names
        docs.count()


def test_run_is_registered(spark):
    assert {"pipeline", *(f"op{i}" for i in range(1, 11))} <= {k.split("_")[0] for k in __spark_entry__.queries()}
    got = __spark_entry__.queries()["pipeline"](spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and "ids" in got.columns
