"""The pipeline's stages, each judged on its own input."""

from itertools import groupby

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from breathline.llm import common, decontam, langid, neardup, secret_scan


def test_stages(spark, sf, documents, odd, empty):
    columns = documents.columns
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf).cache()
        if name == "packing":
            texts = {r.doc_id: r.text for r in before.collect()}
            rows = sorted(docs.collect(), key=lambda r: (r.doc_id, r.piece))
            assert {r.doc_id for r in rows} == set(texts) and len(texts) == before.count()
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            for doc_id, own in groupby(rows, key=lambda r: r.doc_id):
                ids = np.concatenate([np.frombuffer(r.ids, f"<u{len(r.ids) // r.length}") for r in own]).tolist()
                assert ids == library.encode(texts[doc_id] or "", add_special_tokens=False).ids + [1]
            break
        assert docs.columns == columns
        if name == "language_id":
            good = langid.classify(before).where("not rejected").count()
            assert docs.count() == good >= 0.99 * before.where("text rlike '[A-Za-z]'").count()
        if name == "near_dedup":
            assert docs.count() == neardup.near_duplicates(before).where("kept").count()
        if name == "decontamination":
            bench = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert decontam.match(docs, bench).where("n_hit > 0").count() == 0
            assert docs.count() == decontam.match(before, bench).where("not contaminated").count()
        if name == "secret_scan":
            assert docs.count() == before.count()
            assert secret_scan.scan(docs).where("n_assign + n_access + n_hex > 0").count() == 0
            assert docs.where(F.col("n_chars") != F.length("text")).count() == before.where(F.col("n_chars") != F.length("text")).count()


def test_odd_tables(spark, sf, odd, empty):
    for table in (odd, empty):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        docs.count()


def test_run_leaves_its_result_alone(spark, sf, tmp_path, monkeypatch):
    """The tables that stages wrote on their way are gone."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [p.name.split("-")[0] for p in (tmp_path / "breathline").iterdir()] == ["packing"]
