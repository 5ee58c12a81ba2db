"""What the pipeline's stages keep, on small tables."""

import hashlib
import importlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_toxicity_rejects_what_operator_6_predicts(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(n, "x" * n, "en", "a", n) for n in (29, 30, 45, 50, 60)], DOCS)
    (tmp_path / "lengthmodel.py").write_text("import numpy as np\n\n\ndef score(data, offsets):\n    return np.diff(offsets) / 100\n")
    spark.sparkContext.addPyFile(f"{tmp_path}/lengthmodel.py")
    model = importlib.import_module("lengthmodel").score
    monkeypatch.setattr(corpus_pipeline.toxicity, "fit", lambda *_: model)
    assert [r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()] == [29]


def long_text(start: int) -> str:
    return " ".join(f"word{i}" for i in range(start, start + 60))


@pytest.mark.parametrize("repeat", [False, True])
def test_near_duplicates_without_or_with_repeated_ids(spark, repeat):
    a, b, c, d, e = (long_text(k * 1000) for k in range(5))
    rows = [(1, a), (2, a + " more"), (3, b), (None, c), (None, d), (None, d), (None, b + " more"), (None, None)]
    want = [(1, a), (3, b), (None, c), (None, d), (None, None)]
    if repeat:
        rows += [(7, e), (7, e), (7, a + " again"), (8, ""), (9, "")]
        want += [(7, e), (8, ""), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCS)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=order) == sorted(want, key=order)


def test_passages_are_cut(spark):
    from test_passages import brute, made

    rows = made(4)
    docs = spark.createDataFrame([(i, t, "en", "a", None if t is None else len(t)) for i, t in rows], DOCS)
    got = corpus_pipeline.cut_passages(spark, docs, "")
    assert got.columns == docs.columns
    hashes = {(r["doc_id"], hashlib.sha256(" ".join(re.split("[ \\t-\\r]+", r["text"] or "")).strip().encode()).hexdigest()) for r in got.collect()}
    want = {(i, h) for i, n, gone, h in brute(rows) if not 0 < gone == n}
    assert hashes == want
    by = {i: t for i, t in rows if i == 504 or i == 505}
    assert {r["doc_id"]: r["text"] for r in got.where("doc_id in (504, 505)").collect()} == by
    changed = got.where("n_chars <> length(text)").count()
    assert changed == 0


def test_secrets_are_redacted(spark):
    from test_secrets import brute, made

    rows = [*enumerate(made(200, 9)), (None, "password = hunter2hunter2"), (3, "token: abcdefghijkl"), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", None) for i, t in rows], DOCS).withColumn("found", F.lit(1))
    got = corpus_pipeline.redact_secrets(spark, docs, "")
    assert got.columns == docs.columns and got.count() == len(rows)
    text = {(r["doc_id"], r["text"]) for r in got.collect()}
    assert (None, "[SECRET]") in text and (3, "[SECRET]") in text and (3, None) in text and (0, None) in text
    clean = [(i, t) for i, t in rows if t and not brute(t)[5]]
    assert clean and text >= set(clean)


def test_packing_holds_every_row(spark):
    rows = [(1, "a b c", "en", "a", 5), (1, "a b c", "en", "a", 5), (None, None, None, None, None), (2, "", "en", "a", 0), (3, "word " * 3000, "en", "a", 1)]
    got = corpus_pipeline.pack_sequences(spark, spark.createDataFrame(rows, DOCS), "").collect()
    whole = sorted((str(r["doc_id"]), r["piece"]) for r in got)
    assert whole == sorted([("1", 0), ("1", 0), ("None", 0), ("2", 0), ("3", 0), ("3", 1)])
