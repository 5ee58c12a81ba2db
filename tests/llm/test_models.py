"""Language id against sums over all segmentations, and what the trained operators reach on held-out rows."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import cotrain, langid
from tidemark.llm.boosting import Isotonic
from tidemark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    words = [(x, "".join(rng.choice(list(letters), rng.integers(1, 7))), int(rng.integers(1, 5))) for x, letters in (("a", "abc"), ("b", "abd")) for _ in range(80)]
    return langid.train(words, ["ab", "abc", "▁a", "▁ab", "ca", "bd", "dd", "▁"])


def all_segmentations(model, word, j):
    s, total = langid.START + word, 0.0
    for cuts in itertools.product([False, True], repeat=len(s) - 1):
        bounds = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(s)]
        p = 1.0
        for a, b in itertools.pairwise(bounds):
            piece = s[a:b]
            p *= np.exp(model.log_p[model.pieces.index(piece), j]) if piece in model.pieces else langid.FLOOR if len(piece) == 1 else 0
        total += p
    return np.log(total)


def test_forward_sums_all_segmentations(model):
    words = ["abcab", "d", "bdda", "xyz", "abcabcab", "zab"]
    got = model.score([langid.START + w for w in words])
    want = [[all_segmentations(model, w, j) for j in (0, 1)] for w in words]
    assert np.allclose(got, want, rtol=1e-9)


def test_long_words_keep_their_probability(model):
    # in a word of n letters without pieces, every letter adds the floor
    for n in (40, 400, 5000):
        assert np.allclose(model.score([langid.START + "x" * n])[0] - model.score([langid.START])[0], n * np.log(langid.FLOOR))
    mixed = model.score([langid.START + "abc" * 7, langid.START + "ab" * 500])
    assert np.isfinite(mixed).all() and np.allclose(mixed[1], model.score([langid.START + "ab" * 500])[0], rtol=0, atol=0)


def test_unsegmented_languages_and_many_of_them():
    words = [("de", "der", 9000), ("en", "the", 9000), ("zh", "字" * 34, 9000), ("zh", "語" * 3000, 1)] + [(f"l{i:03}", chr(0x4E00 + i) * 3, 9000) for i in range(300)]
    m = langid.train(words, ["the", "▁the", "der"])
    best, score = langid.predict(m, ["the dog the", None, "", "12 !", "字字字", "der", chr(0x4E00 + 7) * 2, chr(0x4E00 + 299)])
    assert best == ["en", "und", "und", "und", "zh", "de", "l007", "l299"]
    assert np.isfinite(m.log_p).all() and ((score >= 0) & (score <= 1)).all()


def test_what_is_remembered_changes_no_score(model):
    texts = ["abc ab d", "bdd abc, ab", "xyz", "ab " * 1000, "a" * 200 + " abc"]
    fresh = [langid.predict(model, [t]) for t in texts]
    memo, table = {}, np.zeros((3, 3))
    again = [langid.predict(model, [t], memo, table) for t in texts * 2]
    assert [(b[0], s[0]) for b, s in again] == [(b[0], s[0]) for b, s in fresh * 2]


def test_segments_of_a_long_text(monkeypatch, model):
    text = " ".join(["abc", "bdd", "abd,ab"] * 50)
    want = langid.predict(model, [text])
    monkeypatch.setattr(langid, "SEGMENT", 40)
    assert langid.predict(model, [text])[0] == want[0] and np.allclose(langid.predict(model, [text])[1], want[1])


def test_samples_hold_every_language(spark):
    rows = [(i, f"wort{i} der die das", "de") for i in range(300)] + [(1000, "rare words here", "xx"), (1001, None, "yy"), (1002, "nothing", None)]
    words = langid.sample_words(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=20, language_words=3)
    by = {x: [w for w in words if w[0] == x] for x in ("de", "xx")}
    assert len(by["de"]) == 3 and {w[1] for w in by["xx"]} == {"rare", "words", "here"} and {w[0] for w in words} == {"de", "xx"}


def held_out(spark, name, column):
    got = QUERIES[name](spark, DATA).where("held_out").join(spark.read.parquet(f"{DATA}/{'documents' if column == 'lang' else 'labels'}.parquet").select("doc_id", F.col(column).alias("truth")).where("truth is not null"), "doc_id")
    return got.toPandas()


@needs_data
def test_language_of_held_out_rows(spark):
    got = held_out(spark, "op1_language", "lang")
    assert len(got) > 200 and (got["lang_pred"] == got["truth"]).mean() > 0.98 and got["score"].between(0, 1).all()


@needs_data
def test_quality_of_held_out_rows(spark):
    got = held_out(spark, "op5_quality", "quality")
    base = max(got["truth"].mean(), 1 - got["truth"].mean())
    assert len(got) > 50 and (got["predicted"] == got["truth"]).mean() >= max(base, 0.93) and got["score"].between(0, 1).all()


@needs_data
def test_toxicity_of_held_out_rows(spark):
    got = held_out(spark, "op6_toxicity", "toxic")
    hit, flagged, toxic = ((got["predicted"] == 1) & (got["truth"] == 1)).sum(), (got["predicted"] == 1).sum(), (got["truth"] == 1).sum()
    assert len(got) > 50 and hit / max(flagged, 1) >= 0.8 and hit / max(toxic, 1) >= 0.6 and got["score"].between(0, 1).all()


def test_views_label_for_each_other(spark, monkeypatch):
    """Every round each view gives labels to all unlabelled rows that it is sure of."""
    rng = np.random.default_rng(1)
    good, bad = "the careful report explains each result in clear and complete sentences for readers", "BUY NOW!!! $$$ CLICK $$$ FREE!!! &&& ###"
    rows, labels = [], []
    for i in range(600):
        y = int(rng.random() < 0.5)
        rows.append((i, f"{good if y else bad} {rng.integers(1000)}", "press" if y else "spam", "en", 100))
        if i < 60:
            labels.append((i, y))
    seen = []
    monkeypatch.setattr(cotrain, "_given", lambda *a, f=cotrain._given: seen.append(f(*a)) or seen[-1])
    table = cotrain.features(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long"))
    model = cotrain.fit(table, spark.createDataFrame(labels, "doc_id long, quality int"))
    score = {r["doc_id"]: r["score"] for r in cotrain.score(table, model).collect()}
    assert len(seen) == 2 * cotrain.ROUNDS and all(len(g) > 200 for g in seen[-2:]), [len(g) for g in seen]
    truth = {r[0]: r[2] == "press" for r in rows}
    assert np.mean([(score[i] >= 0.5) == truth[i] for i in score]) > 0.99


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=400)
    fitted = Isotonic().fit(raw, (rng.random(400) < 1 / (1 + np.exp(-raw))).astype(float))
    out = fitted(np.sort(raw))
    assert (np.diff(out) >= -1e-12).all() and out.min() >= 0 and out.max() <= 1
