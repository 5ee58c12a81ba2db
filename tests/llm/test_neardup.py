"""Near-duplicate classes against all pairs of exact weighted Jaccard similarities, and BagMinHash against its expectation."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import neardup


def bag(text):
    ws = [w for w in (text or "").replace("\n", " ").split(" ") if w]
    return ws, Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else Counter([tuple(ws)] if ws else [])


def brute(rows, similarity=0.8):
    bags = [(i, *bag(t)) for i, t in rows]
    top = {i: i for i, _ in rows}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for n, (i, w, a) in enumerate(bags):
        for j, v, b in bags[:n]:
            both, every = sum((a & b).values()), sum((a | b).values())
            if a and b and (w == v or both >= similarity * every):
                x, y = sorted((root(i), root(j)))
                top[y] = x
    return {i: root(i) for i, _ in rows}


def made(seed):
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, base = [], []
    for _ in range(6):
        base.append(text(rng.randrange(20, 120)))
    for i in range(150):
        ws = list(rng.choice(base)) if rng.random() < 0.8 else text(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 6)):
            if ws:
                ws[rng.randrange(len(ws))] = f"w{rng.randrange(3000)}"
        if rng.random() < 0.2:
            ws = ws + text(rng.randrange(0, 30))
        if rng.random() < 0.1:
            ws = ws[: rng.randrange(0, 6)]
        rows.append((i * 2 + 1, rng.choice([" ", "\n"]).join(ws)))
    # a template with parts of its own: one bucket holds many that are alike but not linked
    frame = text(60)
    rows += [(1000 + i, " ".join(frame + text(30) + (["again", "and", "again"] * rng.randrange(0, 4)))) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, " \n "), (2003, "one two"), (2004, "one two"), (2005, "one"), (2006, "a " * 40), (2007, "a " * 41), (2008, "a " * 90)]
    return rows


@pytest.mark.parametrize("seed, block", [(1, 512), (2, 5)])
def test_against_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = made(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("band", F.lit(1)).withColumn("class_id", F.lit("x")).repartition(6)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_repeats_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, a), (5, b), (3, b), (None, a), (None, None), (9, a + " more")]
    got = sorted((tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "n_words").collect()), key=str)
    by = {r[0]: r[1] for r in got if r[0] is not None}
    assert by == {5: 3, 3: 3, 9: 3}
    assert [r for r in got if r[0] is None] == [(None, None, 0), (None, None, 40)]


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    a, b = rng.integers(0, 30, 40), rng.integers(0, 30, 40)
    docs = np.repeat([0, 1], 40)
    weight = np.concatenate([a, b])
    some = weight > 0
    sig = neardup.bag_minhash(docs[some], np.concatenate([hashes, hashes])[some], weight[some], 2, 4000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / 4000) ** 0.5
