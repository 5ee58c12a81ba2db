"""Repeated passages against a brute-force version: sets of windows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import passages
from tidemark.llm.queries import op8_repeated_passages


def brute(rows, window=50):
    smallest = {}
    split = [(i, (t or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")) for i, t in rows]
    split = [(i, [w for w in ws if w]) for i, ws in split]
    for i, ws in split:
        if i is not None:
            for s in range(len(ws) - window + 1):
                key = tuple(ws[s : s + window])
                smallest[key] = min(smallest.get(key, i), i)
    out = []
    for i, ws in split:
        gone = set()
        if i is not None:
            for s in range(len(ws) - window + 1):
                if smallest[tuple(ws[s : s + window])] < i:
                    gone.update(range(s, s + window))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed: int):
    rng = random.Random(seed)
    word = lambda: rng.choice("aaabcde") + str(rng.randrange(400)) + rng.choice(["", "é", "."])
    text = lambda n: [word() for _ in range(n)]
    shared = [text(rng.randrange(45, 130)) for _ in range(5)]
    rows = []
    for i in range(60):
        ws = text(rng.randrange(0, 200))
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = s if rng.random() < 0.7 else s[rng.randrange(10) :]
        rows.append((i * 3, rng.choice([" ", "\n", " \t "]).join(ws)))
    whole = rows[7][1]
    rows += [(500, whole), (501, whole + " " + whole), (21, whole.replace(" ", "\n")), (502, "x " * 300), (503, "x " * 120), (504, None), (505, ""), (None, whole), (None, None), (506, " ".join(["x", "y"] * 200))]
    other = " ".join(text(60))
    # one doc_id with two texts: one holds a copy of a smaller document's words, the other words of its own
    rows += [(2, " ".join(text(60))), (2, whole + " tail"), (1, other), (7, other), (7, " ".join(text(20)) + " " + other), (7, other)]
    return rows


@pytest.mark.parametrize("seed, shard, automaton, size", [(1, 32_000, 64_000, 8 << 20), (2, 7, 3, 3000)])
def test_against_windows(spark, tmp_path, monkeypatch, seed, shard, automaton, size):
    monkeypatch.setattr(passages, "SHARD", shard)
    monkeypatch.setattr(passages, "AUTOMATON", automaton)
    monkeypatch.setattr(passages, "TASK_BYTES", size)
    rows = made(seed)
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("th", F.lit("x")).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op8_repeated_passages(spark, str(tmp_path)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute(rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text")
    spans = passages.repeated_spans(docs)
    native = passages.with_spans(docs, spans).select("doc_id", F.sha2(F.coalesce(passages.without(F.col("text"), F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>"))), F.lit("")), 256))
    assert sorted((tuple(r) for r in native.collect()), key=str) == sorted(((i, h) for i, _, _, h in brute(rows)), key=str)


def test_an_automaton_matches_whole_words():
    machine, spelt = passages.compiled([b"a b c", b"b c d"])
    assert passages.occurrences(machine, spelt, b"x a b c d ab c d".split()).tolist() == [3, 4]
    many = [b" ".join(b"%d" % (i + k) for k in range(3)) for i in range(5000)]
    machine, spelt = passages.compiled(many)
    assert passages.occurrences(machine, spelt, b"0 1 2 3 x 4999 5000 5001 64 65".split()).tolist() == [2, 3, 7]
