"""Packing against the tokenizers library, and plans against their histograms and the lower bound."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.queries import op9_packing

ALPHABET = "aé字🎉 \n\t'sABC12345.,-ſΣ́‍ <|endoftext|>"


def texts(n, seed=0):
    rng = random.Random(seed)
    some = ["", None, " ", "<|endoftext|>", "a<|endoftext|>b", "word " * 5000, "\n\n  \n", "naïve café", "x" * 3000]
    return some + ["".join(rng.choice([*ALPHABET, "the ", " and", "<|endoftext|>"]) for _ in range(rng.randrange(0, 400))) for _ in range(n)]


def test_pieces_and_places(spark, tmp_path):
    rows = list(enumerate(texts(300))) + [(None, "no id"), (3, "repeated id"), (3, "repeated id")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = op9_packing(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    want = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        at, piece = 0, 0
        while at < len(ids):
            to = at + ((len(ids) - at) % 2048 or 2048)
            want[i, piece, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes())] += 1
            at, piece = to, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    filled = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048 and len(filled) <= -(-sum(filled.values()) // 2048) + 1


@pytest.mark.parametrize("seed, n", [(0, 1000), (1, 60), (2, 1), (3, 40_000)])
def test_plans(seed, n):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.lognormal(5.8, 1.0, n).astype(int) + 1, 2048)
    histogram = {int(k): int(c) for k, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plan = packing.plan(histogram)
    used = Counter()
    for shape, times in plan:
        assert sum(shape) <= 2048 and times > 0
        for length in shape:
            used[length] += times
    assert used == Counter(histogram)
    assert sum(t for _, t in plan) <= -(-int(lengths.sum()) // 2048) * 1.01 + 2


@pytest.mark.parametrize("n", [1000, 20_000])
def test_most_pieces_are_placed_by_patterns(n):
    """Lengths spread over the whole capacity. Documents so short that a sequence takes more than eight are left to best fit."""
    lengths = np.random.default_rng(5).integers(1, 2048, n)
    left = {int(k): int(c) for k, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    packing.by_patterns(left)
    assert 1 - sum(left.values()) / n > 0.7


def test_fit_takes_a_shape_back():
    # three shapes fit exactly: the coordinates that start too high must come down and the others return from zero
    histogram = {1024: 7, 512: 3, 1536: 3}
    shapes = [(1024, 1024), (1536, 512), (1024, 512, 512)]
    x = packing.fit(histogram, shapes, 200)
    assert np.allclose(x, [3.5, 3, 0], atol=0.1)


def test_no_histogram():
    assert packing.plan({}) == [] and packing.plan({2048: 3}) == [((2048,), 3)]
