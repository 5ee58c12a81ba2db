"""Quality classifier by co-training of a text-content view and a page-metadata view.

Every unlabelled document takes part in the exchange: each round, each view scores all of them, and what it is sure of
are the pseudo-labels it gives. Fits are on bounded samples of labelled and pseudo-labelled documents.

Null and empty texts have the content features of an empty text; null metadata is a category of its own. Repeated rows
score alike, each on its own. For fitting, a doc_id counts once: with the largest of its labels and, where it has
several texts, the first in order of their features. Rows with a null doc_id are unlabelled. Where no row is labelled
the score is 0.5. Ties in the order of a sample go to the smaller doc_id. Only doc_id, text, source, lang and n_chars
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrowtext import Words, blocks, per_text
from tidemark.llm.boosting import BoostedTrees, Isotonic, fit_logistic, sigmoid
from tidemark.llm.spool import Spool
from tidemark.llm.toxicity import Features

#: Bounds of the fit: labelled documents, of which every CALIBRATION-th calibrates, pseudo-labelled documents a view is
#: given in a round (both the first in order of a hash of their id), and rounds of exchange.
LABELLED, CALIBRATION, PSEUDO, ROUNDS = 8_000, 4, 6_000, 3
#: A pseudo-label is given away at this probability.
CONFIDENT = 0.95
BUCKETS = 64
_LINES = np.arange(256) == 10


class ContentView:
    """Dense features of the text alone."""

    def __init__(self) -> None:
        self.base = Features([])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words = Words(data, offsets)
        n, docs = len(words.counts), words.docs
        count = np.maximum(words.counts, 1)

        def share(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
            """Different ones by all."""
            order = np.lexsort((hashes, owner))
            o, h = owner[order], hashes[order]
            new = np.ones(len(o), bool)
            new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
            return np.bincount(o[new], minlength=n) / np.maximum(np.bincount(owner, minlength=n), 1)

        three = words.windows(3)
        lines = Words(data, offsets, _LINES)
        length = words.ends - words.starts
        return np.column_stack([self.base(data, offsets), share(docs, words.hashes), share(three[0], three[2]), share(lines.docs, lines.hashes), lines.counts / count,
                                per_text((length == 1).astype(np.int64), words.first) / count])


def metadata_features(rows: list[tuple[str | None, str | None, int | None]]) -> np.ndarray:
    """Hashed source and language, and the recorded length, of each page."""
    out = np.zeros((len(rows), BUCKETS + 4))
    for i, (source, lang, chars) in enumerate(rows):
        for field in (f"s:{source}", f"l:{lang}"):
            h = 1469598103934665603
            for b in field.encode():
                h = (h ^ b) * 1099511628211 % (1 << 64)
            out[i, (h >> 20) % BUCKETS] += 1
        x = np.log1p(max(chars or 0, 0))
        out[i, BUCKETS:] = x / 10, x * x / 100, float(chars is None), float((chars or 0) < 400)
    return out


class Quality:
    """The two views' classifiers, their calibrations and the weights that combine them."""

    def __init__(self, content: BoostedTrees, meta: np.ndarray, calibrations: tuple[Isotonic, Isotonic], blend: np.ndarray):
        self.content, self.meta, self.calibrations, self.blend = content, meta, calibrations, blend

    def __call__(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        raw = self.content.raw(content), np.column_stack([meta, np.ones(len(meta))]) @ self.meta
        logits = [_logit(c(r)) for c, r in zip(self.calibrations, raw, strict=True)]
        return sigmoid(np.column_stack([*logits, np.ones(len(content))]) @ self.blend)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0.005, 0.995)
    return np.log(p / (1 - p))


ROW = "content array<float>, source string, lang string, n_chars long"


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, content, source, lang, n_chars): both views of every row, a written table that fits and scores read."""
    inputs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")), F.col("n_chars").cast("long").alias("n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view = ContentView()
        for part, data, offsets in blocks(batches):
            content = view(data, offsets).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(content), pa.list_(pa.float32())), *part.columns[2:]], names=["doc_id", "content", "source", "lang", "n_chars"])

    spool = Spool(docs.sparkSession)
    return spool.cut(inputs.mapInArrow(run, f"doc_id long, {ROW}"), "features")


def _columns(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The two views of rows (doc_id, content, source, lang, n_chars)."""
    content = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
    return content, metadata_features(list(zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True)))


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.ones(len(x))])


def _given(free: DataFrame, view: int, model: BoostedTrees | np.ndarray, limit: int) -> list[tuple]:
    """(label, content, source, lang, n_chars) of unlabelled rows that one view (0: content, 1: metadata) is sure of: the first ``limit`` by hash of all."""
    shared = free.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                x = _columns(part)[view]
                p = sigmoid(shared.value.raw(x) if view == 0 else _with_one(x) @ shared.value)
                sure = pa.array(np.maximum(p, 1 - p) >= CONFIDENT)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "content", "source", "lang", "n_chars", "label"]).filter(sure)

    sure = free.mapInArrow(run, f"doc_id long, {ROW}, label int")
    top = sure.orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id", "content").limit(limit).collect()
    return [(r["label"], r["content"], r["source"], r["lang"], r["n_chars"]) for r in top]


def _arrays(rows: list[tuple], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    content = np.array([r[1] for r in rows], float).reshape(len(rows), width)
    return content, metadata_features([r[2:] for r in rows]), np.array([r[0] for r in rows], float)


def fit(table: DataFrame, labels: DataFrame, labelled: int = LABELLED, pseudo: int = PSEUDO, rounds: int = ROUNDS) -> Quality:
    """``table``: from ``features``; ``labels``: (doc_id, quality). Rows without a label are the unlabelled ones."""
    spool = Spool(table.sparkSession)
    labels = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("y"))
    labels = spool.cut(labels, "labels")
    row = F.struct("content", "source", "lang", "n_chars")
    known = table.hint("merge").join(labels.hint("merge"), "doc_id").groupBy("doc_id").agg(F.min(row).alias("row"), F.max("y").alias("y"))
    top = known.orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id").limit(labelled).collect()
    free = spool.cut(table.hint("merge").join(labels.hint("merge"), "doc_id", "left_anti"), "free")
    width = len(ContentView()(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0])
    content, meta, y = _arrays([(r["y"], *r["row"]) for r in top], width)
    aside = np.arange(len(y)) % CALIBRATION == CALIBRATION - 1
    own = content[~aside], meta[~aside], y[~aside]
    trees, weights = BoostedTrees(trees=40).fit(own[0], own[2]), fit_logistic(own[1], own[2])
    for _ in range(rounds if len(y) else 0):
        by_content, by_meta = _arrays(_given(free, 0, trees, pseudo), width), _arrays(_given(free, 1, weights, pseudo), width)
        trees = BoostedTrees(trees=40).fit(np.concatenate([own[0], by_meta[0]]), np.concatenate([own[2], by_meta[2]]))
        weights = fit_logistic(np.concatenate([own[1], by_content[1]]), np.concatenate([own[2], by_content[2]]))
    spool.drop("labels", "free")
    if aside.sum() < 8:  # too few to set any aside
        aside = np.ones(len(y), bool)
    raw = trees.raw(content[aside]), _with_one(meta[aside]) @ weights
    calibrations = Isotonic().fit(raw[0], y[aside]), Isotonic().fit(raw[1], y[aside])
    blend = fit_logistic(np.column_stack([_logit(c(r)) for c, r in zip(calibrations, raw, strict=True)]), y[aside])
    return Quality(trees, weights, calibrations, blend)


def score(table: DataFrame, model: Quality) -> DataFrame:
    """(doc_id, score): the probability of good quality, one row a row. ``table``: from ``features``."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value(*_columns(part)))], names=["doc_id", "score"])

    return table.mapInArrow(run, "doc_id long, score double")
