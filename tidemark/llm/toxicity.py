"""Toxicity: gradient-boosted trees over dense lexical features, with isotonic calibration.

Null and empty texts have all features zero and get the model's score for that. Only ``text`` is an input of a score, so
repeated rows score alike, each on its own. For fitting, a doc_id counts once: with the largest of its labels and, where
it has several texts, the first in order. Where no row is labelled the score is 0. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrowtext import Words, blocks, per_text
from tidemark.llm.boosting import BoostedTrees, Isotonic, fit_calibrated
from tidemark.llm.spool import Spool

#: Bounds of the fit: labelled documents (expected number), and words of the learned lexicon.
SAMPLE_DOCS, LEARNED_WORDS = 12_000, 300
#: Parts of the labelled documents that calibrate in turn.
FOLDS = 4
NEAR = 5
# fixed values: common insults and second-person words in four languages
INSULTS = """idiot idiots moron morons stupid dumb fool fools loser losers scum trash garbage worthless pathetic disgusting
clown clowns imbecile jerk ugly hate filthy vermin retard bastard bitch shit crap damn fuck fucking asshole coward liar
idiote abruti débile crétin connard salaud ordure nul minable dégoûtant merde stupide raté
dummkopf trottel arschloch abschaum dreck blöd dumm widerlich versager scheiße wertlos
estúpido imbécil tonto basura escoria asqueroso patético inútil mierda cabrón payaso perdedor""".split()
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch sie usted ustedes tú ti vosotros".split()

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LEET = _LOWER.copy()
for _a, _b in zip("0134578@$!", "oieastbasi", strict=True):
    _LEET[ord(_a)] = ord(_b)
_IS = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in {"excl": b"!", "quest": b"?", "symbol": b"#*$%&|<>@^~_=+", "digit": b"0123456789", "punct": b".,;:'\"()-", "line": b"\n"}.items()}
_UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_MARKS = ~(_LETTER | _IS["digit"] | np.isin(np.arange(256), np.frombuffer(b"@$!*", np.uint8)))
_PLAIN = ~_LETTER


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes as ``Words`` gives them for lower-case words of letters."""
    raw = [w.encode() for w in words]
    data = np.frombuffer(b" ".join(raw), np.uint8) if raw else np.zeros(0, np.uint8)
    return Words(data, np.array([0, len(data)]), _PLAIN).hashes


class Features:
    NAMES = (
        "words", "insults", "insult_rate", "learned", "learned_rate", "learned_top", "kinds", "you_rate", "near_you", "near_you_rate",
        "caps", "caps_words", "excl", "quest", "symbols", "digits", "punct", "lines", "obfuscated", "pairs", "word_length",
    )

    def __init__(self, learned: list[tuple[str, float]]):
        self.insults = np.sort(word_hashes(INSULTS))
        self.you = np.sort(word_hashes(SECOND_PERSON))
        hashes = word_hashes([w for w, _ in learned])
        order = np.argsort(hashes)
        self.learned, self.weight = hashes[order], np.array([v for _, v in learned])[order] if len(learned) else np.zeros(0)
        self.every = np.unique(np.concatenate([self.insults, self.learned]))

    @staticmethod
    def _in(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
        return table[np.minimum(np.searchsorted(table, hashes), len(table) - 1)] == hashes if len(table) else np.zeros(len(hashes), bool)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words = Words(_LOWER[data], offsets, _PLAIN)
        n, h, first = len(words.counts), words.hashes, words.first
        insult, you, learned = self._in(h, self.insults), self._in(h, self.you), self._in(h, self.learned)
        docs = words.docs
        weight = np.zeros(len(h))
        if len(self.learned):
            weight[learned] = self.weight[np.searchsorted(self.learned, h[learned])]
        hit = insult | learned
        near = np.zeros(len(h) + 1, np.int64)
        at = np.flatnonzero(you)
        np.add.at(near, np.maximum(at - NEAR, first[docs[at]]), 1)
        np.add.at(near, np.minimum(at + NEAR + 1, first[docs[at] + 1]), -1)
        near_you = hit & (np.cumsum(near)[:-1] > 0)
        hits = np.flatnonzero(hit)
        pair = np.zeros(len(h), bool)
        if len(hits) > 1:
            pair[hits[1:]] = (np.diff(hits) <= NEAR) & (docs[hits[1:]] == docs[hits[:-1]])
        top = np.zeros(n)
        np.maximum.at(top, docs, weight)
        keys = np.unique(np.stack([docs[hits].astype(np.uint64), h[hits]]), axis=1) if len(hits) else np.zeros((2, 0), np.uint64)
        kinds = np.bincount(keys[0].astype(np.int64), minlength=n)
        marked = Words(_LEET[data], offsets, _MARKS)
        hidden = self._in(marked.hashes, self.every)
        if hidden.any():
            odd = per_text(~_LETTER[data], np.array([0, len(data)]))[0] and np.concatenate([[0], np.cumsum(~_LETTER[data])])
            hidden &= (odd[marked.ends] - odd[marked.starts]) > 0
        size = np.maximum(np.diff(offsets), 1)
        letters = np.maximum(per_text(_LETTER[data], offsets), 1)
        count = np.maximum(words.counts, 1)
        caps = per_text(_UPPER[data], offsets)
        upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
        length = words.ends - words.starts
        shout = (upper[words.ends] - upper[words.starts] == length) & (length > 1)
        rates = [per_text(_IS[k][data], offsets) / size for k in ("excl", "quest", "symbol", "digit", "punct", "line")]
        sums = lambda x: per_text(x, first)
        n_insult, n_learned, n_near = sums(insult), np.bincount(docs, weight, n), sums(near_you)
        return np.column_stack([
            np.log1p(words.counts), np.log1p(n_insult), n_insult / count, n_learned, n_learned / count, top, kinds, sums(you) / count, n_near, n_near / count,
            caps / letters, sums(shout) / count, *rates, per_text(hidden, marked.first), sums(pair), letters / count,
        ]).astype(np.float64)


class ToxicityModel:
    def __init__(self, features: Features, trees: BoostedTrees, calibration: Isotonic):
        self.features, self.trees, self.calibration = features, trees, calibration

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.calibration(self.trees.raw(self.features(data, offsets)))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, learned_words: int = LEARNED_WORDS) -> ToxicityModel:
    """``labels``: (doc_id, toxic); null labels and ids are left out. At most about ``sample_docs`` labelled documents are used, taken by hash."""
    spool = Spool(docs.sparkSession)
    labels = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    labels = spool.cut(labels, "labels")
    n = labels.count()
    share = min(1.0, sample_docs / n) if n else 0
    picked = labels.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = texts.join(F.broadcast(picked), "doc_id")  # at most about sample_docs rows of two numbers
    train = spool.cut(train.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "train")
    fold = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(FOLDS)).cast("int")
    words = train.select("toxic", fold.alias("fold"), F.explode(F.array_distinct(F.expr(r"regexp_extract_all(lower(text), '\\p{L}{2,}', 0)"))).alias("word"))
    seen = spool.cut(words.groupBy("word", "fold").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")), "seen")
    sums = {r["fold"]: (r["bad"], r["n"]) for r in train.groupBy(fold.alias("fold")).agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).collect()}
    # one lexicon without each fold, for the calibration, and one of all rows, for the model
    every = [Features(_lexicon(seen, sums, without, learned_words)) for without in (*range(FOLDS), None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            x = np.concatenate([f(data, offsets) for f in every], axis=1)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2).cast(pa.int32()), rows.column(3), pa.array(list(x))], names=["doc_id", "toxic", "fold", "x"])

    held = train.select("doc_id", "text", "toxic", fold.alias("fold")).mapInArrow(run, "doc_id long, toxic int, fold int, x array<double>")
    rows = sorted((r["doc_id"], r["toxic"], r["fold"], r["x"]) for r in held.collect())
    x = np.array([r[3] for r in rows]).reshape(len(rows), FOLDS + 1, len(Features.NAMES))
    trees, calibration = fit_calibrated(x, np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], int))
    spool.drop("train", "labels", "seen")
    return ToxicityModel(every[-1], trees, calibration)


def _lexicon(seen: DataFrame, sums: dict[int, tuple[int, int]], without: int | None, most: int) -> list[tuple[str, float]]:
    """(word, log odds) of the words that tell toxic documents, counted without one fold. ``seen``: (word, fold, bad, n)."""
    used = [v for k, v in sums.items() if k != without]
    bad, total = sum(v[0] for v in used), sum(v[1] for v in used)
    counted = (seen if without is None else seen.where(F.col("fold") != without)).groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.5) / (total - bad + 1.0))
    p = max(1, bad) / max(1, total)
    surprise = (F.col("bad") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p) + 1e-9)
    tell = counted.where((F.col("bad") >= 4) & (surprise >= 5)).select("word", odds.alias("odds"), "bad").where("odds > 1.0")
    return [(r["word"], float(r["odds"])) for r in tell.orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "word").limit(most).collect()]


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score)."""
    Spool(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(shared.value(data, offsets))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def filtered(docs: DataFrame, model: ToxicityModel, limit: float) -> DataFrame:
    """The rows of ``docs`` that score below the limit, all columns kept, in one pass."""
    Spool(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            yield rows.filter(pa.array(shared.value(data, offsets) < limit))

    return docs.mapInArrow(run, docs.schema)
