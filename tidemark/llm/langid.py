"""Language id: segmentation-marginalised unigrams over the pieces of a fixed public vocabulary.

A text's score in a language is the sum over its words of the log probability of the word's letters, summed over all
ways to cut them into pieces (forward algorithm, in logarithms, so a word of any length keeps its value).

Null texts and texts without letters are ``und`` with score 0, as is every text where no row is labelled. Equal scores
go to the first language in order of name. Repeated rows are scored like others, each on its own. White space and
everything but letters only separates. Only doc_id, text and, for fitting, lang are read: other columns, whatever their
names, have no part in it.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.spool import BROADCAST_BYTES, Spool

#: Bounds of the sample a model is fitted on: documents a language (expected number), different words a language, and
#: different words in all, which only matters with more than forty languages. Long words are fitted in parts.
SAMPLE_DOCS, LANGUAGE_WORDS, SAMPLE_WORDS, FIT_LETTERS = 500, 40_000, 1_600_000, 64
#: Words of at most so many characters are remembered by a worker, this many numbers in all.
MEMO_CHARS, MEMO_NUMBERS = 64, 2_000_000
#: Characters of a text that are cut into words at once.
SEGMENT = 1 << 20
FLOOR = 1e-8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RUNS = regex.compile(r"\p{L}+")
START = "▁"


def vocabulary(path: str) -> list[str]:
    """Pieces of letters of a ranks file (base64 token, rank a line), lower-cased; a leading space marks a word's start."""
    out = set()
    with open(path, "rb") as f:
        for line in f:
            try:
                token = base64.b64decode(line.split()[0]).decode().lower()
            except UnicodeDecodeError:
                continue
            body = token[1:] if token.startswith(" ") else token
            if body.isalpha():
                out.add(START + body if token != body else body)
    return sorted(out)


def _codes(words: list[str], width: int) -> np.ndarray:
    """Words as a matrix of code points, zero after their end."""
    return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), width).astype(np.uint64)


def _blocks(words: list[str], numbers: int) -> Iterator[np.ndarray]:
    """Indices of words of like lengths, in blocks that take about ``numbers`` numbers a place of a word."""
    lengths = np.array([len(w) for w in words], np.int64)
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        low = int(lengths[order[at]])
        high = low if low <= 24 else low + low // 4
        most = max(1, min(8192, numbers // max(low, 1)))
        to = min(int(np.searchsorted(lengths[order], high, "right")), at + most)
        yield order[at:to]
        at = to


class PieceModel:
    """Log probabilities of pieces by language; ``score`` gives the log probability of words in every language."""

    def __init__(self, pieces: list[str], languages: list[str], log_p: np.ndarray | None = None):
        self.languages, self.pieces = languages, pieces
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.at, self.none = hashes[order], order, len(pieces)
        self.lengths = sorted({1, *map(len, pieces)})
        self.log_p = np.full((len(pieces) + 1, len(languages)), np.log(FLOOR)) if log_p is None else log_p

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
        return h

    def found(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """By piece length: the piece that ends at each place, or ``none``."""
        out, h = {}, np.zeros_like(codes)
        for k in range(1, min(self.lengths[-1], codes.shape[1]) + 1):
            h = np.concatenate([np.zeros_like(h[:, :1]), h[:, :-1]], axis=1) * _BASE + codes + np.uint64(1) if k > 1 else codes + np.uint64(1)
            if k not in self.lengths:
                continue
            if not len(self.hashes):
                out[k] = np.full(codes.shape, self.none)
                continue
            slot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            out[k] = np.where(self.hashes[slot] == h, self.at[slot], self.none)
            out[k][:, : k - 1] = self.none
        return out

    def ends(self, found: dict[int, np.ndarray]) -> list[list[int]]:
        """For each place, the piece lengths above one that end there in some word."""
        width = found[1].shape[1]
        out: list[list[int]] = [[] for _ in range(width)]
        for k, at in found.items():
            if k > 1:
                for i in np.flatnonzero((at != self.none).any(axis=0)).tolist():
                    out[i].append(k)
        return out

    def forward(self, found: dict[int, np.ndarray], log_p: np.ndarray) -> Iterator[np.ndarray]:
        """log of the summed probability of the first 0, 1, 2, ... letters, for every word and column of ``log_p``."""
        ends, span = self.ends(found), self.lengths[-1]
        past = [np.zeros((len(found[1]), log_p.shape[1]))]
        yield past[0]
        for i, lengths in enumerate(ends):
            new = past[-1] + log_p[found[1][:, i]]
            for k in lengths:
                at = found[k][:, i]
                rows = np.flatnonzero(at != self.none)
                new[rows] = np.logaddexp(new[rows], past[-k][rows] + log_p[at[rows]])
            past.append(new)
            if len(past) > span:
                past.pop(0)
            yield new

    def score(self, words: list[str]) -> np.ndarray:
        """Words come with START in front."""
        out = np.zeros((len(words), len(self.languages)))
        for rows in _blocks(words, 2_000_000 // max(1, len(self.languages))):
            part = [words[i] for i in rows]
            last = np.array([len(w) for w in part])
            for length, value in enumerate(self.forward(self.found(_codes(part, int(last.max()))), self.log_p)):
                done = np.flatnonzero(last == length)
                out[rows[done]] = value[done]
        return out

    def fit(self, column: int, words: list[str], counts: np.ndarray, rounds: int, smooth: float = 0.1) -> None:
        """EM for one language: expected uses of each piece over all segmentations, by forward and backward sums."""
        blocks = [(rows, self.found(_codes([words[i] for i in rows], len(words[rows[-1]])))) for rows in _blocks_of_one_length(words)]
        for _ in range(rounds):
            log_p = self.log_p[:, column : column + 1]
            uses = np.zeros(self.none + 1)
            for rows, found in blocks:
                before = list(self.forward(found, log_p))
                after = [np.log(np.maximum(counts[rows], 1e-300))[:, None] - before[-1]]
                starts: list[list[tuple[int, np.ndarray]]] = [[] for _ in before]
                for k, at in found.items():
                    for i in range(k - 1, at.shape[1]):
                        hit = np.flatnonzero(at[:, i] != self.none) if k > 1 else np.arange(len(rows))
                        if len(hit):
                            starts[i - k + 1].append((k, hit))
                for i in range(len(before) - 2, -1, -1):
                    new = np.full((len(rows), 1), -np.inf)
                    for k, hit in starts[i]:
                        piece = found[k][hit, i + k - 1]
                        flow = log_p[piece] + after[-k][hit]  # after[-k] belongs to place i + k
                        new[hit] = np.logaddexp(new[hit], flow)
                        uses += np.bincount(piece, np.exp(flow + before[i][hit])[:, 0], self.none + 1)
                    after.append(new)
                    after[:] = after[-self.lengths[-1] - 1 :]
            uses[self.none] = 0
            p = np.maximum((uses + smooth) / (uses.sum() + smooth * (self.none + 1)), FLOOR)
            p[self.none] = FLOOR
            self.log_p[:, column] = np.log(p)


def _blocks_of_one_length(words: list[str]) -> Iterator[np.ndarray]:
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        for lo in range(0, len(rows), 8192):
            yield rows[lo : lo + 8192]


def _parts(word: str) -> list[str]:
    """A word with START, in parts of FIT_LETTERS; only the first has the START."""
    return [(START if not lo else "") + word[lo : lo + FIT_LETTERS] for lo in range(0, len(word), FIT_LETTERS)]


def train(words: list[tuple[str, str, int]], pieces: list[str], rounds: int = 4) -> PieceModel:
    """``words``: (language, word, count). Fits one piece distribution a language by EM."""
    counted: dict[str, dict[str, int]] = {}
    for language, word, n in words:
        own = counted.setdefault(language, {})
        for run in _RUNS.findall(word):
            for part in _parts(run):
                own[part] = own.get(part, 0) + n
    languages = sorted(counted)
    every = sorted({w for own in counted.values() for w in own})
    model = PieceModel(sorted({*pieces, *(c for w in every for c in w), START}), languages)
    seen = np.zeros(len(model.pieces) + 1, bool)
    for rows in _blocks_of_one_length(every):
        for at in model.found(_codes([every[i] for i in rows], len(every[rows[0]]))).values():
            seen[np.unique(at)] = True
    model = PieceModel([p for p, s in zip(model.pieces, seen, strict=False) if s], languages)
    model.log_p[:] = np.log(10.0) * np.array([[min(len(p), 8) - 12] for p in [*model.pieces, ""]])
    for column, language in enumerate(languages):
        own = sorted(counted[language])
        model.fit(column, own, np.array([counted[language][w] for w in own], float), rounds)
    return model


def sample_words(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, language_words: int = LANGUAGE_WORDS, sample_words: int = SAMPLE_WORDS) -> list[tuple[str, str, int]]:
    """Counted lower-case words of a bounded hash sample of labelled rows: about ``sample_docs`` documents of every language,
    and of these the ``language_words`` most frequent words (fewer where there are so many languages that all would be
    more than ``sample_words``)."""
    spool = Spool(docs.sparkSession)
    docs = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = spool.cut(docs.groupBy("lang").agg(F.count("*").alias("n")), "sizes")
    languages = sizes.count()
    most = min(language_words, max(100, sample_words // max(languages, 1)))
    share = F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.col("n"))
    sized = docs.join(F.broadcast(sizes) if languages * 64 <= BROADCAST_BYTES else sizes.hint("merge"), "lang")
    picked = sized.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    words = picked.select("lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)")).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))  # the words of one bounded sample
    out = sorted(tuple(r) for r in ranked.where(F.col("rank") <= most).select("lang", "word", "n").collect())
    spool.drop("sizes")
    return out


_scored: dict[str, tuple[dict[str, int], np.ndarray]] = {}


def _segments(text: str) -> Iterator[str]:
    """The text in parts cut at white space, so that the words of a very long one needn't all be held at once."""
    at = 0
    while len(text) - at > SEGMENT:
        m = regex.compile(r"\s").search(text, at + SEGMENT)
        if m is None:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def _values(model: PieceModel, chunks: list[str]) -> np.ndarray:
    """For each chunk its log probability in every language and, last, its number of runs of letters."""
    runs = [[START + x for x in ([c] if c.isalpha() else _RUNS.findall(c))] for c in chunks]
    owner = np.repeat(np.arange(len(chunks)), [len(r) for r in runs])
    distinct = sorted({x for r in runs for x in r})
    place = {w: i for i, w in enumerate(distinct)}
    value = np.zeros((len(chunks), len(model.languages) + 1))
    if distinct:
        each = model.score(distinct)[[place[x] for r in runs for x in r]]
        for j in range(each.shape[1]):
            value[:, j] = np.bincount(owner, each[:, j], len(chunks))
    value[:, -1] = np.bincount(owner, minlength=len(chunks))
    return value


def _totals(model: PieceModel, rows: list[list[str]], memo: dict[str, int], table: np.ndarray) -> np.ndarray:
    """The summed values of each row's chunks. What is remembered saves time and changes no value."""
    distinct = {c for r in rows for c in r}
    if len(memo) + sum(c not in memo for c in distinct) > len(table):
        memo.clear()
    known = [c for c in distinct if c in memo]
    new = sorted(c for c in distinct if c not in memo)
    fresh = _values(model, new)
    full = np.concatenate([table[[memo[c] for c in known]], fresh])
    place = {c: i for i, c in enumerate([*known, *new])}
    keep = [i for i, c in enumerate(new) if len(c) <= MEMO_CHARS][: len(table) - len(memo)]
    first = len(memo)
    table[first : first + len(keep)] = fresh[keep]
    memo.update((new[i], first + j) for j, i in enumerate(keep))
    out = np.zeros((len(rows), table.shape[1]))
    for i, r in enumerate(rows):
        for lo in range(0, len(r), 1 << 16):
            part = r[lo : lo + (1 << 16)]
            out[i] += full[np.fromiter(map(place.__getitem__, part), np.int64, len(part))].sum(axis=0)
    return out


def predict(model: PieceModel, texts: list[str | None], memo: dict[str, int] | None = None, table: np.ndarray | None = None) -> tuple[list[str], np.ndarray]:
    """The best language of each text and its posterior probability under equal priors."""
    memo = {} if memo is None else memo
    table = np.zeros((0, len(model.languages) + 1)) if table is None else table
    total = np.zeros((len(texts), len(model.languages) + 1))
    short = [i for i, t in enumerate(texts) if t and len(t) <= SEGMENT]
    if short:
        total[short] = _totals(model, [texts[i].lower().split() for i in short], memo, table)
    for i, t in enumerate(texts):
        if t and len(t) > SEGMENT:
            for part in _segments(t):
                total[i] += _totals(model, [part.lower().split()], memo, table)[0]
    best, score = [], np.zeros(len(texts))
    for i, row in enumerate(total):
        if row[-1] == 0 or not model.languages:
            best.append("und")
            continue
        j = int(np.argmax(row[:-1]))
        best.append(model.languages[j])
        score[i] = round(float(1 / np.exp(row[:-1] - row[j]).sum()), 9)
    return best, score


def identify(docs: DataFrame, model: PieceModel) -> DataFrame:
    """(doc_id, lang_pred, score), one row a row. Only ``text`` is an input of a prediction."""
    Spool(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.pieces, model.languages, model.log_p))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = PieceModel(*shared.value)
        if key not in _scored:
            _scored.clear()
            width = len(mine.languages) + 1
            _scored[key] = {}, np.zeros((max(1, MEMO_NUMBERS // width), width))
        memo, table = _scored[key]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                best, score = predict(mine, rows.column(1).to_pylist(), memo, table)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(best, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
