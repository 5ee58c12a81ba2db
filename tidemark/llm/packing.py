"""Best-fit packing: length patterns fitted to the length histogram by non-negative least squares, residuals best-fit.

A null or empty text is the end id alone. Documents longer than the capacity are cut into full pieces, the first of
which may be shorter; nothing else is cut. Repeated rows, and rows with a null doc_id, are packed like others, each on
its own. Pieces of one length are dealt to the places of that length in order of a hash of doc_id and piece, then of
doc_id, piece and content; rows equal in all of these may change places. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.spool import Spool

CAPACITY = 2048
END = 0
_encodings: dict = {}


def _encoding(path: str, end_of_text: str = "<|endoftext|>"):
    if path not in _encodings:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={end_of_text: len(ranks)})
    return _encodings[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces. ``path``: the vocabulary as ranks."""
    Spool(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                out: list[tuple] = []
                for doc, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                    ids = np.append(encoding.encode_to_numpy(text.as_py() or "", allowed_special="all"), END).astype("<u4")
                    at, piece = 0, 0
                    while at < len(ids):
                        to = at + ((len(ids) - at) % capacity or capacity)
                        out.append((doc, piece, at, to - at, zlib.crc32(ids[at:to])))
                        at, piece = to, piece + 1
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(lengths: np.ndarray, capacity: int, near: int = 3) -> list[tuple[int, ...]]:
    """Multisets of one to eight of the given lengths that nearly fill the capacity, longest first.

    A length, none to six copies of one of a few probe lengths, and one of the lengths that fit the rest best.
    """
    lengths = np.sort(lengths)
    probes = np.unique(lengths[np.linspace(0, len(lengths) - 1, min(24, len(lengths))).astype(int)])
    found: set[tuple[int, ...]] = set()

    def close(head: tuple[int, ...]) -> None:
        room = capacity - sum(head)
        at = int(np.searchsorted(lengths, room, "right"))
        for x in lengths[max(0, at - near) : at]:
            found.add(tuple(sorted((*head, int(x)), reverse=True)))

    for a in map(int, lengths):
        found.add((a,))
        close((a,))
        if 2 * a < capacity:
            close((a, a))
        for i, b in enumerate(map(int, probes)):
            for m in range(1, 3 if i % 3 else 7):
                if a + m * b >= capacity:
                    break
                close((a, *[b] * m))
    return sorted(found, reverse=True)


def fit(histogram: dict[int, int], shapes: list[tuple[int, ...]], sweeps: int = 40) -> np.ndarray:
    """Non-negative x that least-squares fits sum(x * shape) to the histogram, by coordinate descent from the fullest shapes.

    Every fifth sweep goes over all shapes, so one that was at zero can come back; those between go over the ones in use.
    """
    left = np.zeros(max(histogram, default=0) + 1)
    for length, n in histogram.items():
        left[length] = n
    terms = [(np.array(list(c)), np.array(list(c.values()), float)) for c in map(Counter, shapes)]
    norm = [float((m * m).sum()) for _, m in terms]
    every = sorted(range(len(shapes)), key=lambda i: (-sum(shapes[i]), len(shapes[i])))
    x, used = np.zeros(len(shapes)), every
    for turn in range(sweeps):
        moved, whole = 0.0, turn % 5 == 0
        for i in every if whole else used:
            at, m = terms[i]
            new = max(0.0, x[i] + float(m @ left[at]) / norm[i])
            if (step := new - x[i]) != 0:
                left[at] -= step * m
                x[i] = new
                moved = max(moved, abs(step))
        used = [i for i in every if x[i] > 0]
        if whole and moved < 0.05:
            break
    return x


def by_patterns(left: dict[int, int], capacity: int = CAPACITY, rounds: int = 4, spare: int = 8) -> Counter:
    """How often each pattern is used; what it places is taken from ``left``.

    The fitted counts are rounded, the largest first and never beyond what is left of a length. What rounding leaves is
    fitted again, with patterns of the lengths that are left and counts rounded up.
    """
    out: Counter = Counter()
    for turn in range(rounds):
        shapes = [s for s in patterns(np.array(list(left)), capacity) if sum(s) >= capacity - spare and len(s) > 1] if left else []
        placed = 0
        for shape, x in sorted(zip(shapes, fit(left, shapes), strict=True), key=lambda p: (-p[1], -sum(p[0]), p[0])):
            if x <= 0:
                break
            need = Counter(shape)
            times = min(int(x + 0.5) if turn == 0 else int(np.ceil(x)), *(left.get(k, 0) // m for k, m in need.items()))
            if times > 0:
                out[shape] += times
                placed += times
                for k, m in need.items():
                    left[k] -= m * times
                    if not left[k]:
                        del left[k]
        if not placed:
            break
    return out


def best_fit(left: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """Best fit decreasing on counts: bins of equal content are one entry."""
    bins: dict[int, Counter] = defaultdict(Counter)
    for length in sorted((k for k, n in left.items() if n > 0), reverse=True):
        n = left[length]
        while n:
            room = min((r for r, b in bins.items() if r >= length and b), default=None)
            if room is None:
                room, source = capacity, Counter({(): n})
            else:
                source = bins[room]
            fits = room // length
            content, count = next(iter(sorted(source.items())))
            whole = min(count, n // fits)
            if whole:
                times, put = whole, fits
            else:
                times, put = 1, n
            n -= times * put
            if room != capacity or content:
                source[content] -= times
                if not source[content]:
                    del source[content]
            bins[room - put * length][content + (length,) * put] += times
    out: Counter = Counter()
    for b in bins.values():
        out.update(b)
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, how many such sequences): covers the histogram exactly.

    Works on counts, so its cost depends on the number of different lengths (at most ``capacity``), not on the documents.
    """
    left = {k: n for k, n in histogram.items() if n > 0 and k < capacity}
    out = Counter({(capacity,): histogram.get(capacity, 0)})
    out.update(by_patterns(left, capacity))
    out.update(best_fit(left, capacity))
    return sorted((s, n) for s, n in out.items() if n)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces.

    The histogram (at most ``capacity`` rows) comes to the driver. A piece's rank among those of its length is its rank
    in one of many buckets plus the bucket's start, so that no length, however common, is ranked by one task; the plan's
    slots (a bounded list, as many as the plan's patterns) then turn (length, rank) into a place.
    """
    histogram = {int(r["length"]): r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    sequence, slots, taken = 0, [], Counter()
    for shape, times in plan(histogram, capacity):
        offset = 0
        for length in shape:
            slots.append((length, taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 4)
    shift = 44
    shared = found.sparkSession.sparkContext.broadcast(table)
    buckets = max(64, sum(histogram.values()) // 500_000)
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    starts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inner = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("place", F.row_number().over(inner)).join(starts, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("place") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = (table[:, 0] << shift) + table[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, (length << shift) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for all documents."""
    return pack(Spool(docs.sparkSession).cut(pieces(docs, path, capacity), "pieces"), capacity)
