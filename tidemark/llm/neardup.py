"""MinHash near-dedup: BagMinHash signatures of shingle multisets, banded, then verified by multiset overlap.

Text null, empty or of white space only: no shingles, the document is a class of its own. Texts of one to
four words are one shingle, the whole text. Texts with equal word sequences are always one class.
A repeated doc_id is one document in the result, linked to all that any of its texts is linked to. Rows with a null doc_id are returned with a null class: they are compared with none.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrowtext import Words, blocks, lists, mix, range_hash, signed
from tidemark.llm.components import components
from tidemark.llm.spool import Spool, keep_matching

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at similarity 0.8 shares no band with probability (1 - 0.8 ** 4) ** 25 = 2e-6.
BANDS, ROWS = 25, 4
#: Members of a block when a bucket's members are compared with each other.
BLOCK = 512
_U = np.uint64


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each shingle, repeats included."""
    docs, _, hashes = words.windows(size)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        whole = range_hash(words.hashes, words.first[short], words.first[short + 1])
        docs, hashes = np.concatenate([docs, short]), np.concatenate([hashes, whole])
    return docs, hashes


def bags(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight): each text's distinct shingles with their counts."""
    order = np.argsort(hashes ^ mix(docs.astype(np.uint64)), kind="stable")
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(new)
    return docs[at], hashes[at], np.diff(np.append(at, len(docs)))


def bag_minhash(docs: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """BagMinHash: an (n_docs, size) matrix in which two texts' components are equal with the probability of their weighted Jaccard similarity.

    Each element owns independent Poisson processes over the dyadic weight intervals (0,1], (1,2], (2,4], (4,8], ...
    of rates 1, 1, 2, 4, ... A point has a time, a signature component and a place in its interval; it counts if its
    place is below the element's weight, so a shared element gives two texts the same points up to the smaller weight.
    A component holds its least time. Points are made in order of time, and only up to a limit by which a text expects
    ln(size) + 3 points a component; texts with a component still empty go again with twice the limit. Intervals are not
    split further, as the limit already bounds the points of a text by size * (ln(size) + 3), whatever its weights.
    """
    out = np.full(n_docs * size, np.inf)
    total = np.bincount(docs, weights, n_docs)
    limit = np.divide(size * (np.log(size) + 3), total, out=np.zeros(n_docs), where=total > 0)
    # the intervals that lie at least partly below each weight
    level = [(np.arange(len(docs)), np.zeros(len(docs), np.int64))]
    low, k = 1, 1
    while len(rest := np.flatnonzero(weights > low)):
        level.append((rest, np.full(len(rest), k)))
        low, k = low * 2, k + 1
    element, level = (np.concatenate(x) for x in zip(*level, strict=True))
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.maximum(low, 1)
    room = np.minimum(weights[element] - low, width)
    seed = mix(hashes[element] ^ mix(level.astype(np.uint64) + _U(77)))
    owner = docs[element]
    todo = np.flatnonzero(total > 0)
    while len(todo):
        mine = np.zeros(n_docs, bool)
        mine[todo] = True
        live = np.flatnonzero(mine[owner])
        time, turn = np.zeros(len(live)), 0
        while len(live):
            turn += 1
            point = mix(seed[live] + _U(turn * 0xA0761D6478BD642F % (1 << 64)))
            time = time - np.log1p(-(point >> _U(11)).astype(np.float64) / (1 << 53)) / width[live]
            inside = time <= limit[owner[live]]
            live, time, point = live[inside], time[inside], mix(point[inside] + _U(1))
            place = (point >> _U(32)).astype(np.int64) * width[live] >> 32
            good = place < room[live]
            np.minimum.at(out, owner[live][good] * size + ((point[good] & _U(0xFFFFFFFF)) % _U(size)).astype(np.int64), time[good])
        full = np.isfinite(out.reshape(n_docs, size)[todo]).all(axis=1)
        todo = todo[~full]
        limit[todo] *= 2
    return out.reshape(n_docs, size)


def _sign(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_in, data, offsets in blocks(batches):
            words = Words(data, offsets)
            n = len(words.counts)
            sig = bag_minhash(*bags(*shingles(words, size)), n, bands * rows).view(np.uint64).reshape(n, bands, rows)
            band = mix(np.arange(bands, dtype=np.uint64) + _U(1000))[None, :] * np.ones((n, 1), np.uint64)
            for r in range(rows):
                band = mix(band ^ sig[:, :, r])
            some = words.counts > 0
            a = range_hash(words.hashes, words.first[:-1], words.first[1:])
            b = range_hash(mix(words.hashes), words.first[:-1], words.first[1:])
            yield pa.RecordBatch.from_arrays(
                [rows_in.column(0), pa.array(words.counts, pa.int64()), pa.array(signed(a)), pa.array(signed(b)), lists(signed(band[some].ravel()), some * bands, pa.int64())],
                names=["doc_id", "n_words", "ka", "kb", "bands"],
            )

    return run


def _elements(size: int):
    """Each text's multiset as a set: the i-th copy of a shingle is an element of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_in, data, offsets in blocks(batches):
            words = Words(data, offsets)
            docs, hashes, weights = bags(*shingles(words, size))
            copy = np.arange(weights.sum()) - np.repeat(np.cumsum(weights) - weights, weights)
            docs, hashes = np.repeat(docs, weights), mix(np.repeat(hashes, weights) + copy.astype(np.uint64))
            order = np.argsort(docs, kind="stable")
            yield pa.RecordBatch.from_arrays(
                [rows_in.column(0), lists(signed(hashes[order]), np.bincount(docs, minlength=len(words.counts)), pa.int64())], names=["doc_id", "bag"]
            )

    return run


def _linked(similarity: float):
    """The classes that links between the members of one block, or of two, make of them: at most a row a member.

    Only members of different components are compared, and of two blocks only one from each; a pair whose distances to
    the star's centre differ by more than 1 - similarity can't be linked.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, comp, d, own = (group.column(c).to_numpy() for c in ("b", "comp", "d", "own"))
        ask = (comp[:, None] != comp[None]) & (np.abs(d[:, None] - d[None]) <= 1 - similarity + 1e-9)
        if group.column("cross")[0].as_py():
            ask &= own[:, None] != own[None]
        n, label = len(ids), np.arange(len(ids))
        if ask.any():
            column = group.column("bag").combine_chunks()
            size = column.value_lengths().to_numpy().astype(np.int64)
            _, element, times = np.unique(column.flatten().to_numpy(), return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(n), size)
            shared = times[element] > 1
            place = np.cumsum(times > 1) - 1
            owner, element = owner[shared], place[element[shared]]
            order = np.argsort(element, kind="stable")
            owner, element = owner[order], element[order]
            both = np.zeros((n, n), np.float32)
            for lo in range(0, int(element[-1]) + 1 if len(element) else 0, 4096):
                x, y = np.searchsorted(element, [lo, lo + 4096])
                part = np.zeros((n, 4096), np.float32)
                part[owner[x:y], element[x:y] - lo] = 1
                both += part @ part.T
            link = ask & (both >= similarity * (size[:, None] + size[None] - both) - 1e-3)
            # the float counts are whole numbers below 2 ** 24; the margin only guards the product
            while True:
                new = np.minimum(label, np.where(link, label[None], n).min(axis=1))
                new = np.minimum(new, new[new])
                if (new == label).all():
                    break
                label = new
        moved = np.flatnonzero(label != np.arange(n))
        return pa.table({"a": pa.array(np.minimum(ids[label[moved]], ids[moved])), "b": pa.array(np.maximum(ids[label[moved]], ids[moved]))})

    return run


def near_duplicates(docs: DataFrame, *, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """(doc_id, class_id, n_words): class_id is the smallest doc_id among the documents reached by links of at least ``similarity``.

    1. Documents with the same word sequence are represented by the smallest id; only representatives go on.
    2. In each band bucket every representative is compared with the bucket's smallest id (a star, not all pairs).
    3. Members of one bucket that are still in different components are compared too, in blocks and by counting shared
       shingles, except where their sizes, or by the metric 1 - similarity their distances to the star's centre, show
       that they can't be linked. A block gives at most one row a member. So every linked pair that shares a bucket
       ends in one class, whatever the size of its group.
    """
    spool = Spool(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    schema = "doc_id long, n_words long, ka long, kb long, bands array<long>"
    signed_docs = spool.cut(texts.mapInArrow(_sign(bands, rows, size), schema), "signed")
    if signed_docs.groupBy("doc_id").agg(F.min("ka").alias("lo"), F.max("ka").alias("hi")).where("lo < hi").limit(1).count():
        spool.drop("signed")
        out = _by_text(spool, texts, similarity=similarity, bands=bands, rows=rows, size=size)
    else:
        out = _classes(spool, texts, signed_docs, similarity, size)
    n_words = F.size(F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    nameless = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), n_words.alias("n_words"))
    return out.unionByName(nameless)


def _by_text(spool: Spool, texts: DataFrame, **params) -> DataFrame:
    """As ``near_duplicates`` where a doc_id has several texts: first for the texts, by numbers in order of doc_id, then for the documents."""
    each = texts.withColumn("th", F.xxhash64("text")).dropDuplicates(["doc_id", "th"]).orderBy("doc_id", "th")
    each = spool.cut(each.withColumn("number", F.monotonically_increasing_id()), "numbered")
    found = spool.cut(near_duplicates(each.select(F.col("number").alias("doc_id"), "text"), **params), "by_text")
    owner = each.select("number", F.col("doc_id").alias("owner"))
    named = found.withColumnRenamed("doc_id", "number").hint("merge").join(owner.hint("merge"), "number")
    first = owner.select(F.col("number").alias("class_id"), F.col("owner").alias("first"))
    named = spool.cut(named.hint("merge").join(first.hint("merge"), "class_id").select("owner", "first", "n_words"), "named")
    comp = components(spool, named.select(F.col("owner").alias("a"), F.col("first").alias("b")), "owners")
    held = named.groupBy(F.col("owner").alias("doc_id")).agg(F.min("n_words").alias("n_words"))
    return held.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("comp", "doc_id").alias("class_id"), "n_words")


def _classes(spool: Spool, texts: DataFrame, signed_docs: DataFrame, similarity: float, size: int) -> DataFrame:
    key = F.when(F.col("n_words") > 0, F.lit(0)).otherwise(F.col("doc_id"))
    ids = signed_docs.select("doc_id", "n_words", "ka", "kb", key.alias("kc"))
    first = spool.cut(ids.groupBy("ka", "kb", "kc").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "first")
    copies = first.where("rep < last").drop("last")
    keys = ["ka", "kb", "kc"]
    member = spool.cut(ids.hint("merge").join(copies.hint("merge"), keys, "left").select("doc_id", "n_words", F.coalesce("rep", "doc_id").alias("rep")), "member")
    later = spool.cut(member.where("doc_id <> rep").select("doc_id").distinct(), "later")
    exploded = signed_docs.select("doc_id", F.explode("bands").alias("band"))
    at_first = exploded.join(F.broadcast(later), "doc_id", "left_anti") if later.count() * 16 <= (4 << 20) else exploded.join(later.hint("merge"), "doc_id", "left_anti")
    at_first = spool.cut(at_first, "at_first")
    stars = spool.cut(at_first.groupBy("band").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("top")).where("a < top").select("band", "a"), "stars")
    seats = spool.cut(at_first.hint("merge").join(stars.hint("merge"), "band").select("band", "a", F.col("doc_id").alias("b")), "seats")
    spool.drop("at_first", "first", "stars")
    pairs = spool.cut(seats.where("a < b").groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b"), "pairs")
    wanted = spool.cut(seats.select(F.col("b").alias("doc_id")).distinct(), "wanted")
    held = spool.cut(keep_matching(texts, wanted, "doc_id").mapInArrow(_elements(size), "doc_id long, bag array<long>").dropDuplicates(["doc_id"]), "bags")
    known = spool.cut(_measured(pairs, held), "known")
    edges = known.where(F.col("s") >= similarity).select("a", "b")
    comp = components(spool, edges, "c1")
    # buckets whose members are not yet in one component
    placed = seats.hint("merge").join(comp.select(F.col("id").alias("b"), "comp").hint("merge"), "b", "left").select("band", "a", "b", F.coalesce("comp", "b").alias("comp"))
    placed = spool.cut(placed, "placed")
    mixed = spool.cut(placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count_if(F.col("a") != F.col("b")).alias("n")).where("lo < hi and n > 1").select("band"), "mixed")
    spool.drop("pairs", "seats", "wanted")
    if mixed.limit(1).count():
        open_seats = placed.where("a < b").hint("merge").join(mixed.hint("merge"), "band").join(known.hint("merge"), ["a", "b"])
        more = _compared(spool, open_seats.select("band", "b", "comp", (1 - F.col("s")).alias("d"), "z"), held, similarity)
        if more.limit(1).count():
            comp = components(spool, edges.unionByName(more), "c2")
    spool.drop("signed", "later", "bags", "known", "placed", "mixed", "more")
    classes = comp.select(F.col("id").alias("rep"), F.col("comp").alias("class_id"))
    out = member.hint("merge").join(classes.hint("merge"), "rep", "left").select("doc_id", F.coalesce("class_id", "rep").alias("class_id"), "n_words")
    return out.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("n_words").alias("n_words"))


def _compared(spool: Spool, open_seats: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between the members of buckets that are still in different components.

    A link needs distances to the star's centre that differ by 1 - similarity at most, and sizes of which the smaller is
    at least that share of the larger. So members are put in cells of these widths, and only a cell's own members and
    those of its neighbours are compared, in blocks, where they are not all of one component already. A member goes to
    as many tasks as its cell and the neighbours have blocks, before its shingles are looked up.
    """
    near, step = 1 - similarity + 1e-6, float(np.log(1 / similarity)) + 1e-6
    at = ["band", "db", "zb"]
    seats = spool.cut(open_seats.select("band", "b", "comp", "d", F.floor(F.col("d") / near).alias("db"), F.floor(F.ln(F.greatest("z", F.lit(1))) / step).alias("zb")), "open")
    cells = spool.cut(seats.groupBy(*at).agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")), "cells")
    blocks_of = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    step_to = F.explode(F.array(*(F.struct(F.lit(k).alias("off"), F.lit(y).alias("y"), F.lit(x).alias("x")) for k, (y, x) in enumerate(((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))))
    one = cells.select("*", step_to.alias("to")).select(*at, "n", "lo", "hi", "to.off", (F.col("db") + F.col("to.y")).alias("db2"), (F.col("zb") + F.col("to.x")).alias("zb2"))
    two = cells.select("band", F.col("db").alias("db2"), F.col("zb").alias("zb2"), F.col("n").alias("n2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = one.join(two, ["band", "db2", "zb2"]).where(F.least("lo", "lo2") < F.greatest("hi", "hi2"))
    pairs = spool.cut(pairs.select(*at, "off", "db2", "zb2", blocks_of("n").alias("m"), blocks_of("n2").alias("m2")), "cell_pairs")
    group = [*at, "off", "i", "j"]
    own = lambda m: F.pmod(F.xxhash64("b"), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    inner = seats.hint("merge").join(pairs.where("off = 0").hint("merge"), at).select(*at, "off", "b", "comp", "d", own("m").alias("own"), every("m").alias("other"))
    inner = inner.select(*at, "off", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "b", "comp", "d", "own")
    left = seats.hint("merge").join(pairs.where("off > 0").hint("merge"), at).select(*at, "off", own("m").alias("i"), every("m2").alias("j"), "b", "comp", "d", F.lit(0).alias("own"))
    other = seats.select("band", F.col("db").alias("db2"), F.col("zb").alias("zb2"), "b", "comp", "d")
    right = other.hint("merge").join(pairs.where("off > 0").hint("merge"), ["band", "db2", "zb2"]).select(*at, "off", every("m").alias("i"), own("m2").alias("j"), "b", "comp", "d", F.lit(1).alias("own"))
    dealt = inner.unionByName(left).unionByName(right).withColumn("cross", (F.col("off") > 0) | (F.col("i") != F.col("j")))
    bag = held.select(F.col("doc_id").alias("b"), "bag")
    more = dealt.hint("merge").join(bag.hint("merge"), "b").groupBy(*group).applyInArrow(_linked(similarity), "a long, b long")
    more = spool.cut(more.distinct(), "more")
    spool.drop("open", "cells", "cell_pairs")
    return more


def _measured(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b, s, z): the weighted Jaccard similarity of each pair, exact on shingle hashes, and the size of b's bag."""
    one = held.select(F.col("doc_id").alias("b"), F.col("bag").alias("bag_b")).hint("merge")
    two = held.select(F.col("doc_id").alias("a"), F.col("bag").alias("bag_a")).hint("merge")
    both = F.size(F.array_intersect("bag_a", "bag_b"))
    met = pairs.hint("merge").join(one, "b").join(two, "a")
    return met.select("a", "b", F.try_divide(both, F.size("bag_a") + F.size("bag_b") - both).alias("s"), F.size("bag_b").alias("z"))
