"""Substring dedup: passages of 50 or more words that recur across documents are found by repeated-phrase automata.

Words are ``[^\\x20\\x09-\\x0D]+``, compared unchanged; white space between them doesn't count. Null, empty and short
texts have no window and keep every word. Rows are told apart by doc_id and text: of one doc_id with several texts
each is judged on its own, and what recurs only under one doc_id is kept, as no smaller doc_id has it. Rows equal in
both get equal results. Rows with a null doc_id have no place in the order: they keep every word and take none from
others. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrowtext import Words, blocks, lists, mix, range_hash, signed
from tidemark.llm.spool import BROADCAST_BYTES, Spool

WINDOW = 50
#: Words of a phrase. Each window of WINDOW words holds at least one chosen phrase, whatever the text.
PHRASE = 8
#: Phrases of a shard (expected number) and of one automaton, and bytes of text that a shard's automaton reads in one task.
SHARD, AUTOMATON, TASK_BYTES = 32_000, 32_000, 8 << 20
#: Letters of each of the three alphabets that spell a word: DIGITS ** 3 is more than AUTOMATON * PHRASE.
DIGITS = 64
SPACE = r"[\x20\x09-\x0D]+"


def _slide(x: np.ndarray, size: int, best) -> np.ndarray:
    """best of x[i : i + size] for each i that has so many."""
    have = 1
    while have * 2 <= size:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (size - have)], x[size - have :]) if size > have else x


def chosen_phrases(words: Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, hash) of the phrases with the least hash of some window (winnowing)."""
    span = window - phrase + 1
    docs, at, hashes = words.windows(phrase)
    if len(hashes) < span:
        return docs[:0], at[:0], hashes[:0]
    least = _slide(hashes, span, np.minimum)
    whole = docs[: len(least)] == docs[span - 1 :]
    least = np.where(whole, least, np.uint64(0))
    pad = np.zeros(span - 1, np.uint64)
    chosen = _slide(np.concatenate([pad, least, pad]), span, np.maximum) == hashes
    return docs[chosen], at[chosen], hashes[chosen]


def _phrases(window: int, phrase: int):
    """Each text's words counted and hashed, and the hashes of its chosen phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            words = Words(data, offsets)
            docs, _, hashes = chosen_phrases(words, window, phrase)
            order = np.lexsort((hashes, docs))
            docs, hashes = docs[order], hashes[order]
            new = np.ones(len(docs), bool)
            new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
            a = range_hash(words.hashes, words.first[:-1], words.first[1:])
            b = range_hash(mix(words.hashes), words.first[:-1], words.first[1:])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(words.counts, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(signed(a)), pa.array(signed(b)),
                 lists(signed(hashes[new]), np.bincount(docs[new], minlength=len(words.counts)), pa.int64())],
                names=["doc_id", "th", "n_words", "n_bytes", "ka", "kb", "phrases"],
            )

    return run


def _spelt(window: int, phrase: int):
    """The words of the phrases that recur, from the texts they are first found in: (shard, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            words = Words(data, offsets)
            docs, at, hashes = chosen_phrases(words, window, phrase)
            asked = rows.column(rows.schema.get_field_index("phrases"))
            owner = np.repeat(np.arange(rows.num_rows, dtype=np.uint64), asked.value_lengths().to_numpy(zero_copy_only=False))
            wanted = np.unique(mix(asked.flatten().to_numpy(zero_copy_only=False).view(np.uint64)) + owner)
            here = mix(hashes) + docs.astype(np.uint64)
            hit = np.flatnonzero(np.isin(here, wanted))
            _, once = np.unique(here[hit], return_index=True)
            raw = data.tobytes()
            spans = [(words.starts[p : p + phrase].tolist(), words.ends[p : p + phrase].tolist()) for p in at[hit[once]].tolist()]
            spelt = [b" ".join(raw[s:e] for s, e in zip(*span, strict=True)) for span in spans]
            shard = rows.column(rows.schema.get_field_index("shard")).to_numpy(zero_copy_only=False)[docs[hit[once]]]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(spelt, pa.binary())], names=["shard", "words"])

    return run


def compiled(phrases: list[bytes]) -> tuple[ahocorasick.Automaton, dict[bytes, str]]:
    """An automaton over words, and how words are spelt in it.

    Every different word of the phrases is a number, written as three digits of alphabets of their own, so a match is one
    of whole words and no node has many children, which the library looks through one by one.
    """
    spelt: dict[bytes, str] = {}
    machine = ahocorasick.Automaton()
    for p in phrases:
        line = []
        for w in p.split(b" "):
            if w not in spelt:
                n = len(spelt)
                spelt[w] = chr(1 + n % DIGITS) + chr(1 + DIGITS + n // DIGITS % DIGITS) + chr(1 + 2 * DIGITS + n // DIGITS**2)
            line.append(spelt[w])
        machine.add_word("".join(line), True)
    if phrases:
        machine.make_automaton()
    return machine, spelt


def occurrences(machine: ahocorasick.Automaton, spelt: dict[bytes, str], words: list[bytes]) -> np.ndarray:
    """The last word of every occurrence."""
    line = [spelt.get(w, "\0") for w in words]
    ends = np.fromiter((e for e, _ in machine.iter("".join(line))), np.int64)
    return np.searchsorted(np.cumsum(np.fromiter(map(len, line), np.int64, len(line))), ends, "right") if len(ends) else ends


def _locate(window: int, phrase: int, automaton: int):
    """Compiles a shard's automata, streams the documents through them, and gives the hashes of the windows whose chosen phrase occurs there.

    A window that recurs has its chosen phrase, the one with the least hash, in one shard: it is given there and nowhere else.
    """
    span, none = window - phrase + 1, np.uint64(0xFFFFFFFFFFFFFFFF)

    def run(phrases: pa.Table, texts: pa.Table) -> pa.Table:
        every = sorted(set(phrases.column("words").to_pylist()))
        machines = [compiled(every[lo : lo + automaton]) for lo in range(0, len(every), automaton)]
        out = []
        for rows, data, offsets in blocks(iter(texts.to_batches())) if machines else ():
            words, raw = Words(data, offsets), data.tobytes()
            met = np.zeros(len(words.hashes), bool)
            for first, n, a, b in zip(words.first.tolist(), words.counts.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=False):
                if n >= window:
                    each = raw[a:b].split()
                    for machine, spelt in machines:
                        met[first + occurrences(machine, spelt, each) - (phrase - 1)] = True
            docs, at, hashes = words.windows(phrase)
            if len(hashes) < span:
                continue
            least = _slide(hashes, span, np.minimum)
            found = _slide(np.where(met[at], hashes, none), span, np.minimum) == least
            here = np.flatnonzero(found & (docs[: len(least)] == docs[span - 1 :]))
            starts, doc = at[here], docs[here]
            ids, th = (rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("doc_id", "th"))
            a = range_hash(words.hashes, starts, starts + window)
            b = range_hash(mix(words.hashes), starts, starts + window)
            out.append((ids[doc], th[doc], (starts - words.first[doc]).astype(np.int32), signed(a), (b >> np.uint64(32)).astype(np.uint32).view(np.int32)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 5
        kinds = {"doc_id": pa.int64(), "th": pa.int64(), "start": pa.int32(), "ha": pa.int64(), "hb": pa.int32()}
        return pa.table({k: pa.array(c, t) for (k, t), c in zip(kinds.items(), columns, strict=True)})

    return run


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): th tells apart the texts of one doc_id."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df.hint("merge")


def repeated_spans(docs: DataFrame, *, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, th, spans) of the texts that lose words: spans is an array of (first, last) word ranges, last excluded,
    that windows with a start in a smaller doc_id cover. A written table; join it to ``texts_of`` on doc_id and th.

    1. Whole copies: of documents with one word sequence only those of the smallest id go on; the others are covered in full.
    2. Chosen phrases whose hashes occur under two ids or more are recurring. Their words are read from the text of the
       smallest id, so that an occurrence elsewhere is one of the same words, not of the same hash.
    3. A phrase's shard goes by that smallest id: a passage's phrases share a shard. A document goes to the shards of
       its phrases, and a shard's documents are dealt over as many tasks as their bytes need, each with the shard's
       automaton; so a phrase that a third of the documents share is dealt with the documents, and the work grows with
       the text. (Every shard over every document would be shards x documents, the square of the input.)
    4. The automata locate every occurrence; the windows of which one is the chosen phrase are hashed to 96 bits, and
       each window's smallest document is a partially aggregated minimum.
    """
    spool = Spool(docs.sparkSession)
    texts = texts_of(docs).where("doc_id is not null")
    schema = "doc_id long, th long, n_words long, n_bytes long, ka long, kb long, phrases array<long>"
    signed_docs = spool.cut(texts.mapInArrow(_phrases(window, phrase), schema), "signed")
    keys, doc = ["ka", "kb"], ["doc_id", "th"]
    long_docs = signed_docs.where(F.col("n_words") >= window)
    first = spool.cut(long_docs.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")).where("rep < top").drop("top"), "first")
    copies = long_docs.select(*doc, "n_words", *keys).hint("merge").join(first.hint("merge"), keys).where("doc_id > rep")
    copies = spool.cut(copies.select(*doc, "n_words").distinct(), "copies")
    rows = long_docs.select(*doc, "n_bytes", F.explode("phrases").alias("phrase"))
    rows = spool.cut(rows.join(_small(copies.select(*doc), copies.count(), 24), doc, "left_anti"), "rows")
    recurring = spool.cut(rows.groupBy("phrase").agg(F.min("doc_id").alias("home"), F.max("doc_id").alias("hi")).where("home < hi").select("phrase", "home"), "recurring")
    shards = max(1, -(-recurring.count() // SHARD))
    shard = F.pmod(F.xxhash64("home"), F.lit(shards)).alias("shard")
    met = rows.hint("merge").join(recurring.hint("merge"), "phrase").select(*doc, "n_bytes", "phrase", shard, (F.col("doc_id") == F.col("home")).alias("is_home"))
    met = spool.cut(met, "met")
    spool.drop("rows", "recurring", "first", "signed")
    routes = spool.cut(met.select(*doc, "n_bytes", "shard").distinct(), "routes")
    loads = spool.cut(routes.groupBy("shard").agg(F.ceil(F.sum("n_bytes") / TASK_BYTES).cast("long").alias("tasks")).select("shard", F.greatest("tasks", F.lit(1)).alias("tasks")), "loads")
    homes = met.where("is_home").groupBy(*doc, "shard").agg(F.collect_set("phrase").alias("phrases"))
    phrases = texts.hint("merge").join(homes.hint("merge"), doc).select(*doc, "text", "shard", "phrases").mapInArrow(_spelt(window, phrase), "shard long, words binary")
    phrases = spool.cut(phrases, "phrases")
    dealt = _small(loads, shards, 16)
    asked = phrases.join(dealt, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), "words")
    routed = routes.join(dealt, "shard").select(*doc, "shard", F.pmod(F.xxhash64(*doc), F.col("tasks")).alias("task"))
    held = texts.hint("merge").join(routed.hint("merge"), doc).select("shard", "task", *doc, "text")
    group = ["shard", "task"]
    windows = asked.groupBy(*group).cogroup(held.groupBy(*group)).applyInArrow(_locate(window, phrase, AUTOMATON), "doc_id long, th long, start int, ha long, hb int")
    windows = spool.cut(windows, "windows")
    home = windows.groupBy("ha", "hb").agg(F.min("doc_id").alias("home"), F.max("doc_id").alias("top")).where("home < top").drop("top")
    home = spool.cut(home, "home")
    covered = windows.hint("merge").join(home.hint("merge"), ["ha", "hb"]).where("doc_id > home").select(*doc, "start")
    # starts that follow each other are one span: a run's length is found within the document's own sorted list
    starts = spool.cut(covered.groupBy(*doc).agg(F.array_sort(F.collect_set("start")).alias("starts")), "starts")
    spool.drop("met", "routes", "loads", "phrases", "windows", "home")
    heads = F.filter("starts", lambda s, i: (i == 0) | (F.element_at("starts", F.greatest(i, F.lit(1))) + window < s))
    tails = F.filter("starts", lambda s, i: (i == F.size("starts") - 1) | (F.element_at("starts", F.least(i + 2, F.size("starts"))) > s + window))
    spans = F.transform(F.arrays_zip(heads.alias("a"), tails.alias("b")), lambda x: F.struct(x["a"].alias("first"), (x["b"] + window).alias("last")))
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("last")))
    out = spool.cut(starts.select(*doc, spans.alias("spans")).unionByName(copies.select(*doc, whole.alias("spans"))), "spans")
    spool.drop("starts", "copies")
    return out


def with_spans(docs: DataFrame, spans: DataFrame, name: str = "spans") -> DataFrame:
    """Adds the spans, null where a text keeps every word. ``docs``: with doc_id and text; ``spans``: from ``repeated_spans``."""
    held = spans.agg(F.coalesce(F.sum(F.size("spans") * 8 + 24), F.lit(0)).alias("n")).first()["n"]
    left, right = docs.alias("l"), spans.alias("r")
    left, right = (left, F.broadcast(right)) if held <= BROADCAST_BYTES else (left.hint("merge"), right.hint("merge"))
    same = (F.col("l.doc_id").cast("long") == F.col("r.doc_id")) & (F.xxhash64(F.col("l.text").cast("string")) == F.col("r.th"))
    return left.join(right, same, "left").select("l.*", F.col("r.spans").alias(name))


def without(text: Column, spans: Column) -> Column:
    """The text's words outside its spans, joined by one space."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return F.array_join(F.filter(words, lambda _, i: ~F.exists(spans, lambda s: (s["first"] <= i) & (i < s["last"]))), " ")


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in blocks(batches):
        raw, at = data.tobytes(), rows.schema.get_field_index("spans")
        out, total, removed = [], [], []
        for a, b, cuts in zip(offsets[:-1].tolist(), offsets[1:].tolist(), rows.column(at).to_pylist(), strict=True):
            words = raw[a:b].split()
            total.append(len(words))
            for cut in sorted(cuts or [], key=lambda c: -c["first"]):
                del words[cut["first"] : cut["last"]]
            removed.append(total[-1] - len(words))
            out.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])


def kept_words(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256), one row a row: each text's words outside its spans, joined by one space."""
    joined = with_spans(texts_of(docs).drop("th"), spans)
    return joined.mapInArrow(_keep, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
