"""BPE encoding and decoding by a deterministic tokenization automaton compiled from the merges.

Null text is an empty text: no tokens. Any length and any characters are encoded; nothing is truncated. One row a row,
with its doc_id, null or repeated, as it stands. Of two merges that apply in one place the earlier in the file wins, as
in the library. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrowtext import lists
from tidemark.llm.spool import Spool

#: Entries a worker remembers before the older half is forgotten.
MEMO = 300_000
NEVER = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class TokenAutomaton:
    """States are "the last token was t"; an arc t -> u is there if u may follow t in the BPE form of some text.

    It starts as one state per base symbol with every arc. Each merge (a, b) -> c, in order of rank, adds one gadget:
    the state of a loses its arc b, a new state c starts with the arcs that b has at that time, and every state that
    has the arc a at that time gets the arc c. An arc's presence thus follows from the gadgets of its two ends, and
    ``removed`` walks them once and keeps the answer in the table. Of the ways to cut a word into tokens exactly one
    is a path.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.labels = {i: t for t, i in vocab.items()}
        size = max(vocab.values()) + 2
        self.start = size - 1
        self.born, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.gone: dict[int, int] = {}
        self.size = size
        for rank, (a, b) in enumerate(merges):
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.born[k], self.left[k], self.right[k] = rank, i, j
            self.gone[i * size + j] = rank
        self.inner = {t: i for t, i in vocab.items() if not suffix or not t.endswith(suffix)}
        self.final = {t[: len(t) - len(suffix)]: i for t, i in vocab.items() if suffix and t.endswith(suffix)} if suffix else self.inner
        self.reach = _reach(self.inner)
        self.reach_final = self.reach if self.final is self.inner else _reach(self.final)
        self.arcs: dict[int, int] = {}
        self.forget()

    def forget(self) -> None:
        """Starts the transducer's tables anew: state 0 is the empty prefix."""
        self.step: dict[int, int] = {}
        self.last, self.back = [self.start], [0]

    def removed(self, p: int, y: int) -> int:
        """The rank of the gadget that takes arc y from state p; -1 if the arc was never there; NEVER if it stays."""
        key = p * self.size + y
        known = self.arcs.get(key)
        if known is not None:
            return known
        born_p, born_y = self.born[p], self.born[y]
        there = True
        if p == y and born_p >= 0:
            there = self.removed(self.right[p], self.left[y]) >= born_p
        elif born_p > born_y:
            there = self.removed(self.right[p], y) >= born_p
        elif born_y > born_p:
            there = self.removed(p, self.left[y]) > born_y
        out = self.gone.get(key, NEVER) if there else -1
        self.arcs[key] = out
        return out

    def _enter(self, word: str, end: int, path: list[int], table: dict[str, int], reach: dict[str, int]) -> tuple[int, int]:
        """The one token that can end at ``end`` after a path over what precedes it, and the state before it."""
        arcs, last, size, removed = self.arcs, self.last, self.size, self.removed
        for k in range(1, min(end, reach.get(word[max(end - 2, 0) : end], 1)) + 1):
            token = table.get(word[end - k : end])
            if token is not None:
                if k == end:
                    return token, 0
                before = last[path[end - k]]
                found = arcs.get(before * size + token)
                if (removed(before, token) if found is None else found) == NEVER:
                    return token, path[end - k]
        raise KeyError(word)

    def encode(self, word: str) -> list[int]:
        """The token ids of one pre-split word in the byte alphabet, by one table step a symbol.

        A state of the transducer is a prefix with the one path over it, kept as its last token and the state before
        that; a step not yet in the table is made from the arcs and entered, so the table holds what the texts need.
        """
        if len(self.last) > 4 * MEMO:
            self.forget()
        if len(self.arcs) > 8 * MEMO:
            self.arcs.clear()
        step, last, back, node, path, n = self.step, self.last, self.back, 0, [0], len(word)
        for end in range(1, n):
            key = node << 11 | ord(word[end - 1])
            node = step.get(key)
            if node is None:
                token, before = self._enter(word, end, path, self.inner, self.reach)
                node = step[key] = len(last)
                last.append(token)
                back.append(before)
            path.append(node)
        token, node = self._enter(word, n, path, self.final, self.reach_final)
        out = [token]
        while node:
            out.append(last[node])
            node = back[node]
        out.reverse()
        return out


def _reach(table: dict[str, int]) -> dict[str, int]:
    """The length of the longest token for each last two symbols."""
    out: dict[str, int] = {}
    for token in table:
        out[token[-2:]] = max(len(token), out.get(token[-2:], 1))
    return out


class WordEncoder:
    """A tokenizer of the file's kind: lower case, words split at white space, ends of words marked.

    ``pairs(text)`` gives ("ids joined by a space", "labels joined by a space") for each white-space chunk.
    """

    SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
    SEPARATORS = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.machine = TokenAutomaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.alphabet = byte_alphabet()
        self.special = {t["content"]: str(t["id"]) for t in spec["added_tokens"] if t["special"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.labels = self.machine.labels | {int(i): t for t, i in self.special.items()}
        self.new: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}

    def _chunk(self, chunk: str) -> tuple[str, str]:
        known = self.old.get(chunk)
        if known is None:
            text = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
            text = text.replace("Σ", "σ").lower()
            core = text.rstrip(".,!?")
            if core.isalpha():
                parts = [core, text[len(core) :]] if len(core) < len(text) else [text]
            else:
                parts = self.pattern.findall(text)
            ids = [i for p in parts for i in self.machine.encode("".join(map(self.alphabet.__getitem__, p.encode())))]
            known = " ".join(map(str, ids)), " ".join(map(self.machine.labels.__getitem__, ids))
        if len(self.new) >= MEMO:
            self.old, self.new = self.new, {}
        self.new[chunk] = known
        return known

    def pairs(self, text: str) -> list[tuple[str, str]]:
        if self.cut and "<|" in text and self.cut.search(text):
            return [x for p in self.cut.split(text) for x in ([(self.special[p], p)] if p in self.special else self.pairs(p))]
        chunks = [c for c in self.SPACE.split(text) if c] if self.SEPARATORS.search(text) else text.split()
        get, chunk = self.new.get, self._chunk
        found = list(map(get, chunks))
        if None in found:
            found = [p or chunk(c) for p, c in zip(found, chunks, strict=True)]
        return found

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _ in self.pairs(text or "") for i in ids.split(" ") if i]

    def decode(self, ids: list[int]) -> str:
        """Emits the arc labels of a path."""
        return " ".join(self.labels[i] for i in ids)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, so that its automaton and memory serve all tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _each(docs: DataFrame, schema: str, make: Callable[[Iterator[str | None]], list[pa.Array]]) -> DataFrame:
    Spool(docs.sparkSession)
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([rows.column(0), *make(x.as_py() for x in rows.column(1))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of each row, in the input's rows and partitions."""

    def make(texts: Iterator[str | None]) -> list[pa.Array]:
        codec = encoder(path)
        rows = [codec.encode(t) for t in texts]
        flat = np.array([i for r in rows for i in r], np.int32)
        return [lists(flat, np.array([len(r) for r in rows], np.int64), pa.int32()), pa.array([codec.decode(r) for r in rows], pa.string())]

    return _each(docs, "doc_id long, ids array<int>, decoded string", make)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of what ``encode_documents`` gives, made where the ids are."""

    def make(texts: Iterator[str | None]) -> list[pa.Array]:
        codec, n, a, b = encoder(path), [], [], []
        for text in texts:
            pairs = codec.pairs(text or "")
            ids = " ".join([p[0] for p in pairs])
            n.append(ids.count(" ") + 1 if ids else 0)
            a.append(hashlib.sha256(ids.encode()).hexdigest())
            b.append(hashlib.sha256(" ".join([p[1] for p in pairs]).encode()).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    return _each(docs, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
