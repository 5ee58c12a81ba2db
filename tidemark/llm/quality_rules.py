"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are masks applied to the stored bits.

DataFrame functions only. Null text counts as an empty text. Words are ``[^\\x20\\x09-\\x0D]+``. One row a row, with its
doc_id, null or repeated, as it stands; a rule at its limit doesn't fail. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Repeated windows up to which they are looked up one by one; beyond, positions are found by sorting.
FEW = 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column, size: int = 3) -> Column:
    """How many words lie in a ``size``-word window that occurs twice or more in the array."""

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(size), F.coalesce(F.get(at, k + 1), p + size) - p))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda n, s: n + s)

    def by_sorting(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s: lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
        return let(pairs, lambda s: F.array_sort(F.transform(F.filter(s, same(s)), lambda x: x["i"])))

    def positions(hashes: Column) -> Column:
        twice = let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.get(s, k - 1) == x)))
        one_by_one = lambda d: F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(d, h), i)), lambda i: i.isNotNull())
        return let(twice, lambda d: F.when(F.size(d) == 0, F.array().cast("array<int>")).when(F.size(d) <= FEW, one_by_one(d)).otherwise(by_sorting(hashes)))

    starts = F.slice(words, 1, F.greatest(F.size(words) - (size - 1), F.lit(0)))
    hashes = F.transform(starts, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, size))))
    return let(let(hashes, positions), covered)


def measures(text: Column) -> dict[str, Column]:
    """Measurements by name; ``words`` must be bound by ``let`` or a column."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_upper": (F.length(text) - F.length(F.regexp_replace(text, r"[A-ZÀ-ÖØ-Þ]+", ""))).cast("long"),
        "lines": let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"))),
        "words": let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))),
    }


#: Bit i of the ledger is set where rule i fails.
RULES: dict[str, Column | str] = {
    "too_few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines",
    "short_words": "10 * word_chars < 15 * n_words",
    "long_words": "word_chars > 40 * n_words",
    "capitals": "2 * n_upper > word_chars",
}
BASE = ("too_few_words", "repeated_words")
#: Versions of the policy: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {"v1": BASE, "v2": (*BASE, "symbols", "repeated_lines"), "v3": tuple(RULES)}
CURRENT = "v3"


def mask(names: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(n) for n in names)


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, failed): one row a document, one pass, no shuffle."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(k) for k, c in measures(text).items()))
    flat = found.select("doc_id", "words.*", "n_symbols", "lines.*", "n_upper")
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.expr(r), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(RULES.values())))
    return flat.withColumn("failed", bits)


def verdict(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds kept: no rule of the policy failed."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)


def ablations(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """(rule, n_failed, n_only, n_kept_without): what each rule of the policy rejects, rejects alone, and what stays without it.

    Documents are first counted by their bits, at most 2 ** rules groups, so only counts are looked at again.
    """
    names = POLICIES[policy]
    whole = mask(names)
    groups = entries.groupBy(F.col("failed").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(mask((n,))).cast("long").alias("bit")) for n in names)))
    each = groups.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return each.groupBy("rule").agg(
        some(F.expr("(bits & bit) <> 0")).alias("n_failed"),
        some(F.expr("bits = bit")).alias("n_only"),
        some(F.expr("(bits & ~bit) = 0")).alias("n_kept_without"),
    )


ORACLE = r"""
with w as (
  select doc_id, coalesce(text, '') t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) ls
  from documents),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] k from (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from w)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) c from g) where c > 1),
cov as (select doc_id, count(distinct p) n from (select doc_id, unnest([i, i + 1, i + 2]) p from r) group by doc_id),
m as (
  select w.doc_id, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
         (length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '', 'g')))::bigint n_upper,
         len(ls)::bigint n_lines, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(cov.n, 0)::bigint n_repeat_words
  from w left join cov on cov.doc_id = w.doc_id),
f as (
  select *, ((n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint + 4 * (10 * n_symbols > 3 * n_words)::bigint
    + 8 * (n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines)::bigint + 16 * (10 * word_chars < 15 * n_words)::bigint
    + 32 * (word_chars > 40 * n_words)::bigint + 64 * (2 * n_upper > word_chars)::bigint)::bigint failed
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed, (failed & 3) <> 0 base_failed, failed = 0 kept from f
"""
