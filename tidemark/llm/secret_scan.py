"""Secret scans by multipart credential linking, with DataFrame functions only.

Positions are code points of the text; null text is empty. Every row is judged by its own text, whatever its doc_id,
null ids and repeated ones included; rows equal in doc_id and text get equal results. Spans are ordered by start, those
of one start by kind. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.spool import BROADCAST_BYTES, Spool

#: Parts of one credential start within so many code points of each other.
SCOPE = 400
_NAME = r"(?i:password|passwd|secret|token|api_?key)"
# fixed values: the base patterns; a run of 16 and more is what is left of the runs
ASSIGN = _NAME + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Parts that are reported only together with others.
WEAK_ACCESS = r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{6,13}(?![A-Za-z0-9])|(?:ASIA|AIDA|AROA)[A-Z0-9]{12,20}(?![A-Za-z0-9]))"
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{32,64}={0,2}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s\"'<>|]+|[a-z0-9.-]+\.amazonaws\.com"
KINDS = ("assign", "access", "hex", "weak_assign", "weak_access", "weak_secret", "endpoint")


def _runs(text: Column, pattern: str, when: Column, group: int = 0) -> Column:
    """For each match its length, the length of the group, and that of the text since the match before; null where ``when`` is false."""
    lengths = lambda a: F.transform(a, lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(lengths(F.split(text, pattern, -1)).alias("gap"), lengths(found).alias("size"), lengths(value).alias("value"))
    return F.when(when & text.rlike(pattern), F.filter(zipped, lambda x: x["size"].isNotNull()))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, h, assign, access, hex, weak_access, weak_secret, endpoint): runs of each pattern; h tells apart texts of one doc_id."""
    text = F.col("text")
    low = F.lower(text)
    named = reduce(lambda a, b: a | b, (low.contains(w) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    akia = text.contains("AKIA")
    some = base.withColumn("named", named).withColumn("akia", akia)
    part = F.col("named") | F.col("akia") | text.rlike("(?:ASIA|AIDA|AROA)[A-Z0-9]")
    return some.select(
        "doc_id",
        F.xxhash64("text").alias("h"),
        _runs(text, ASSIGN, F.col("named"), 1).alias("assign"),
        _runs(text, ACCESS, F.col("akia")).alias("access"),
        _runs(text, HEX, F.lit(True)).alias("hex"),
        _runs(text, WEAK_ACCESS, part).alias("weak_access"),
        _runs(text, WEAK_SECRET, part).alias("weak_secret"),
        _runs(text, ENDPOINT, part).alias("endpoint"),
    )


def located(scanned: DataFrame) -> DataFrame:
    """(doc_id, h, kind, start, end): every part, strong or weak. A document's runs are summed up in one window."""
    columns = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
    runs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("runs")) for k in columns))
    each = scanned.select("doc_id", "h", F.explode(F.filter(runs, lambda r: F.size(r["runs"]) > 0)).alias("r"))
    each = each.select("doc_id", "h", "r.kind", F.posexplode("r.runs").alias("at", "run"))
    order = Window.partitionBy("doc_id", "h", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("run.gap") + F.col("run.size")).over(order)
    placed = each.select("doc_id", "h", "kind", end.alias("end"), F.col("run.size").alias("size"), F.col("run.value").alias("value"))
    weak = (F.col("kind") == "assign") & (F.col("value") < 12)
    placed = placed.where(~(weak & (F.col("value") < 6))).withColumn("kind", F.when(weak, F.lit("weak_assign")).otherwise(F.col("kind")))
    return placed.select("doc_id", "h", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def linked(parts: DataFrame) -> DataFrame:
    """The weak parts that have their complements within SCOPE: (doc_id, h, kind, start, end).

    Weak secrets and weak assignments need an access identifier, weak identifiers a secret, endpoints both. The interval
    join is an equi-join on cells of SCOPE code points: of a cell only the first and last start of each role matter, so
    a text full of parts gives three rows a weak part and never pairs.
    """
    role = (
        F.when(F.col("kind").isin("access", "weak_access"), "access")
        .when(F.col("kind").isin("assign", "weak_assign", "weak_secret"), "secret")
    )
    cell = F.floor(F.col("start") / SCOPE)
    held = parts.select("doc_id", "h", cell.alias("cell"), role.alias("role"), "start").where("role is not null")
    ends = lambda r: [f(F.when(F.col("role") == r, F.col("start"))).alias(f"{r}_{n}") for f, n in ((F.min, "lo"), (F.max, "hi"))]
    cells = held.groupBy("doc_id", "h", "cell").agg(*ends("access"), *ends("secret"))
    weak = parts.where(F.col("kind").isin("weak_assign", "weak_access", "weak_secret", "endpoint"))
    near = weak.select("*", cell.alias("own"), F.explode(F.sequence(cell - 1, cell + 1)).alias("cell"))
    within = lambda r: F.coalesce(
        ((F.col("cell") == F.col("own")) & F.col(f"{r}_lo").isNotNull())
        | (F.abs(F.col(f"{r}_lo") - F.col("start")) <= SCOPE) | (F.abs(F.col(f"{r}_hi") - F.col("start")) <= SCOPE), F.lit(False))
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.h") == F.col("r.h")) & (F.col("l.cell") == F.col("r.cell"))
    joined = near.alias("l").join(cells.alias("r"), same).select("l.*", *(f"r.{r}_{n}" for r in ("access", "secret") for n in ("lo", "hi")))
    met = joined.groupBy("doc_id", "h", "kind", "start", "end").agg(F.max(within("access")).alias("access"), F.max(within("secret")).alias("secret"))
    need = F.when(F.col("kind") == "endpoint", F.col("access") & F.col("secret")).when(F.col("kind") == "weak_access", F.col("secret")).otherwise(F.col("access"))
    return met.where(need).select("doc_id", "h", "kind", "start", "end")


def hits(docs: DataFrame) -> DataFrame:
    """(doc_id, h, found) of the texts in which something is found: an array of (start, rank, end, kind) in order of start, then of KINDS. A written table."""
    spool = Spool(docs.sparkSession)
    scanned = spool.cut(scan(docs), "scanned")  # written first, as the filter would otherwise run the patterns once more
    some = scanned.where(F.greatest(*(F.coalesce(F.size(c), F.lit(0)) for c in scanned.columns[2:])) > 0).dropDuplicates(["doc_id", "h"])
    parts = spool.cut(located(some), "parts")
    strong = parts.where(F.col("kind").isin(*KINDS[:3]))
    every = strong.unionByName(linked(parts)).distinct()
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    found = every.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("found"))
    found = spool.cut(found, "found")
    spool.drop("scanned", "parts")
    return found


def with_found(docs: DataFrame, hits: DataFrame, name: str = "found") -> DataFrame:
    """Adds what ``hits`` has for each row's doc_id and text, null where nothing is found."""
    held = hits.agg(F.coalesce(F.sum(F.size("found") * 40 + 32), F.lit(0)).alias("n")).first()["n"]
    left, right = docs.alias("l"), hits.alias("r")
    left, right = (left, F.broadcast(right)) if held <= BROADCAST_BYTES else (left.hint("merge"), right.hint("merge"))
    h = F.xxhash64(F.coalesce(F.col("l.text").cast("string"), F.lit("")))
    return left.join(right, F.col("l.doc_id").cast("long").eqNullSafe(F.col("r.doc_id")) & (h == F.col("r.h")), "left").select("l.*", F.col("r.found").alias(name))


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, found), one row a row; found is empty where nothing is found."""
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    each = with_found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), hits(docs))
    return each.select("doc_id", F.coalesce("found", empty).alias("found"))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every found span, overlapping ones joined, replaced by the mark."""
    # the text before a span is kept from the furthest end of the spans before it
    done = lambda k: F.coalesce(F.array_max(F.transform(F.slice(found, 1, k), lambda x: x["end"])), F.lit(0))
    piece = lambda x, k: F.when(x["start"] >= done(k), F.concat(F.substring(text, done(k) + 1, x["start"] - done(k)), F.lit(mark))).otherwise("")
    last = F.array_max(F.transform(found, lambda x: x["end"]))
    joined = F.concat(F.array_join(F.transform(found, piece), ""), F.substring(text, last + 1, F.length(text)))
    return F.when(F.size(found) == 0, text).otherwise(joined)
