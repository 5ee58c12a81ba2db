"""Column expressions: mathematics, circular arithmetic, codes and strings. None needs Python on the executors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi


def circ_wrap(a: Column, period: float = TAU) -> Column:
    """To [-period/2, period/2)."""
    return F.pmod(a + period / 2, F.lit(float(period))) - period / 2


def circ_add(a: Column, b: Column, period: float = TAU) -> Column:
    return circ_wrap(a + b, period)


def circ_subtract(a: Column, b: Column, period: float = TAU) -> Column:
    return circ_wrap(a - b, period)


def gaussian(x: Column, mu: float = 0, sigma: float = 1) -> Column:
    return F.exp(-F.pow((x - mu) / sigma, 2) / 2) / (sigma * math.sqrt(TAU))


def logistic(x: Column, a: float = 0, k: float = 1, b: float = 1, v: float = 1, q: float = 1, c: float = 1, mu: float = 0) -> Column:
    """Generalised logistic function."""
    return a + (k - a) / F.pow(c + q * F.exp(-b * (x - mu)), 1 / v)


def linex(x: Column, mu: float = 1, a: float = 1, b: float = 1, c: float = 1, d: float = 1, e: float = 1, f: float = 1, g: float = 1) -> Column:
    """Linear-exponential loss about mu: a (b exp(c u)^d - e u^f - 1)^g with u = x - mu."""
    u = x - mu
    return a * F.pow(b * F.exp(c * d * u) - e * F.pow(u, F.lit(float(f))) - 1, F.lit(float(g)))


def log_spaced(i: Column, start: float, stop: float, n: int) -> Column:
    return F.exp(math.log(start) + i * (math.log(stop) - math.log(start)) / max(1, n - 1))


def polar_to_cartesian(r: Column, angle: Column) -> Column:
    return F.struct((r * F.cos(angle)).alias("re"), (r * F.sin(angle)).alias("im"))


def cartesian_to_polar(re: Column, im: Column) -> Column:
    return F.struct(F.hypot(re, im).alias("r"), F.atan2(im, re).alias("angle"))


def rotation(angle: Column) -> Column:
    return F.array(F.array(F.cos(angle), -F.sin(angle)), F.array(F.sin(angle), F.cos(angle)))


def szudzik(a: Column, b: Column) -> Column:
    """A pair of non-negative integers as one."""
    return F.when(a >= b, a * a + a + b).otherwise(a + b * b).cast("long")


def szudzik_pair(z: Column) -> Column:
    """The inverse, exact below 2 ** 52."""
    s = F.floor(F.sqrt(z)).cast("long")
    low = z - s * s
    return F.struct(F.when(low < s, low).otherwise(s).alias("a"), F.when(low < s, s).otherwise(low - s).alias("b"))


def make_odd(n: Column, up: bool = True) -> Column:
    return F.when(F.pmod(n, F.lit(2)) == 0, n + (1 if up else -1)).otherwise(n)


def make_even(n: Column, up: bool = True) -> Column:
    return F.when(F.pmod(n, F.lit(2)) != 0, n + (1 if up else -1)).otherwise(n)


def convert_size(n_bytes: Column, unit: str = "GB") -> Column:
    return n_bytes / 1000.0 ** (["B", "KB", "MB", "GB", "TB"].index(unit))


def numbers_in(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+\.?\d*)"), F.lit(1)), lambda x: x.cast("double"))


def digits_of(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).try_cast("long")


def escape_spaces(path: Column) -> Column:
    return F.replace(path, F.lit(" "), F.lit("\\ "))


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def is_hex(s: Column) -> Column:
    return s.rlike("^([0-9a-fA-F]{2})*$")


# fixed values: the date forms in order of preference; separators are any character but a digit
DATES = (r"\d{8}", *(rf"\d{{{a}}}\D\d{{{b}}}\D\d{{{c}}}" for a, b, c in ((4, 2, 2), (2, 2, 4), (1, 1, 4), (1, 2, 4), (2, 1, 4), (2, 2, 2), (1, 1, 2), (1, 2, 2), (2, 1, 2))))


def date_in_path(path: Column, last_part_first: bool = True, forms: tuple[str, ...] = DATES) -> Column:
    """The date of the first path part that has one, the last part first by default: of the first form found there, its last occurrence."""
    parts = F.split(path, "/")
    parts = F.reverse(parts) if last_part_first else parts
    last = lambda p, d: F.try_element_at(F.regexp_extract_all(p, F.lit(f"({d})"), F.lit(1)), F.lit(-1))
    return F.get(F.filter(F.transform(parts, lambda p: F.coalesce(*(last(p, d) for d in forms))), lambda x: x.isNotNull()), F.lit(0))


def similarity_to_distance(s: Column, kind: int = 1, a: float = 1, b: float = 0, eps: float = 0) -> Column:
    """A similarity as a distance: 1 reciprocal, 2 exponential, 3 arc tangent, 4 difference, 5 root, 6 logarithm; eps is added."""
    power = lambda x: F.pow(x, F.lit(float(a)))
    forms = {
        1: lambda: F.try_divide(F.lit(b + 1.0), power(s)) - 1, 2: lambda: F.exp(power(b - s)), 3: lambda: F.atan(a * (b - s)),
        4: lambda: b - power(s), 5: lambda: power(F.sqrt(1 - (s + b))), 6: lambda: -F.ln(s * a + b),
    }
    return forms[kind]() + eps
