"""Column expressions: scores, identifiers, phases, scaling, vectors, label groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of each group; any other label is unclassified.
LABEL_GROUPS = {
    "planet_like": ["Pl", "Pl?", "BD*", "s*b"],
    "binary_star": ["SB*", "**", "EB*", "LM*"],
    "stellar": ["*", "PM*", "Er*"],
    "outlier": ["outlier", "err"],
}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(*columns) -> Column:
    """All columns are there and neither NaN nor infinite."""
    return reduce(lambda a, b: a & b, [col(c).isNotNull() & ~F.isnan(col(c)) & (F.abs(col(c)) < float("inf")) for c in columns])


def clean(c) -> Column:
    """NaN and infinities become null."""
    return F.when(finite(c), col(c))


def weighted_root_sum(a, b, wa: float = 0.8, wb: float = 0.2) -> Column:
    return F.lit(wa) * F.sqrt(col(a)) + F.lit(wb) * F.sqrt(col(b))


def min_max(x, low, high) -> Column:
    """(x - low) / (high - low); 0 where the range is empty."""
    return F.when(col(high) > col(low), (col(x) - col(low)) / (col(high) - col(low))).otherwise(F.lit(0.0))


def object_id(filename) -> Column:
    """The third part of a '-' separated name, without leading zeros, as a number."""
    return F.split_part(col(filename), F.lit("-"), F.lit(3)).try_cast("bigint")


def variant_number(name, letter: str, unit: str = "") -> Column:
    """The number after ``_<letter>`` in a model name such as x_n300_d23.75_c2_n50ppm; with a unit, that which it follows."""
    found = F.regexp_extract(col(name), f"_{letter}([0-9.]+){unit}(?:_|$|\\.)", 1)
    return F.when(found != "", found.cast("double"))


def phase(t, period, shift=0.0) -> Column:
    """Phase in [0, 1)."""
    p = col(period) if not isinstance(period, (int, float)) else F.lit(float(period))
    return F.pmod(F.pmod(col(t), p) / p - F.lit(float(shift)), F.lit(1.0))


def clip(x, low: float = -6.0, high: float = 3.0) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def box_transit(t, period: float, duration: float, depth: float, t0: float) -> Column:
    """Flux 1, less ``depth`` within half a duration of each transit."""
    away = F.abs(F.pmod(col(t) - t0 + period / 2, F.lit(float(period))) - period / 2)
    return F.when(away < duration / 2, F.lit(1.0 - depth)).otherwise(F.lit(1.0))


def label_group(label) -> Column:
    table = F.create_map(*[F.lit(x) for g, labels in LABEL_GROUPS.items() for name in labels for x in (name, g)])
    return F.coalesce(F.try_element_at(table, col(label)), F.lit("unclassified"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine of two vectors; 0 where one of them is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def pad_or_cut(v, size: int) -> Column:
    return F.slice(F.concat(col(v), F.array_repeat(F.lit(0.0), size)), 1, size)


def all_finite(v) -> Column:
    return F.forall(col(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def log_grid(low: float, high: float, n: int) -> Column:
    """n frequencies from low to high, evenly spaced in their logarithms."""
    a, b = F.log10(F.lit(low)), F.log10(F.lit(high))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pow(F.lit(10.0), a + i * (b - a) / F.lit(float(n - 1))))


def in_sector(sectors, sector: int) -> Column:
    """The sector is one of the comma-separated numbers; null is no."""
    return F.coalesce(col(sectors).rlike(rf"\b{sector}\b"), F.lit(False))


def truth(c) -> Column:
    """Text to boolean: yes, true, t, y, 1, on; no, false, f, n, 0, off; in any case. Anything else is an error, null stays."""
    word = F.lower(F.trim(col(c)))
    wrong = F.raise_error(F.concat(F.lit("not a truth value: "), col(c))).cast("boolean")
    return F.when(word.isin("yes", "true", "t", "y", "1", "on"), True).when(word.isin("no", "false", "f", "n", "0", "off"), False).when(word.isNotNull(), wrong)
