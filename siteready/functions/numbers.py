"""Number columns: exact half-even rounding of doubles, percent rounding that never crosses a gate, typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteready.dims import constants as K

_SPLIT = 134217729.0  # 2**27 + 1


def _halves(a: Column) -> tuple[Column, Column]:
    c = a * F.lit(_SPLIT)
    high = c - (c - a)
    return high, a - high


def round_half_even(x: Column, digits: int) -> Column:
    """x rounded to digits by its exact binary value, halves to even (2.675 -> 2.67, 0.125 -> 0.12).

    The scaled product is rounded once; when it reads as a half, the sign of the product's rounding error says on
    which side the exact value lies.
    """
    if digits == 0:
        return F.rint(x)
    scale = float(10 ** digits)
    q = x * F.lit(scale)
    nearest = F.rint(q)
    xh, xl = _halves(x)
    c = scale * _SPLIT
    sh = c - (c - scale)
    sl = scale - sh
    error = ((xh * F.lit(sh) - q) + xh * F.lit(sl) + xl * F.lit(sh)) + xl * F.lit(sl)
    tie = F.abs(q - nearest) == F.lit(0.5)
    exact = (F.when(tie & (error < 0), F.floor(q).cast("double"))
             .when(tie & (error > 0), F.ceil(q).cast("double"))
             .otherwise(nearest))
    return exact / F.lit(scale)


def tidy(x: Column) -> Column:
    """Four decimals; whole numbers stay whole by value."""
    return round_half_even(x, 4)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def finite(x: Column) -> Column:
    """x, or null when it is NaN or infinite."""
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(x.isNotNull() & ~bad, x)


def as_number(value_type: Column, num: Column, boolean: Column, allow_bool: Column | bool = False) -> Column:
    """The number of a union value: a boolean counts as 0/1 only where allow_bool says so."""
    allow = F.lit(allow_bool) if isinstance(allow_bool, bool) else allow_bool
    return (F.when(value_type == "number", finite(num))
            .when((value_type == "bool") & allow, boolean.cast("double")))


def map_key(value_type: Column, num: Column, boolean: Column, text: Column) -> Column:
    """The map key of a union value: booleans and 0/1 read true/false, other numbers as written, strings as they are."""
    whole = (num == F.floor(num)) & (F.abs(num) < F.lit(1e15))
    written = F.when(whole, num.cast("long").cast("string")).otherwise(num.cast("string"))
    return (F.when(value_type == "bool", boolean.cast("string"))
            .when((value_type == "number") & num.isin(0.0, 1.0), (num == 1.0).cast("string"))
            .when(value_type == "number", written)
            .when(value_type.isin("string", "enum"), text))


def truthy(value_type: Column, num: Column, boolean: Column, text: Column) -> Column:
    return (F.when(value_type == "bool", boolean)
            .when(value_type == "number", num != 0.0)
            .when(value_type.isin("string", "enum"), F.length(text) > 0))


def half_up(percent: Column) -> Column:
    """A percentage to the nearest whole, halves up."""
    return F.floor(percent + F.lit(0.5 + 1e-9))


def three_decimals(share: Column) -> Column:
    """A share to three decimals, rounded down where three decimals would read as another whole percent."""
    near = round_half_even(share, 3)
    return (F.when(half_up(near * 100) != half_up(share * 100), F.floor(share * 1000 + F.lit(1e-6)) / 1000)
            .otherwise(near))


def stored_share(coverage: Column, thresholds) -> Column:
    """three_decimals, rounded down where it would reach a threshold that the exact coverage missed."""
    near = three_decimals(coverage)
    crossed = F.lit(False)
    for t in thresholds:
        crossed = crossed | ((coverage + F.lit(K.TOLERANCE) < F.lit(t)) & (F.lit(t) <= near + F.lit(K.TOLERANCE)))
    return F.when(crossed, F.floor(coverage * 1000 + F.lit(1e-6)) / 1000).otherwise(near)


def format_share(value: Column, grades=tuple(K.GRADES.values()), gates=(K.MIN_COVERAGE, K.MIN_MAJOR_COVERAGE)) -> Column:
    """A share as a whole percentage, halves up; under a missed threshold rounded down, with one tenth under a gate."""
    percent = value * 100
    whole = half_up(percent)
    tenths = F.floor(percent * 10 + F.lit(1e-6))

    def missed(items):
        hit = F.lit(False)
        for t in items:
            hit = hit | ((value + F.lit(K.TOLERANCE) < F.lit(t)) & (F.lit(t) <= whole / 100 + F.lit(K.TOLERANCE)))
        return hit

    any_missed, gate_missed = missed((*grades, *gates)), missed(gates)
    tenth = F.concat(F.floor(tenths / 10).cast("string"), F.lit(","), (tenths % 10).cast("string"), F.lit(" %"))
    down = F.concat(F.floor(tenths / 10).cast("string"), F.lit(" %"))
    plain = F.concat(whole.cast("string"), F.lit(" %"))
    return (F.when(value.isNull(), F.lit("n/d"))
            .when(~any_missed, plain)
            .when((tenths % 10 != 0) & gate_missed, tenth)
            .otherwise(down))


def grade(coverage: Column, grades=None) -> Column:
    """The best grade whose minimum the exact coverage reaches."""
    out = None
    for name, minimum in sorted((grades or K.GRADES).items(), key=lambda g: -g[1]):
        hit = coverage + F.lit(K.TOLERANCE) >= F.lit(minimum)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def interpolate(x: Column, points) -> Column:
    """Piecewise-linear value of x over sorted (x, y) points, flat beyond both ends, as one CASE chain."""
    points = sorted(points)
    out = F.when(x <= F.lit(points[0][0]), F.lit(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(x <= F.lit(x1), F.lit(y0) + F.lit(y1 - y0) * (x - F.lit(x0)) / F.lit(x1 - x0))
    return F.when(x.isNotNull(), out.otherwise(F.lit(points[-1][1])))
