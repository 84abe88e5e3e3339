"""Boxes as Columns; a box is a struct x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


def area(a: Column) -> Column:
    return (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union > 0, intersection(a, b) / union).otherwise(0.0)


def inside_ratio(inner: Column, outer: Column) -> Column:
    return F.when(area(inner) > 0, intersection(inner, outer) / area(inner)).otherwise(0.0)


def _each(rows: Column, body: str) -> Column:
    """``transform`` with a lambda written in SQL, which is parsed at once where a formula of Columns takes a call for each of its terms."""
    return F.call_function("transform", rows, F.expr(body))


def _rounding(digits: int) -> tuple[str, str]:
    """The two steps of :func:`rounded` as lambdas, so that each value is computed once and named."""
    scale, part = float(10**digits), 134217729.0
    high = scale * part - (scale * part - scale)
    scale, part, high, low = (f"{x!r}D" for x in (scale, part, high, scale - high))
    big = f"(_v * {part} - (_v * {part} - _v))"
    halves = f"_v -> named_struct('v', _v, 'h', {big}, 'l', _v - {big}, 'p', _v * {scale}, 'f', cast(floor(_v * {scale}) as double))"
    over = f"((_h.p - (_h.f + 0.5D)) + (((_h.h * {high} - _h.p) + _h.h * {low} + _h.l * {high}) + _h.l * {low}))"
    nearest = f"_h -> CASE WHEN {over} > 0 OR ({over} = 0 AND _h.f % 2 <> 0) THEN _h.f + 1.0D ELSE _h.f END / {scale}"
    return halves, nearest


def rounded(x: Column, digits: int = 3) -> Column:
    """x to ``digits`` decimals as Python rounds: by the exact binary value, ties to even.

    Spark's own functions round the shortest decimal instead (0.1235 to
    0.124).  The product with 10 ** digits is taken exactly, as a sum of two
    doubles, so the comparison with the half has no error.
    """
    halves, nearest = _rounding(digits)
    return _each(_each(F.array(x.cast("double")), halves), nearest)[0]


def unit_box(a: Column, digits: int = 3) -> Column:
    """A box clamped to 0..1 and rounded; an empty side is widened by one step, inward at 1."""
    halves, nearest = _rounding(digits)
    near = lambda v: f"transform(transform(array(cast({v} AS double)), {halves}), {nearest})[0]"
    inner = [f"'{c}', " + near(f"least(greatest(_a.{c}, 0.0D), 1.0D)") for c in ("x0", "y0", "x1", "y1")]
    step = f"{10.0**-digits!r}D"
    lows = [f"'{k}0', CASE WHEN _b.{k}0 >= _b.{k}1 AND _b.{k}0 >= 1 THEN " + near(f"_b.{k}0 - {step}") + f" ELSE _b.{k}0 END" for k in "xy"]
    highs = [f"'{k}1', CASE WHEN _b.{k}0 >= _b.{k}1 AND _b.{k}0 < 1 THEN " + near(f"_b.{k}0 + {step}") + f" ELSE _b.{k}1 END" for k in "xy"]
    return _each(_each(F.array(a), f"_a -> named_struct({', '.join(inner)})"), f"_b -> named_struct({', '.join(lows + highs)})")[0]


def visible_point(x: Column, y: Column, frame: Column, rotation: Column) -> Column:
    """Page coordinates (origin bottom left) to the visible page, 0..1 from its top left."""
    u = (x - frame["x0"]) / (frame["x1"] - frame["x0"])
    v = (y - frame["y0"]) / (frame["y1"] - frame["y0"])
    px = F.when(rotation == 90, v).when(rotation == 180, 1 - u).when(rotation == 270, 1 - v).otherwise(u)
    py = F.when(rotation == 90, u).when(rotation == 180, v).when(rotation == 270, 1 - u).otherwise(1 - v)
    return F.struct(px.alias("x"), py.alias("y"))
