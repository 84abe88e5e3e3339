"""What a page's boxes mean to each other: hosts, titles, confirmations, covers, free runs, dashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.functions.geometry import area, box, inside_ratio, iou
from folioflow.operators.grouped import per_group_arrays

_SIDES = ("x0", "y0", "x1", "y1")


def _renamed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.select(*keys, F.col("box_id").alias(name), box().alias(f"_{name}"), *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in (*keys, "box_id", *_SIDES)])


def cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def meeting(a: DataFrame, b: DataFrame, keys: list[str], name_a: str, name_b: str, pad: float = 0.0, cell: float = 128.0) -> DataFrame:
    """Pairs of boxes of a page that overlap or touch, or would if those of ``a`` were ``pad`` higher on both sides.

    Boxes meet in the cells of the page that they cover, and a pair in the
    cell of its common upper left corner alone: on a page of many boxes the
    rows follow the boxes and their near neighbours, not all pairs.  Columns:
    keys, the ids under the names, boxes under _name, others under name_other.
    """

    def placed(df: DataFrame, name: str, pad: float) -> DataFrame:
        own = F.col(f"_{name}")
        at = _renamed(df, keys, name).withColumn("_bx", F.explode(cells(own["x0"], own["x1"], cell)))
        return at.withColumn("_by", F.explode(cells(own["y0"] - pad, own["y1"] + pad, cell)))

    own, other = F.col(f"_{name_a}"), F.col(f"_{name_b}")
    left, top = F.greatest(own["x0"], other["x0"]), F.greatest(own["y0"] - pad, other["y0"])
    corner = (F.floor(left / cell) == F.col("_bx")) & (F.floor(top / cell) == F.col("_by"))
    common = (left <= F.least(own["x1"], other["x1"])) & (top <= F.least(own["y1"] + pad, other["y1"]))
    return placed(a, name_a, pad).join(placed(b, name_b, 0.0), [*keys, "_bx", "_by"]).where(corner & common).drop("_bx", "_by")


def covered_share(lines: DataFrame, chars: DataFrame, keys: list[str]) -> DataFrame:
    """lines with covered: share of a line's x-span under visible glyphs whose centre lies in its height."""
    c = chars.where("NOT invisible").select(*keys, F.col("x0").alias("cx0"), F.col("x1").alias("cx1"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    band = 16.0  # lines and glyphs meet in bands of the page
    at = lines.withColumn("_by", F.explode(F.sequence(F.floor(F.col("y0") / band), F.floor(F.col("y1") / band))))
    met = at.join(c.withColumn("_by", F.floor(F.col("cy") / band)), [*keys, "_by"]).where("cy >= y0 AND cy <= y1").select(*keys, "line_id", "x0", "x1", F.greatest("cx0", "x0").alias("a"), F.least("cx1", "x1").alias("b")).where("b > a")
    w = W.partitionBy(*keys, "line_id").orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1)
    gain = F.greatest(F.col("b") - F.greatest("a", F.coalesce(F.max("b").over(w), F.col("a"))), F.lit(0.0))
    total = met.withColumn("g", gain).groupBy(*keys, "line_id").agg((F.sum("g") / F.first(F.col("x1") - F.col("x0"))).alias("covered"))
    return lines.join(total, [*keys, "line_id"], "left").fillna(0.0, ["covered"])


def edge_cover(edges: DataFrame, rules: DataFrame, keys: list[str], snap: float = 1.5) -> DataFrame:
    """edges (edge_id, axis, pos, lo, hi) with cover: share of the edge under rules of its axis within ``snap``."""
    r = rules.select(*keys, "axis", F.col("pos").alias("rp"), F.col("start").alias("rs"), F.col("end").alias("re"), F.explode(F.array(*[F.floor(F.col("pos") / 4) + d for d in (-1, 0, 1)])).alias("b"))
    met = edges.withColumn("b", F.floor(F.col("pos") / 4)).join(r, [*keys, "axis", "b"]).where(F.abs(F.col("rp") - F.col("pos")) <= snap)
    met = met.select(*keys, "edge_id", "lo", "hi", F.greatest("rs", "lo").alias("a"), F.least("re", "hi").alias("z")).where("z > a")
    w = W.partitionBy(*keys, "edge_id").orderBy("a", "z").rowsBetween(W.unboundedPreceding, -1)
    gain = F.greatest(F.col("z") - F.greatest("a", F.coalesce(F.max("z").over(w), F.col("a"))), F.lit(0.0))
    total = met.withColumn("g", gain).groupBy(*keys, "edge_id").agg((F.sum("g") / F.first(F.col("hi") - F.col("lo"))).alias("cover"))
    return edges.join(total, [*keys, "edge_id"], "left").fillna(0.0, ["cover"])


def photo_hosts(figures: DataFrame, photos: DataFrame, keys: list[str], inside: float = 0.8) -> DataFrame:
    """Each figure's photo (80 % inside it, the smallest such), and per photo the figure of the best score (smaller id on ties)."""
    j = meeting(figures, photos, keys, "figure", "photo").where(inside_ratio(F.col("_figure"), F.col("_photo")) >= inside)
    host = j.groupBy(*keys, "figure").agg(F.min_by(F.struct("photo", F.col("figure_score").alias("score")), F.struct(area(F.col("_photo")), "photo")).alias("h"))
    return host.groupBy(*keys, F.col("h.photo").alias("photo")).agg(F.max_by("figure", F.struct("h.score", -F.col("figure"))).alias("figure"))


def confirmed(tables: DataFrame, found: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Tables that a model box confirms by IoU."""
    hits = meeting(tables, found, keys, "t", "m").where(iou(F.col("_t"), F.col("_m")) >= least).select(*keys, F.col("t").alias("box_id")).distinct()
    return tables.join(hits, [*keys, "box_id"], "left_semi")


def inner_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes that do not strictly contain another box of the page."""
    holds = (F.col("_a.x0") <= F.col("_b.x0")) & (F.col("_a.y0") <= F.col("_b.y0")) & (F.col("_a.x1") >= F.col("_b.x1")) & (F.col("_a.y1") >= F.col("_b.y1")) & (area(F.col("_a")) > area(F.col("_b")))
    outer = meeting(boxes, boxes, keys, "a", "b").where((F.col("a") != F.col("b")) & holds).select(*keys, F.col("a").alias("box_id")).distinct()
    return boxes.join(outer, [*keys, "box_id"], "left_anti")


def _gap(a: str, b: str) -> Column:
    """Vertical distance of two boxes of which 30 % of the narrower overlap in x; null otherwise."""
    a, b = F.col(a), F.col(b)
    over = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    ok = over >= 0.3 * F.least(a["x1"] - a["x0"], b["x1"] - b["x0"])
    return F.when(ok, F.greatest(b["y0"] - a["y1"], a["y0"] - b["y1"], F.lit(0.0)))


def table_titles(captions: DataFrame, tables: DataFrame, figures: DataFrame, keys: list[str], most: float = 30.0) -> DataFrame:
    """Captions nearer to a table than to any figure (a tie goes to the table)."""
    near = lambda df, n: meeting(captions, df, keys, "caption", "o", most).groupBy(*keys, "caption").agg(F.min(_gap("_caption", "_o")).alias(n)).where(F.col(n) <= most)
    return near(tables, "t").join(near(figures, "f"), [*keys, "caption"], "left").where("f IS NULL OR t <= f").select(*keys, "caption", "t")


def free_runs(spans: DataFrame, keys: list[str], allowed: int, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Stretches between the first and the last end that at most ``allowed`` spans cover: keys, lo, hi."""
    ends = spans.select(*keys, F.explode(F.array(F.struct(F.col(lo).alias("at"), F.lit(1).alias("d")), F.struct(F.col(hi).alias("at"), F.lit(-1).alias("d")))).alias("e")).groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    w = W.partitionBy(*keys).orderBy("at")
    steps = ends.withColumn("n", F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("next", F.lead("at").over(w)).where("next IS NOT NULL")
    ok = steps.withColumn("ok", (F.col("n") <= allowed).cast("int")).withColumn("g", F.sum(F.lit(1) - F.col("ok")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return ok.where("ok = 1").groupBy(*keys, "g").agg(F.min("at").alias(lo), F.max("next").alias(hi)).drop("g")


def dash_runs(pos: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[float, float, float, int]]:
    """Rules (position, start, end, pieces) that dashes of one axis draw, from arrays sorted by position.

    A line of dashes holds steps of at most 0.5 and lies within 1 of its
    first; along it gaps of at most 2 join.  A rule takes two pieces, 2
    points of length, and a drift of at most 0.5 or 5 % of its length; its
    position is the mean.
    """
    jump = np.append(np.flatnonzero(np.diff(pos) > 0.5) + 1, len(pos))
    out, lo = [], 0
    while lo < len(pos):
        hi = int(min(jump[np.searchsorted(jump, lo, "right")], np.searchsorted(pos, pos[lo] + 1.0, "right")))
        order = lo + np.lexsort((end[lo:hi], start[lo:hi]))
        reach = np.maximum.accumulate(end[order])
        first = np.concatenate([[0], np.flatnonzero(start[order][1:] - reach[:-1] > 2.0) + 1])
        n = np.diff(np.append(first, len(order)))
        a, z = start[order][first], np.maximum.reduceat(end[order], first)
        drift = np.maximum.reduceat(pos[order], first) - np.minimum.reduceat(pos[order], first)
        for k in np.flatnonzero((n > 1) & (z - a >= 2.0) & (drift <= np.maximum(0.5, 0.05 * (z - a)))):
            own = pos[order][first[k] : first[k] + n[k]]
            out.append((float(own.sum() / n[k]), float(a[k]), float(z[k]), int(n[k])))
        lo = hi
    return out


def join_dashes(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Dashes (0.2 to 2 long) of an axis as rules (:func:`dash_runs`): keys, axis, pos, start, end, pieces."""
    number = lambda c: F.col(c).cast("double").alias(c)
    short = pieces.where("`end` - start >= 0.2 AND `end` - start < 2.0").select(*keys, "axis", *map(number, ("pos", "start", "end")))
    one = lambda g: [dict(zip(("pos", "start", "end", "pieces"), r)) for r in dash_runs(g["pos"], g["start"], g["end"])]
    return per_group_arrays(short, [*keys, "axis"], ["pos", "start", "end"], one, "pos double, start double, `end` double, pieces int")


def figure_kind(page_area: Column, glyphs: Column) -> Column:
    """Photo boxes: decor when a side is under 24 or the area under 2.5 % of the page, background when 50 glyphs lie on it."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return F.when((w < 24) | (h < 24) | (w * h < 0.025 * page_area), "decor").when(glyphs >= 50, "background").otherwise("photo")
