"""From what a page draws to tables: rules of paths, coverage of images, characters of code units, reading directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import config as C
from folioflow.functions.geometry import rounded, visible_point
from folioflow.operators.planning import join_dashes


#: Names of Korean fonts, and characters of Hangul (fixed patterns).
KOREAN_FONT = (
    r"(?i)(?:^|\+)(?-i:HY|HCR)|batang|gulim|dotum|gungs(?:uh|eo)|malgun|nanum|hamchorom|myeongjo|myungjo|kopub|spoqa"
    r"|pretendard|applesd|noto\s*-?\s*(?:sans|serif)\s*-?\s*(?:cjk\s*-?\s*)?kr|source\s*han\s*(?:sans|serif)\s*-?\s*k"
    r"|uniks|\bksc|korea1|함초롬|한컴|바탕|굴림|돋움|궁서|맑은|명조|고딕"
)
HANGUL = "^[\u1100-\u11ff\u3130-\u318f\ua960-\ua97f\uac00-\ud7a3\ud7b0-\ud7ff]"


def visible_color(rgba: Column) -> Column:
    """Whether a colour (array of 0..255) shows on white paper; unknown colours do."""
    return F.coalesce((rgba[3] > 0) & (F.least(rgba[0], rgba[1], rgba[2]) < C.WHITE), F.lit(True))


def _rule(axis: str, pos: Column, start: Column, end: Column, fill: bool = False) -> Column:
    return F.struct(F.lit(axis).alias("axis"), pos.alias("pos"), start.alias("start"), end.alias("end"), F.lit(fill).alias("fill"))


def _edge(e: Column) -> Column:
    """A straight edge as a rule; null when it is slanted or a dot."""
    dx, dy = F.abs(e["q"]["x"] - e["p"]["x"]), F.abs(e["q"]["y"] - e["p"]["y"])
    mid = lambda c: (e["p"][c] + e["q"][c]) / 2
    low, high = lambda c: F.least(e["p"][c], e["q"][c]), lambda c: F.greatest(e["p"][c], e["q"][c])
    flat = (dy <= C.AXIS_TOL) & (dx >= C.DASH - C.LEN_EPS) & (dy < dx)
    steep = (dx <= C.AXIS_TOL) & (dy >= C.DASH - C.LEN_EPS) & (dx < dy)
    return F.when(flat, _rule("h", mid("y"), low("x"), high("x"))).when(steep, _rule("v", mid("x"), low("y"), high("y")))


def _ring(points: Column) -> Column:
    """Pairs of neighbouring points, the last with the first."""
    return F.transform(points, lambda p, i: F.struct(p.alias("p"), F.get(points, (i + 1) % F.size(points)).alias("q")))


def subpath_rules(paths: DataFrame) -> DataFrame:
    """Subpaths with ``rules``: straight edges of what is stroked, and what filled rectangles amount to.

    paths: points (array of x, y and line: whether a line leads to the
    point), closed, curved, stroked, filled, parts (subpaths of the path).  A
    filled rectangle up to 2.5 thin is the line in its middle (both ways if
    it is a square dot), a wider one its four sides, as filling unless the
    path has several parts (then it is a border).
    """
    pts, tol = F.col("points"), C.AXIS_TOL
    n = F.size(pts)
    steps = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i < n) & F.coalesce(F.get(pts, i)["line"], F.lit(False))), lambda i: F.struct(F.get(pts, i - 1).alias("p"), F.get(pts, i).alias("q")))
    first, last = F.get(pts, F.lit(0)), F.get(pts, n - 1)
    back = F.when(F.col("closed") & ((first["x"] != last["x"]) | (first["y"] != last["y"])), F.array(F.struct(last.alias("p"), first.alias("q"))))
    edges = F.concat(steps, F.coalesce(back, F.array().cast(_kind(paths))))
    side = lambda c: F.transform(pts, lambda p: p[c])
    df = paths.withColumn("_edges", edges).withColumns({f"_{k}{c}": f(side(c)) for c in "xy" for k, f in (("lo", F.array_min), ("hi", F.array_max))})
    df = df.withColumns({"_w": F.col("_hix") - F.col("_lox"), "_h": F.col("_hiy") - F.col("_loy")})
    touched = lambda x, y: F.exists(pts, lambda p: (F.abs(p["x"] - F.col(x)) <= tol) & (F.abs(p["y"] - F.col(y)) <= tol))
    sides = F.forall(_ring(pts), lambda e: F.least(F.abs(e["q"]["x"] - e["p"]["x"]), F.abs(e["q"]["y"] - e["p"]["y"])) <= tol)
    on_box = F.forall(pts, lambda p: (F.least(F.abs(p["x"] - F.col("_lox")), F.abs(p["x"] - F.col("_hix"))) <= tol) & (F.least(F.abs(p["y"] - F.col("_loy")), F.abs(p["y"] - F.col("_hiy"))) <= tol))
    corners = touched("_lox", "_loy") & touched("_lox", "_hiy") & touched("_hix", "_loy") & touched("_hix", "_hiy")
    area = F.abs(F.aggregate(_ring(pts), F.lit(0.0), lambda a, e: a + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])) / 2
    w, h = F.col("_w"), F.col("_h")
    full = F.abs(area - w * h) <= F.greatest(0.01 * w * h, tol * (w + h))
    box = ~F.col("curved") & (n >= 4) & sides & on_box & corners & full & (F.least(w, h) >= 1e-6)
    lo_x, lo_y, hi_x, hi_y = (F.col(c) for c in ("_lox", "_loy", "_hix", "_hiy"))
    four = lambda fill: F.array(_rule("h", lo_y, lo_x, hi_x, fill), _rule("h", hi_y, lo_x, hi_x, fill), _rule("v", lo_x, lo_y, hi_y, fill), _rule("v", hi_x, lo_y, hi_y, fill))
    slack = F.when(F.greatest(w, h) < C.MIN_RULE - C.LEN_EPS, tol).otherwise(0.0)
    thin = F.array_compact(F.array(
        F.when((h <= C.THIN) & (w >= F.greatest(F.lit(C.DASH - C.LEN_EPS), h - slack)), _rule("h", (lo_y + hi_y) / 2, lo_x, hi_x)),
        F.when((w <= C.THIN) & (h >= F.greatest(F.lit(C.DASH - C.LEN_EPS), w - slack)), _rule("v", (lo_x + hi_x) / 2, lo_y, hi_y)),
    ))
    none = F.array().cast("array<struct<axis: string, pos: double, start: double, end: double, fill: boolean>>")
    fills = F.when(F.col("filled") & box, F.when(F.least(w, h) > C.THIN, F.when(F.col("parts") > 1, four(False)).otherwise(four(True))).otherwise(thin)).otherwise(none)
    strokes = F.when(F.col("stroked"), F.array_compact(F.transform("_edges", _edge))).otherwise(none)
    return df.withColumn("rules", F.concat(strokes, fills)).drop(*[c for c in df.columns if c.startswith("_")])


def _kind(paths: DataFrame) -> str:
    point = paths.schema["points"].dataType.elementType.simpleString()
    return f"array<struct<p: {point}, q: {point}>>"


def _clipped(rules: DataFrame) -> DataFrame:
    """Rules cut at the page's sides; those outside or then shorter than 2 points go; three decimals."""
    span, depth = F.when(F.col("axis") == "h", F.col("width_pt")).otherwise(F.col("height_pt")), F.when(F.col("axis") == "h", F.col("height_pt")).otherwise(F.col("width_pt"))
    cut = rules.withColumns({"start": F.greatest("start", F.lit(0.0)), "end": F.least(F.col("end"), span), "_deep": depth})
    kept = cut.where((F.col("pos") >= 0) & (F.col("pos") <= F.col("_deep")) & (F.col("end") - F.col("start") >= C.MIN_RULE - C.LEN_EPS)).drop("_deep")
    return kept.withColumns({c: rounded(F.col(c), 3) for c in ("pos", "start", "end")})


def crowded_pages(paths: DataFrame, keys: list[str], most: int = C.MAX_SEGMENTS) -> DataFrame:
    """keys, reason, points: pages whose rules are left out, for having more than ``most`` points of paths."""
    return paths.groupBy(*keys).agg(F.sum(F.size("points")).alias("points")).where(F.col("points") > most).select(*keys, F.lit("too_many_paths").alias("reason"), "points")


def page_rules(paths: DataFrame, keys: list[str]) -> DataFrame:
    """keys, axis, pos, start, end, fill of a page's subpaths (:func:`subpath_rules`, with width_pt and height_pt); dashes are joined.

    A page with over 200,000 points of paths gives none, as what it draws is no
    table; :func:`crowded_pages` names such pages.
    """
    rules = subpath_rules(paths.join(crowded_pages(paths, keys).select(*keys), keys, "left_anti")).select(*keys, "width_pt", "height_pt", F.inline("rules"))
    short = F.col("end") - F.col("start") < C.MIN_RULE - C.LEN_EPS
    size = paths.select(*keys, "width_pt", "height_pt").distinct()
    joined = join_dashes(rules.where(short), keys).join(size, keys).select(*keys, "width_pt", "height_pt", "axis", "pos", "start", "end", F.lit(False).alias("fill"))
    return _clipped(rules.where(~short).unionByName(joined)).select(*keys, "axis", "pos", "start", "end", "fill")


def glyph_losses(objects: DataFrame, glyphs: DataFrame, fonts: DataFrame) -> DataFrame:
    """document_id, page, reason: documents whose Hangul a renderer has lost, each with the first page that shows it.

    objects: document_id, page, object_id, font_id, invisible (the text
    objects that pages hold); glyphs: document_id, page, object_id, text (what
    came out of them); fonts: document_id, font_id, name, embedded, draws (it
    can draw Hangul here).  A visible object without any glyph, in a font that
    is neither embedded nor draws Hangul, may be one blank: what it held is
    unknown.  It is lost Hangul if the font's name is Korean, or if the
    document has Hangul and no font that gave some draws it.  Null flags count
    as false, null names as no name, objects of no known font as fine.
    """
    key = ["document_id", "font_id"]
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    gone = objects.where(~true("invisible")).join(glyphs.select("document_id", "page", "object_id").distinct(), ["document_id", "page", "object_id"], "left_anti")
    suspect = gone.join(fonts.where(~true("embedded") & ~true("draws")).select(*key, F.coalesce(F.col("name").rlike(KOREAN_FONT), F.lit(False)).alias("korean")), key)
    hangul = glyphs.where(F.col("text").rlike(HANGUL)).select("document_id", "page", "object_id").distinct()
    drawn = hangul.join(objects.select("document_id", "page", "object_id", "font_id"), ["document_id", "page", "object_id"]).join(fonts.select(*key, true("draws").alias("draws")), key, "left")
    whole = drawn.groupBy("document_id").agg(F.max(F.coalesce("draws", F.lit(False))).alias("rendered"))
    lost = suspect.join(whole, "document_id", "left").where("korean OR NOT coalesce(rendered, true)")
    return lost.groupBy("document_id").agg(F.min("page").alias("page")).withColumn("reason", F.lit("font without Hangul glyphs"))


def image_coverage(images: DataFrame) -> DataFrame:
    """Images (x0..y1 and frame in page coordinates, rotation) with coverage of the page and their visible box, 0..1; ``visible`` is null off the page."""
    w = F.least("x1", "frame.x1") - F.greatest("x0", "frame.x0")
    h = F.least("y1", "frame.y1") - F.greatest("y0", "frame.y0")
    area = (F.col("frame.x1") - F.col("frame.x0")) * (F.col("frame.y1") - F.col("frame.y0"))
    a = visible_point(F.greatest("x0", "frame.x0"), F.greatest("y0", "frame.y0"), F.col("frame"), F.col("rotation"))
    b = visible_point(F.least("x1", "frame.x1"), F.least("y1", "frame.y1"), F.col("frame"), F.col("rotation"))
    unit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    box = F.struct(*[unit(f(a[c], b[c])).alias(f"{c}{k}") for k, f in ((0, F.least), (1, F.greatest)) for c in "xy"])
    return images.withColumn("coverage", F.least(F.lit(1.0), F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)) / area)).withColumn("visible", F.when((w > 0) & (h > 0), box))


def decoded_units(units: DataFrame, keys: list[str], order: str, code: str) -> DataFrame:
    """Code units in order as characters (keys, order, text, unmapped): surrogate pairs join, lone ones and 0 are U+FFFD.

    A low half after a high one is part of it and gives no row.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(order)
    c, after, before = F.col(code), F.lead(code).over(w), F.lag(code).over(w)
    high, low = lambda v: F.coalesce(v.between(0xD800, 0xDBFF), F.lit(False)), lambda v: F.coalesce(v.between(0xDC00, 0xDFFF), F.lit(False))
    pair = high(c) & low(after)
    point = F.when(pair, F.lit(0x10000) + (c - 0xD800) * 1024 + (after - 0xDC00)).otherwise(c)
    bad = ~pair & (c.isin(0, 0xFFFD) | c.between(0xD800, 0xDFFF))
    text = F.when(bad, F.lit("�")).otherwise(F.decode(F.unhex(F.lpad(F.hex(point.cast("bigint")), 8, "0")), "UTF-32"))
    return units.withColumns({"_tail": low(c) & high(before), "text": text, "unmapped": bad}).where("NOT _tail").select(*keys, order, "text", "unmapped")


def main_axis(dx: Column, dy: Column) -> Column:
    """The direction of a vector on the visible page: +x, +y, -x, -y are 0 to 3."""
    return F.when(F.abs(dx) >= F.abs(dy), F.when(dx >= 0, 0).otherwise(2)).otherwise(F.when(dy > 0, 1).otherwise(3))


def reading_axes(advance: Column, up: Column) -> tuple[Column, Column]:
    """(along, down) of a glyph from its advance and up vectors (structs x, y, visible page); upright where nothing advances."""
    still = (advance["x"] == 0) & (advance["y"] == 0)
    along = main_axis(advance["x"], advance["y"])
    turn = (along + 1) % 4
    down = F.when((up["x"] == 0) & (up["y"] == 0), turn).otherwise(main_axis(-up["x"], -up["y"]))
    return F.when(still, 0).otherwise(along), F.when(still, 1).otherwise(F.when(down % 2 == along % 2, turn).otherwise(down))
