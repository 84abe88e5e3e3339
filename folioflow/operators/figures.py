"""A page's figures and captions from model boxes, image objects, tables and text.

What boxes mean to each other are matrices (share of one inside the other,
intersection over union, gap to a caption); only the choices that depend on
earlier choices are loops, over the few boxes of a page.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow import config as C
from folioflow.functions.geometry import unit_box
from folioflow.operators.flow import fragments_of
from folioflow.operators.grouped import per_group_arrays
from folioflow.operators.ruled import among

PLAN = "kind string, item_no int, category string, score double, model boolean, x0 double, y0 double, x1 double, y1 double, text string, caption_no int, above boolean, char_ids array<bigint>, line_ids array<bigint>"
#: Classes of the layout model that figures come from, of their captions, of tables and of ornaments (fixed values).
FIGURES, CAPTION, TABLE, ORNAMENTS = ("image", "chart"), "figure_title", "table", ("seal", "header_image", "footer_image")


# --- boxes as matrices ------------------------------------------------------------


def areas(a: np.ndarray) -> np.ndarray:
    return (a[:, 2] - a[:, 0]) * (a[:, 3] - a[:, 1])


def meets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common area of each pair of boxes."""
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    return np.maximum(w, 0) * np.maximum(h, 0)


def shares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of each box of ``a`` that lies in each of ``b``."""
    own = areas(a)[:, None]
    return np.where(own > 0, meets(a, b) / np.where(own > 0, own, 1), 0.0)


def ious(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = meets(a, b)
    union = areas(a)[:, None] + areas(b)[None, :] - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)


def gaps(captions: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertical distance of each caption from each box (infinite beyond 30 points or with little common width), and whether it stands above."""
    c, o = captions[:, None], others[None]
    common = np.minimum(c[..., 2], o[..., 2]) - np.maximum(c[..., 0], o[..., 0])
    narrow = np.minimum(c[..., 2] - c[..., 0], o[..., 2] - o[..., 0])
    above = (c[..., 1] + c[..., 3]) / 2 < (o[..., 1] + o[..., 3]) / 2
    gap = np.maximum(np.where(above, o[..., 1] - c[..., 3], c[..., 1] - o[..., 3]), 0.0)
    return np.where((narrow > 0) & (common >= C.CAPTION_OVERLAP * narrow) & (gap <= C.CAPTION_GAP), gap, np.inf), above


# --- image objects ------------------------------------------------------------------


def points_in(points: np.ndarray, boxes: np.ndarray, step: int = 256) -> np.ndarray:
    """Points in each (closed) box, some boxes at once; points are sorted by x so that a box sees its own stretch."""
    points = points[np.argsort(points[:, 0], kind="stable")]
    lo, hi = np.searchsorted(points[:, 0], boxes[:, 0], "left"), np.searchsorted(points[:, 0], boxes[:, 2], "right")
    out, order = np.zeros(len(boxes), np.int64), np.argsort(lo, kind="stable")
    for k in range(0, len(boxes), step):
        own = order[k : k + step]
        a, b = lo[own].min(), hi[own].max()
        part = points[a:b]
        inside = (part[:, 1] >= boxes[own, 1][:, None]) & (part[:, 1] <= boxes[own, 3][:, None])
        place = np.arange(a, b)
        out[own] = (inside & (place >= lo[own][:, None]) & (place < hi[own][:, None])).sum(1)
    return out


def image_kinds(boxes: np.ndarray, points: np.ndarray, page_area: float) -> tuple[np.ndarray, np.ndarray]:
    """(photos, ornaments) among a page's image objects: each place once, none infinite, none that carries 50 glyphs."""
    boxes = boxes[np.isfinite(boxes).all(1)]
    if not len(boxes):
        return boxes, boxes
    first: dict[tuple, int] = {}
    for k, box in enumerate(map(tuple, boxes.tolist())):
        first.setdefault(box, k)
    boxes = boxes[list(first.values())]
    side = np.minimum(boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1])
    small = (side < C.IMAGE_SIDE) | (areas(boxes) < C.IMAGE_AREA * page_area)
    photos = boxes[~small]
    return photos[points_in(points, photos) < C.BACKGROUND_GLYPHS], boxes[small]


# --- candidates ----------------------------------------------------------------------


def without_containers(xy: np.ndarray) -> np.ndarray:
    """Which boxes stay: not those that hold two others to 90 % which are neither the box itself nor each other again."""
    into = shares(xy, xy)  # [inner, outer]
    same = (into >= C.CONTAIN) & (into.T >= C.CONTAIN)
    held = (into >= C.CONTAIN) & ~same
    keep = np.ones(len(xy), bool)
    for k in range(len(xy)):
        inner = np.flatnonzero(held[:, k])
        keep[k] = not (len(inner) > 1 and (~same[inner[1:], inner[0]]).any())
    return keep


def with_photos(xy, category, score, photos, ornaments, marks):
    """Candidates mostly inside a photo become that photo (its smallest, named by its best candidate); those inside ornaments go; every photo is one."""
    if len(marks) and len(photos):
        under = (shares(photos, marks) >= C.INSIDE).any(1)
        photos, ornaments = photos[~under], np.concatenate([ornaments, photos[under]])
    host = shares(xy, photos) >= C.INSIDE
    size = np.where(host, areas(photos)[None], np.inf) if len(photos) else np.zeros((len(xy), 0))
    hosted = host.any(1) if len(photos) else np.zeros(len(xy), bool)
    to = size.argmin(1) if len(photos) else np.zeros(len(xy), np.int64)
    loose = ~hosted & ~((shares(xy, ornaments) >= C.INSIDE).any(1) if len(ornaments) else np.zeros(len(xy), bool))
    names, best = np.array(["image"] * len(photos), object), np.zeros(len(photos))
    seen = np.zeros(len(photos), bool)
    for k in np.flatnonzero(hosted):
        if not seen[to[k]] or score[k] > best[to[k]]:
            seen[to[k]], names[to[k]], best[to[k]] = True, category[k], score[k]
    return np.concatenate([xy[loose], photos]), np.concatenate([category[loose], names]), np.concatenate([score[loose], best])


def distinct(xy, category, score) -> np.ndarray:
    """Indexes of the candidates to keep, the largest first: none like a kept one of its kind, none within a kept one."""
    same = (ious(xy, xy) >= C.SAME_IOU) & (category[:, None] == category[None])
    drop = same | (shares(xy, xy) >= C.CONTAIN)
    kept: list[int] = []
    for k in np.lexsort((np.arange(len(xy)), -score, -areas(xy))):
        if not drop[k, kept].any():
            kept.append(int(k))
    return np.array(kept, np.int64)


def paired(gap: np.ndarray, above: np.ndarray) -> dict[int, tuple[int, bool]]:
    """Figure to caption (rows captions, columns figures), the nearest first, each once."""
    c, f = np.nonzero(np.isfinite(gap))
    out: dict[int, tuple[int, bool]] = {}
    used: set[int] = set()
    for k in np.lexsort((c, f, gap[c, f])):
        if int(f[k]) not in out and int(c[k]) not in used:
            out[int(f[k])] = (int(c[k]), bool(above[c[k], f[k]]))
            used.add(int(c[k]))
    return out


class Text:
    """What boxes may take: glyphs of the layer, or OCR lines where the page is read by OCR."""

    def __init__(self, layer: bool, ids: np.ndarray, text: np.ndarray, box: np.ndarray, size: np.ndarray, baseline: np.ndarray, order: np.ndarray):
        self.layer, self.ids, self.text, self.box, self.size, self.baseline, self.order = layer, ids, text, box, size, baseline, order
        self.free = np.ones(len(self.ids), bool)

    @classmethod
    def of(cls, cols: dict, layer: bool) -> Text:
        own = cols["kind"] == ("glyph" if layer else "line")
        number = lambda c: cols[c][own].astype(float)
        return cls(layer, cols["item"][own].astype(np.int64), cols["text"][own], np.stack([number(c) for c in ("x0", "y0", "x1", "y1")], 1), number("size"), number("baseline"), number("score"))

    def places(self, box) -> np.ndarray:
        """Places of the free text whose centre lies in the box, widened by 2 points."""
        p = C.CAPTURE_PAD
        cx, cy = (self.box[:, 0] + self.box[:, 2]) / 2, (self.box[:, 1] + self.box[:, 3]) / 2
        return np.flatnonzero(self.free & (cx >= box[0] - p) & (cx <= box[2] + p) & (cy >= box[1] - p) & (cy <= box[3] + p))

    def any_within(self, box) -> bool:
        """Whether :meth:`within` gives text that is not blank."""
        return bool("".join(map(str, self.text[self.places(box)])).strip())

    def within(self, box) -> tuple[str, np.ndarray]:
        """The text at :meth:`places`, and those."""
        at = self.places(box)
        if not len(at):
            return "", at
        if not self.layer:
            lines = [str(self.text[k]) for k in at[np.argsort(self.order[at], kind="stable")]]
        else:
            own = at[np.lexsort((self.box[at, 0], self.baseline[at]))]
            b = self.box[own]
            lines = [f["text"] for f in fragments_of({"text": self.text[own], "x0": b[:, 0], "y0": b[:, 1], "x1": b[:, 2], "y1": b[:, 3], "baseline": self.baseline[own], "size": self.size[own], "bold": np.zeros(len(own), bool), "char_id": self.ids[own]})]
        return unicodedata.normalize("NFC", "\n".join(lines)).strip(), at

    def take(self, at: np.ndarray) -> dict:
        self.free[at] = False
        ids = np.sort(self.ids[at]).tolist()
        return {"char_ids": ids if self.layer else [], "line_ids": [] if self.layer else ids}


# --- the plan --------------------------------------------------------------------------


def arranged(cols: dict) -> list[dict]:
    """Figures with their captions and text, and the tables kept and dropped, of one page (rows of ``PLAN``)."""
    kind, mode = cols["kind"], next((str(m) for m in cols["mode"] if m is not None), "layer")
    area = max((float(a) for a in cols["page_area"] if a is not None and not np.isnan(a)), default=0.0)

    def boxes(at):
        return np.stack([cols[c][at].astype(float) for c in ("x0", "y0", "x1", "y1")], 1)

    region, layer = kind == "region", mode == "layer"
    owner = cols["owner"][kind == ("glyph" if layer else "line")].astype(float)
    return planned(area, boxes(region), cols["cls"][region], cols["score"][region].astype(float), boxes(kind == "image"), boxes(kind == "table"), cols["item"][kind == "table"], Text.of(cols, layer), owner)


def planned(area: float, xy: np.ndarray, cls: np.ndarray, score: np.ndarray, images: np.ndarray, tables: np.ndarray, table_ids: np.ndarray, text: Text, owner: np.ndarray) -> list[dict]:
    """:func:`arranged` of a page's model boxes, image objects, tables and text; ``owner`` is the table of each piece of text, or not a number."""
    solid = areas(xy) > 0
    named = lambda kinds: np.array([c in kinds for c in cls], bool)
    figure = named(FIGURES) & (score >= C.FIGURE_SCORE) & solid
    captions = xy[(cls == CAPTION) & (score >= C.CAPTION_SCORE) & solid]
    model = xy[(cls == TABLE) & (score >= C.TABLE_SCORE)]
    marks = xy[named(ORNAMENTS) & (score >= C.FIGURE_SCORE)]
    keep = np.flatnonzero(figure)[without_containers(xy[figure])]
    own, names, scores = xy[keep], cls[keep].astype(object), score[keep]
    if text.layer:
        ink = np.array([not str(t).isspace() for t in text.text], bool)
        centres = np.stack([(text.box[:, 0] + text.box[:, 2]) / 2, (text.box[:, 1] + text.box[:, 3]) / 2], 1)[ink]
        own, names, scores = with_photos(own, names, scores, *image_kinds(images, centres, area), marks)
    keep = distinct(own, names, scores)
    own, names, scores = own[keep], names[keep], scores[keep]
    sure = (ious(tables, model) >= C.CONFIRM_IOU).any(1) if len(model) else np.zeros(len(tables), bool)
    if sure.any():
        keep = ~(shares(own, tables[sure]) >= C.INSIDE).any(1)
        own, names, scores = own[keep], names[keep], scores[keep]
    found = own[scores >= C.FIGURE_SCORE]
    gone = ~sure & ((shares(tables, found) >= C.INSIDE).any(1) if len(found) else False)
    order = np.lexsort((own[:, 0], own[:, 1]))
    own, names, scores = own[order], names[order], scores[order]
    # glyphs of kept tables are no one else's
    mine = among(owner, table_ids[~gone].astype(float))
    text.free[mine] = False
    apart = model[~((shares(model, own) >= C.INSIDE) | (ious(model, own) >= C.CONFIRM_IOU)).any(1)] if len(own) else model
    to_table = gaps(captions, np.concatenate([tables[~gone], apart]))[0].min(1, initial=np.inf)
    to_figure = gaps(captions, own)[0].min(1, initial=np.inf)
    captions = captions[~(np.isfinite(to_table) & (to_table <= to_figure))]
    captions = captions[[text.any_within(c) for c in captions]] if len(captions) else captions
    out, linked = [], {}
    for f, (c, above) in sorted(paired(*gaps(captions, own)).items()):
        words, at = text.within(captions[c])
        if words:
            linked[f] = (len(linked), above)
            out.append({"kind": "caption", "item_no": linked[f][0], "text": words, "above": above, **_sides(captions[c]), **text.take(at)})
    for f, box in enumerate(own):
        words, at = text.within(box)
        out.append({"kind": "figure", "item_no": f, "category": str(names[f]), "score": float(scores[f]), "model": bool(scores[f] >= C.FIGURE_SCORE), "text": words, "caption_no": linked.get(f, (None,))[0], "above": linked.get(f, (None, None))[1], **_sides(box), **text.take(at)})
    return out + [{"kind": "dropped" if g else "table", "item_no": int(i), "model": bool(s), **_sides(b)} for i, b, g, s in zip(table_ids, tables, np.broadcast_to(gone, len(tables)), sure)]


def _sides(box) -> dict:
    return dict(zip(("x0", "y0", "x1", "y1"), map(float, box)))


def page_plan(pages: DataFrame, regions: DataFrame, keys: list[str], images: DataFrame | None = None, tables: DataFrame | None = None, chars: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """``keys`` and the columns of ``PLAN``: figures, captions, and tables kept or dropped, page by page.

    pages: keys, mode, width_pt, height_pt; regions: keys, cls, score, box;
    images: keys, box; tables: keys, table_no, box; chars: keys, char_id,
    text, box, baseline, size, invisible and, if there, table_no (its owner);
    lines (pages read by OCR): keys, line_id, text, box, seq.
    """
    number = lambda c, name=None: F.col(c).cast("double").alias(name or c)
    sides = [number(c) for c in ("x0", "y0", "x1", "y1")]
    rows = pages.select(*keys, F.lit("page").alias("kind"), "mode", (F.col("width_pt") * F.col("height_pt")).cast("double").alias("page_area"))
    add = lambda df: rows.unionByName(df, allowMissingColumns=True)
    rows = add(regions.select(*keys, F.lit("region").alias("kind"), F.col("cls"), number("score"), *sides))
    empty = {"item": "bigint", "text": "string", "baseline": "double", "size": "double", "owner": "double"}
    for name, kind in empty.items():
        rows = rows.withColumn(name, F.lit(None).cast(kind))
    if images is not None:
        rows = add(images.select(*keys, F.lit("image").alias("kind"), *sides))
    if tables is not None:
        rows = add(tables.select(*keys, F.lit("table").alias("kind"), F.col("table_no").cast("bigint").alias("item"), *sides))
    if chars is not None:
        owner = F.col("table_no").cast("double") if "table_no" in chars.columns else F.lit(None).cast("double")
        rows = add(chars.where("NOT invisible").select(*keys, F.lit("glyph").alias("kind"), F.col("char_id").cast("bigint").alias("item"), F.coalesce("text", F.lit(" ")).alias("text"), number("baseline"), number("size"), owner.alias("owner"), *sides))
    if lines is not None:
        rows = add(lines.select(*keys, F.lit("line").alias("kind"), F.col("line_id").cast("bigint").alias("item"), F.coalesce("text", F.lit("")).alias("text"), number("seq", "score"), *sides))
    return per_group_arrays(rows, keys, ["kind", "item", "y0", "x0"], arranged, PLAN)


def figure_extras(plan: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """A plan's figures and captions as extras for the blocks of a page: a caption above stands before its figure, one below right after it."""
    f = plan.where("kind = 'figure'")
    c = plan.where("kind = 'caption'").select(*keys, F.col("item_no").alias("caption_no"), F.struct("text", "x0", "y0", "x1", "y1").alias("caption"))
    both = f.join(c, [*keys, "caption_no"], "left").join(pages.select(*keys, "width_pt", "height_pt", "mode"), keys)
    top = F.when(F.coalesce("above", F.lit(False)), F.least(F.col("caption.y0"), F.col("y0"))).otherwise(F.col("y0")) / F.col("height_pt")
    spec = lambda kind, text, b, place: F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.lit(C.CONFIDENCE[kind]).alias("confidence"), b.alias("at"), F.lit(place).alias("place"))
    box = lambda p: F.struct(*[F.col(f"{p}{s}").alias(s) for s in ("x0", "y0", "x1", "y1")])
    figure, note = spec("figure", F.col("text"), box(""), 1), lambda place: spec("caption", F.col("caption.text"), box("caption."), place)
    items = F.array_compact(F.array(F.when(F.col("caption").isNotNull() & F.col("above"), note(0)), figure, F.when(F.col("caption").isNotNull() & ~F.col("above"), note(2))))
    out = both.select(*keys, top.alias("top"), "item_no", "width_pt", "height_pt", "mode", F.explode(items).alias("s"))
    unit = F.struct(*[(F.col(f"s.at.{a}") / F.col(w)).alias(a) for a, w in (("x0", "width_pt"), ("y0", "height_pt"), ("x1", "width_pt"), ("y1", "height_pt"))])
    source = F.when(F.col("mode") == "layer", "text_layer").otherwise("ocr")
    return out.select(*keys, (F.col("item_no") * 3 + F.col("s.place")).cast("int").alias("extra_no"), F.lit(2).alias("rank"), "top", "s.kind", "s.text", "s.confidence", source.alias("text_source"), unit_box(unit).alias("box"))


def table_rules(rules: DataFrame, tables: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rules: long horizontal rules (30 % of the page's width) outside the ruled tables, each position once."""
    from folioflow.operators.layout import merge_rules

    long = merge_rules(rules.where("axis = 'h' AND `end` > start"), keys).join(pages.select(*keys, "width_pt"), keys).where(F.col("end") - F.col("start") >= C.RULE_WIDTH * F.col("width_pt"))
    t = tables.select(*keys, *[F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")])
    inside = (F.col("pos") >= F.col("ty0") - 2) & (F.col("pos") <= F.col("ty1") + 2) & (F.col("start") >= F.col("tx0") - 2) & (F.col("end") <= F.col("tx1") + 2)
    rest = long.select(*keys, "pos", "start", "end").distinct()
    rest = rest.join(rest.join(t, keys).where(inside).select(*keys, "pos", "start", "end").distinct(), [*keys, "pos", "start", "end"], "left_anti")
    from pyspark.sql import Window as W

    new = F.coalesce((F.col("pos") - F.lag("pos").over(W.partitionBy(*keys).orderBy("pos")) > C.SNAP), F.lit(True))
    return rest.withColumn("_new", new.cast("int")).groupBy(*keys).agg(F.sum("_new").alias("rules"))


def wants_layout(pages: DataFrame, photos: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """pages (keys, mode, paths) with wanted: pages read by OCR, and those with ten paths, a photo or three long rules."""
    out = pages.join(photos.select(*keys).distinct().withColumn("_photo", F.lit(True)), keys, "left").join(rules.select(*keys, F.col("rules").alias("_rules")), keys, "left")
    wanted = (F.col("mode") != "layer") | (F.col("paths") >= C.LAYOUT_PATHS) | F.col("_photo").isNotNull() | (F.coalesce("_rules", F.lit(0)) >= C.TABLE_RULES)
    return out.withColumn("wanted", wanted).drop("_photo", "_rules")


# --- crops ------------------------------------------------------------------------------


def png_of(pixels: np.ndarray) -> bytes:
    """An RGB or grey image (height x width [x 3], bytes) as PNG: one data chunk, no filter, no metadata."""
    rows = np.ascontiguousarray(pixels, np.uint8).reshape(pixels.shape[0], -1)
    data = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], 1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(data, 6)) + chunk(b"IEND", b"")


def cropped(image: np.ndarray, box: tuple, width_pt: float, height_pt: float, longest: int = 4000) -> tuple[np.ndarray, int] | None:
    """The pixels that a box touches and their dpi; beyond ``longest`` pixels a side reduced by whole-block means; None without area."""
    sx, sy = image.shape[1] / width_pt, image.shape[0] / height_pt
    x0, y0 = max(0, int(np.floor(box[0] * sx))), max(0, int(np.floor(box[1] * sy)))
    x1, y1 = min(image.shape[1], int(np.ceil(box[2] * sx))), min(image.shape[0], int(np.ceil(box[3] * sy)))
    if x1 <= x0 or y1 <= y0:
        return None
    part, k = image[y0:y1, x0:x1], -(-max(x1 - x0, y1 - y0) // longest)
    if k > 1:
        rows, cols = np.arange(0, part.shape[0], k), np.arange(0, part.shape[1], k)
        total = np.add.reduceat(np.add.reduceat(part.astype(np.uint32), rows, 0), cols, 1)
        n = np.multiply.outer(np.diff(np.append(rows, part.shape[0])), np.diff(np.append(cols, part.shape[1])))
        part = (total + n[..., None] // 2 if part.ndim == 3 else total + n // 2) // (n[..., None] if part.ndim == 3 else n)
    return part.astype(np.uint8), max(1, round(72 * sx / k))
