"""A document's pages from what is drawn and read on them to blocks: the steps of the page operators in one plan.

What concerns one page (its mode, tables, figures, fragments of text) is done
in one pass over the pages, whose glyphs are exchanged once at most
(:func:`read_pages`) or never become rows (:func:`read_drawn`); what concerns
a document is joins and windows over fragments, tables and figures.  Pages in
whose main direction text does not stand upright give text and figures but no
tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioflow import config as C
from folioflow.functions.geometry import rounded, unit_box
from folioflow.operators import borderless as BL
from folioflow.operators import figures as FG
from folioflow.operators import flow as FL
from folioflow.operators import layout as L
from folioflow.operators import pages as P
from folioflow.operators import planning as N
from folioflow.operators import ruled as RT
from folioflow.operators import tables as TB
from folioflow.operators.grouped import per_group_arrays
from folioflow.operators.pages import PAGE
from folioflow.sources.storage import stored

_SIDES = ("x0", "y0", "x1", "y1")
#: Numbers of tables without rules start here, behind those of the ruled ones of a page.
BORDERLESS = 100_000
_BOX = "x0 double, y0 double, x1 double, y1 double"
CELLS = f"table_no int, n_rows int, n_cols int, `row` int, col int, rowspan int, colspan int, text string, header string, {_BOX}"
TABLES, NOTES = f"table_no int, text string, {_BOX}", "region_id string, reason string, detail string"
#: What one page gives: statistics, counts of the ledger, and lists of what was found on it.
PARTS = (
    "width_pt double, height_pt double, chars bigint, hidden bigint, invisible_ratio double, unmapped_ratio double, pua_ratio double, max_image_coverage double, text_layer string, mode string, layer_chars bigint, owned bigint, uses bigint, "
    f"cells array<struct<{CELLS}>>, tables array<struct<{TABLES}>>, plan array<struct<{FG.PLAN}>>, notes array<struct<{NOTES}>>, frags array<struct<{FL.FRAGMENTS.replace(', char_ids array<bigint>', '')}, sizes array<struct<size: double, n: int>>>>"
)


@dataclass
class Pages:
    """What was read: pages with state and mode, blocks in order, cells of the tables, figures and captions, notes, counts for the glyph ledger."""

    pages: DataFrame
    blocks: DataFrame
    cells: DataFrame
    plan: DataFrame
    notes: DataFrame
    counts: DataFrame

    @property
    def ledger(self) -> DataFrame:
        """document_id, page, layer_chars, in_blocks, doubled: the glyphs of the layer, those in blocks, and how often more than once."""
        loose = self.blocks.where("glyphs IS NOT NULL").groupBy(*PAGE).agg(F.sum("glyphs").alias("loose"))
        both = self.counts.join(loose, PAGE, "left").fillna(0, ["loose"])
        return both.select(*PAGE, "layer_chars", (F.col("owned") + F.col("loose")).alias("in_blocks"), (F.col("uses") - F.col("owned")).alias("doubled"))


def _unit(df: DataFrame):
    """The box of a row in points as 0..1 of its page, three decimals."""
    return unit_box(F.struct(*[(F.col(c) / F.col("width_pt" if c[0] == "x" else "height_pt")).alias(c) for c in _SIDES]))


def ocr_extras(lines: DataFrame, chars: DataFrame, pages: DataFrame, used: DataFrame) -> DataFrame:
    """OCR lines that count, and no figure has taken, as paragraphs between a page's blocks (rank 1).

    lines: document_id, page, line_id, text, score, box in points, of pages
    read by OCR.  Lines over visible text are left out but where OCR stands
    in for the layer.
    """
    own = lines.join(pages.where("mode <> 'layer'").select(*PAGE, "mode", "width_pt", "height_pt"), PAGE).join(used, [*PAGE, "line_id"], "left_anti")
    covered = N.covered_share(own, chars, PAGE)
    kept = P.ocr_keep(covered.withColumn("covered", F.when(F.col("mode") == "ocr", 0.0).otherwise(F.col("covered"))))
    para = P.paragraphs(L.reading_order(kept, PAGE), PAGE)
    joined = para.groupBy(*PAGE, "group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "\n").alias("text"), rounded(F.avg("score") * C.OCR_CONFIDENCE, 3).alias("confidence"), *[f(c).alias(c) for c, f in zip(_SIDES, (F.min, F.min, F.max, F.max))], F.first("width_pt").alias("width_pt"), F.first("height_pt").alias("height_pt"))
    box = _unit(joined)
    return joined.where("trim(text) <> ''").select(*PAGE, F.col("group_id").cast("int").alias("extra_no"), F.lit(1).alias("rank"), rounded(F.greatest(F.col("y0") / F.col("height_pt"), F.lit(0.0)), 3).alias("top"), F.lit("paragraph").alias("kind"), FL.nfc(F.col("text")).alias("text"), "confidence", F.lit("ocr").alias("text_source"), box.alias("box"))


# --- one page ---------------------------------------------------------------------


def _private(char: str) -> bool:
    code = ord(char[0]) if char else 0
    return 0xE000 <= code <= 0xF8FF or code >= 0xF0000


def _coverage(images: np.ndarray, width: float, height: float) -> float:
    """The largest share of the page that an image object covers."""
    side = lambda a, b, most: np.maximum(np.minimum(b, most) - np.maximum(a, 0.0), 0.0)
    shares = side(images[:, 0], images[:, 2], width) * side(images[:, 1], images[:, 3], height) / (width * height)
    return round(float(np.minimum(shares, 1.0).max()), 4)


def _upright(along: np.ndarray, down: np.ndarray) -> bool:
    """Whether most ink (in order of char_id) is upright, ties included; pages without ink are."""
    here = int(((along == 0) & (down == 1)).sum())
    return here == len(along) or here >= np.unique(along * 4 + down, return_counts=True)[1].max()


def _state(ratios: tuple[float, float, float], coverage: float, chars: int) -> str:
    """:func:`pages.classify` of one page: shares of hidden, unmapped and private-use glyphs."""
    hidden, unmapped, private = ratios
    if hidden >= C.SCANNED_INVISIBLE or (coverage >= C.SCANNED_COVERAGE and chars < C.SCANNED_CHARS):
        return "scanned"
    return "unreliable" if max(unmapped, private) >= C.UNRELIABLE_RATIO else "digital"


def page_parts(drawn: dict, ocr: bool = False) -> dict:
    """What is on one page, as the columns of ``PARTS``.

    drawn: width_pt, height_pt, page; chars, a dict of the arrays of all its glyphs
    (char_id, text, x0, y0, x1, y1, baseline, size, bold, invisible,
    unmapped, along, down); rules, one of axis, pos, start, end, fill, or
    None; images, an array of boxes, or None; regions (cls, score, boxes), or
    None; lines read by OCR (line_id, text, seq, boxes), or None.
    """
    width, height = float(drawn["width_pt"]), float(drawn["height_pt"])
    by = np.argsort(drawn["chars"]["char_id"], kind="stable")
    g = {c: v[by] for c, v in drawn["chars"].items()}
    ink = np.array([t.strip(" ") != "" for t in g["text"]], bool)
    share = lambda odd: round(int((ink & odd).sum()) / int(ink.sum()), 4) if ink.any() else 0.0
    ratios = share(g["invisible"]), share(g["unmapped"]), share(np.array([_private(t) for t in g["text"]], bool))
    images, regions, rules, lines = (drawn.get(k) for k in ("images", "regions", "rules", "lines"))
    coverage = _coverage(images, width, height) if images is not None and len(images) else 0.0
    chars = int((ink & ~g["invisible"]).sum())
    state = _state(ratios, coverage, chars)
    mode = {"scanned": "scan", "unreliable": "ocr"}.get(state, "layer") if ocr else "layer"
    out = {"width_pt": width, "height_pt": height, "chars": chars, "hidden": int(ink.sum()) - chars, **dict(zip(("invisible_ratio", "unmapped_ratio", "pua_ratio"), ratios)), "max_image_coverage": coverage, "text_layer": state, "mode": mode, "layer_chars": chars}
    if g["invisible"].any():
        seen = ~g["invisible"]
        g, ink = {c: v[seen] for c, v in g.items()}, ink[seen]
    upright = mode == "layer" and _upright(g["along"][ink], g["down"][ink])
    glyphs = RT.Glyphs(g["char_id"], g["text"], np.stack([g[c] for c in _SIDES], 1), g["baseline"], g["size"], g["bold"], np.array([t.isspace() or not t for t in g["text"]], bool))
    if rules is not None:
        at = np.lexsort((rules["start"], rules["pos"], rules["axis"]))
        rules = {c: np.asarray(v)[at] for c, v in rules.items()}
    # tables drawn with rules
    found = RT.tables_of(*(rules[c] for c in ("axis", "pos", "start", "end", "fill")), glyphs, width * height) if rules is not None and upright and len(ink) else []
    ruled = {no: t for no, t in enumerate(found) if not t["reject"]}
    notes = []
    note = lambda tag, reason, detail=None: notes.append({"region_id": f"p{drawn['page']}-{tag}", "reason": reason, "detail": detail})
    # figures and captions; some take the place of tables
    plan = _plan(width * height, mode, images, regions, lines, ruled, glyphs)
    kept = {p["item_no"]: ruled[p["item_no"]] for p in plan if p["kind"] == "table"}
    figures = [p for p in plan if p["kind"] in ("figure", "caption")]
    held = [*(t["char_ids"] for t in kept.values()), *(np.array(p.get("char_ids") or (), np.int64) for p in figures)]
    # tables without rules, from what is left
    plain = _plain(g, glyphs, rules, regions, ~RT.among(g["char_id"], np.concatenate([*held, np.zeros(0, np.int64)])), [t["box"] for t in kept.values()], [tuple(p[c] for c in _SIDES) for p in figures], (width, height)) if upright and len(ink) else []
    made = [t for t in plain if not t["failure"]]
    held += [g["char_id"][t["used"]] for t in made]
    cells, tables = _cells(kept, made)
    for t in plain:
        if t["failure"]:
            note(f"borderless-{t['tag']}", "borderless_table_failed", t["failure"])
    for t in made:
        note(f"borderless-{t['tag']}", "borderless_table")
    for p in plan:
        if p["kind"] == "dropped":
            note(f"table-{p['item_no']}", "inside_figure")
    for no, t in enumerate(found):
        if t["reject"]:
            note(f"table-{no}", "table_too_large", t["reject"])
    # the text
    owned = np.concatenate([*held, np.zeros(0, np.int64)])
    of_ink = RT.among(owned, g["char_id"][ink])
    out |= {"owned": len(set(owned[of_ink].tolist())), "uses": int(of_ink.sum()), "cells": cells, "tables": tables, "plan": plan, "notes": notes, "frags": []}
    if mode != "ocr":
        loose = ~RT.among(g["char_id"], owned)
        rest = FL.turned({c: g[c][loose] for c in (*_SIDES, "baseline", "size", "text", "bold", "char_id", "along", "down")}, width, height)
        order = np.lexsort((rest["char_id"], rest["x0"], rest["baseline"]))
        columns = FL.page_fragments({c: v[order] for c, v in rest.items()}, False, True)
        out["frags"] = [dict(zip(columns, row)) for row in zip(*columns.values())]
    return out


def _plan(area: float, mode: str, images, regions, lines, ruled: dict, glyphs: RT.Glyphs) -> list[dict]:
    boxes, ids = np.array([t["box"] for t in ruled.values()], float).reshape(-1, 4), np.array(list(ruled), np.int64)
    if images is None and regions is None:
        return [{"kind": "table", "item_no": int(no), **dict(zip(_SIDES, map(float, b)))} for no, b in zip(ids, boxes)]
    none = np.zeros((0, 4))
    cls, score, xy = regions if regions is not None else (np.zeros(0, object), np.zeros(0), none)
    by = np.lexsort((xy[:, 0], xy[:, 1]))
    photos = images[np.lexsort((images[:, 0], images[:, 1]))] if images is not None else none
    if mode == "layer":
        owner = np.full(len(glyphs.text), np.nan)
        for no, t in ruled.items():
            owner[RT.among(glyphs.char_id, t["char_ids"])] = no
        text = FG.Text(True, glyphs.char_id, glyphs.text, glyphs.box, glyphs.size, glyphs.baseline, np.zeros(len(owner)))
    else:
        no, words, seq, at = lines if lines is not None else (np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0), none)
        order = np.argsort(no, kind="stable")
        owner = np.full(len(no), np.nan)
        text = FG.Text(False, no[order], words[order], at[order], owner, owner, seq[order])
    return FG.planned(area, xy[by], cls[by], score[by], photos, boxes, ids, text, owner)


def _plain(g: dict, glyphs: RT.Glyphs, rules, regions, free: np.ndarray, ruled: list, protected: list, size: tuple) -> list[dict]:
    every = [RT.Segments(*(np.asarray(rules[c], float)[keep] for c in ("pos", "start", "end"))) if rules is not None else RT.Segments(*(np.zeros(0) for _ in range(3))) for keep in ([rules["axis"] == "h", rules["axis"] == "v", (rules["axis"] == "v") & rules["fill"].astype(bool)] if rules is not None else [None] * 3)]
    model = [(float(s), tuple(map(float, b))) for c, s, b in zip(*regions) if c == FG.TABLE] if regions is not None else []
    return BL.settled(BL.Page(glyphs, *map(RT.merged, every), *size), free, ruled, model, protected)


def _cells(kept: dict, made: list[dict]) -> tuple[list[dict], list[dict]]:
    """Cells and texts of a page's tables; those without rules are numbered by their place."""
    place = {k: no for no, k in enumerate(sorted({(t["box"][1], t["box"][0], t["tag"]) for t in made}))}
    cells, tables = [], []
    every = [(no, t, [(r, c, n, m, text, head) for r, c, n, m, text, head in t["cells"]]) for no, t in kept.items()]
    every += [(place[t["box"][1], t["box"][0], t["tag"]] + BORDERLESS, t, [(c.row, c.col, c.height, c.width, c.text, "none") for c in t["cells"]]) for t in made]
    for no, t, own in every:
        base = {"table_no": no, **dict(zip(_SIDES, map(float, t["box"])))}
        size = {"n_rows": int(t["n_rows"]), "n_cols": int(t["n_cols"])}
        cells += [{**base, **size, "row": r, "col": c, "rowspan": n, "colspan": m, "text": text, "header": head} for r, c, n, m, text, head in own]
        tables.append({**base, "text": TB.plain_of([(r, c, text) for r, c, _, _, text, _ in own], t["n_rows"])})
    return cells, tables


# --- pages as rows, and pages where they lie ------------------------------------------


def _rows(pages: DataFrame, chars: DataFrame, rules: DataFrame | None, images: DataFrame | None, regions: DataFrame | None, lines: DataFrame | None) -> DataFrame:
    """All that is on the pages as rows of one table, without nulls."""
    fill = {"kind": "string", "item": "bigint", "text": "string", "x0": "double", "y0": "double", "x1": "double", "y1": "double", "at": "double", "size": "double", "bold": "boolean", "invisible": "boolean", "unmapped": "boolean", "along": "int", "down": "int"}
    zero = {"string": "", "boolean": False}

    def of(df: DataFrame, kind: str, **columns) -> DataFrame:
        own = {"kind": F.lit(kind), **columns}
        blank = lambda t: F.lit(zero.get(t, 0)).cast(t)
        return df.select(*PAGE, *[F.coalesce(own[c].cast(t), blank(t)).alias(c) if c in own else blank(t).alias(c) for c, t in fill.items()])

    sides = {c: F.col(c) for c in _SIDES}
    flags = {c: F.col(c) for c in ("bold", "unmapped", "along", "down")}
    out = of(pages, "page", x1=F.col("width_pt"), y1=F.col("height_pt"))
    out = out.unionByName(of(chars, "glyph", item=F.col("char_id"), text=F.coalesce("text", F.lit(" ")), at=F.col("baseline"), size=F.col("size"), invisible=F.coalesce("invisible", F.lit(True)), **flags, **sides))
    if rules is not None:
        out = out.unionByName(of(rules, "rule", text=F.col("axis"), at=F.col("pos"), x0=F.col("start"), x1=F.col("end"), bold=F.col("fill") if "fill" in rules.columns else F.lit(False)))
    if images is not None:
        out = out.unionByName(of(images, "image", **sides))
    if regions is not None:
        out = out.unionByName(of(regions, "region", text=F.col("cls"), at=F.col("score"), **sides))
    if lines is not None:
        out = out.unionByName(of(lines, "line", item=F.col("line_id"), text=F.col("text"), at=F.col("seq"), **sides))
    return out


def _drawn(cols: dict, given: tuple[str, ...]) -> dict | None:
    """A page's rows as :func:`page_parts` takes them; None where ``pages`` has no such page."""
    kind = cols["kind"].astype(str)
    at = {k: np.flatnonzero(kind == k) for k in ("page", "glyph", *given)}
    if not len(at["page"]):
        return None
    of = lambda k, c: cols[c][at[k]]
    boxes = lambda k: np.stack([of(k, c) for c in _SIDES], 1)
    glyph = {"char_id": "item", "baseline": "at"}
    return {
        "width_pt": of("page", "x1")[0], "height_pt": of("page", "y1")[0],
        "chars": {c: of("glyph", glyph.get(c, c)) for c in (*_SIDES, "char_id", "text", "baseline", "size", "bold", "invisible", "unmapped", "along", "down")},
        "rules": {c: of("rule", k) for c, k in (("axis", "text"), ("pos", "at"), ("start", "x0"), ("end", "x1"), ("fill", "bold"))} if "rule" in given else None,
        "images": boxes("image") if "image" in given else None,
        "regions": (of("region", "text"), of("region", "at"), boxes("region")) if "region" in given else None,
        "lines": (of("line", "item"), of("line", "text"), of("line", "at"), boxes("line")) if "line" in given else None,
    }


def read_pages(pages: DataFrame, chars: DataFrame, rules: DataFrame | None = None, images: DataFrame | None = None, regions: DataFrame | None = None, lines: DataFrame | None = None) -> Pages:
    """Blocks of the pages of any number of documents.

    pages: document_id, page, width_pt, height_pt; chars: page points with
    char_id, text, box, baseline, size, bold, invisible, unmapped, along,
    down; rules: axis, pos, start, end, fill; images: box; regions of the
    layout model: cls, score, box; lines read by OCR: line_id, text, score,
    box.  OCR counts as on where ``lines`` is given.
    """
    seen = None if lines is None else L.reading_order(P.ocr_keep(lines.withColumn("covered", F.lit(0.0))), PAGE)
    given = tuple(k for k, df in (("rule", rules), ("image", images), ("region", regions), ("line", lines)) if df is not None)

    def one(cols) -> list[dict]:
        drawn = _drawn(cols, given)
        return [] if drawn is None else [page_parts({**drawn, "page": cols["page_no"][0]}, "line" in given)]

    rows = _rows(pages, chars, rules, images, regions, seen).withColumn("page_no", F.col("page"))
    parts = stored(per_group_arrays(rows, PAGE, [], one, PARTS))
    more = [c for c in pages.columns if c not in (*PAGE, "width_pt", "height_pt")]
    used = pages.select(*PAGE, *more) if more else None
    return _assembled(parts if used is None else parts.join(used, PAGE), more, lines, chars)


def read_drawn(pages: DataFrame, read: Callable[[dict], dict]) -> Pages:
    """:func:`read_pages` of pages that are read where they lie: ``read`` gives for a row of ``pages`` (document_id, page and what it needs) what :func:`page_parts` takes.

    The glyphs become no rows: only pages go in, and what was found on them
    comes out.  Pages are dealt over as many tasks as a shuffle has, since
    they are rows of few bytes and much work.
    """
    pages = pages.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), *PAGE)
    kinds = T.StructType([*pages.select(*PAGE).schema.fields, *T.StructType.fromDDL(PARTS).fields])
    arrow = to_arrow_schema(kinds)

    def run(batches):
        out: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                key = {c: row[c] for c in PAGE}
                out.append({**key, **page_parts({**read(row), **key})})
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return _assembled(stored(pages.mapInArrow(run, kinds)), [], None, None)


def _assembled(parts: DataFrame, more: list[str], lines: DataFrame | None, chars: DataFrame | None) -> Pages:
    """What was found on the pages, put together by documents."""
    pages = parts.select(*PAGE, "width_pt", "height_pt", *more, "chars", "hidden", "invisible_ratio", "unmapped_ratio", "pua_ratio", "max_image_coverage", "text_layer", "mode")
    dims = pages.select(*PAGE, "width_pt", "height_pt", "mode")
    each = lambda name, *other: parts.select(*PAGE, *other, F.inline(name))
    plan, cells = each("plan"), each("cells")
    figures = plan.where("kind IN ('figure', 'caption')")
    tables = each("tables", "width_pt", "height_pt")
    confidence = F.when(F.col("table_no") >= BORDERLESS, C.CONFIDENCE["borderless_table"]).otherwise(C.CONFIDENCE["ruled_table"])
    tables = tables.select(*PAGE, "table_no", F.lit(0).alias("along"), F.lit(1).alias("down"), _unit(tables).alias("box"), "text", confidence.alias("confidence"))
    extras = FG.figure_extras(figures, dims, PAGE)
    if lines is not None:
        extras = extras.unionByName(ocr_extras(lines, chars, pages, figures.select(*PAGE, F.explode("line_ids").alias("line_id"))))
    blocks = FL.fragment_blocks(each("frags"), pages, tables, extras, kept=True)
    return Pages(pages, blocks, cells, plan, each("notes"), parts.select(*PAGE, "layer_chars", "owned", "uses"))
