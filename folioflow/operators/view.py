"""Read views: block rows with labels, page notices, and one HTML page per document."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import locator_label

_PAGE = """<!doctype html><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="default-src 'none'; img-src data:; style-src 'unsafe-inline'; script-src 'unsafe-inline'"><title>{title}</title>
<style>body{{font:15px sans-serif;max-width:60em;margin:auto}}li{{margin:.4em 0}}.added{{background:#e6ffe6}}.updated{{background:#fff7d6}}.removed{{background:#ffe6e6}}small{{color:#777}}td,th{{border:1px solid #999;padding:2px 6px}}</style>
<h1></h1><ol id="b"></ol><h2>removed</h2><ol id="r"></ol>
<script>const d={data};
function grid(t){{const e=document.createElement("table");let row=null,at=-1;for(const c of t.cells){{if(c.row!==at){{row=e.insertRow();at=c.row}}const k=document.createElement(c.header==="none"?"td":"th");k.rowSpan=c.rowspan;k.colSpan=c.colspan;k.textContent=c.text;row.append(k)}}return e}}
function show(list,id,mark){{for(const b of list||[]){{const li=document.createElement("li"),s=document.createElement("small");li.className=mark||b.change||"";s.textContent=" "+(b.where||"")+" "+b.kind+(b.notice?" ("+b.notice+")":"");if(b.table)li.append(grid(b.table));else li.append(b.text||"");li.append(s);document.getElementById(id).append(li)}}}}
document.querySelector("h1").textContent=document.title;show(d.blocks,"b");show(d.removed,"r","removed")</script>"""


def page_states(pages: DataFrame) -> DataFrame:
    """Pages of each document by state of their text layer."""
    return pages.groupBy("document_id", "text_layer").agg(F.count("*").alias("pages"))


def page_notices(pages: DataFrame, blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """document_id, page, notice: what a reader should know of a page's text (null for sound pages).

    pages: text_layer; blocks: page, text_source; regions (the version's
    history): page, fallback_reason, which tells that a page was read again.
    """
    key = ["document_id", "page"]
    ocr = blocks.where("text_source = 'ocr'").select(*key).distinct().withColumn("_ocr", F.lit(True))
    again = regions.where("fallback_reason = 'unreliable_text_layer_ocr'").select(*key).distinct().withColumn("_again", F.lit(True))
    df = pages.join(ocr, key, "left").join(again, key, "left")
    notice = F.when(F.col("text_layer") == "scanned", F.when(F.col("_ocr").isNotNull(), "scanned: text read by OCR, unverified").otherwise("scanned: only visible text became blocks"))
    notice = notice.when(F.col("text_layer") == "unreliable", F.when(F.col("_again").isNotNull(), "broken text layer: read again by OCR, unverified").otherwise("broken text layer: little confidence"))
    return df.select(*key, notice.alias("notice"))


def _fields(df: DataFrame, *more: Column) -> Column:
    """A block as the view shows it, with as much as the frame has."""
    has = set(df.columns)
    out = ["ord", "block_id", "kind", "text"]
    out += [c for c in ("level", "section_path", "confidence", "state", "text_source", "table", "notice", "figure_of") if c in has]
    if "figure" in has:
        out.append(F.when(F.col("figure").isNotNull(), F.struct(F.col("figure.category").alias("category"), F.col("figure.caption_block_id").alias("caption"))).alias("figure"))
    if "locator" in has:
        out += [locator_label(F.col("locator")).alias("where"), F.col("locator.page").alias("page"), F.col("locator.bbox").alias("bbox")]
    elif "line_start" in has:
        out.append(F.concat(F.lit("lines "), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string")).alias("where"))
    return F.struct(*out, *more)


def view_data(blocks: DataFrame, diff: DataFrame | None = None, previous: DataFrame | None = None, notices: DataFrame | None = None) -> DataFrame:
    """document_id, data: the blocks in order as JSON, with what changed and what is gone; ``<`` is escaped for embedding.

    ``diff`` marks blocks as added or updated; the blocks of ``previous`` that
    it lists as removed come along.  A caption names the figure it belongs to,
    a block on a page with a notice carries it.
    """
    df = blocks
    if "figure" in df.columns:
        owner = df.where("figure.caption_block_id IS NOT NULL").select("document_id", F.col("figure.caption_block_id").alias("block_id"), F.col("block_id").alias("figure_of"))
        df = df.join(owner, ["document_id", "block_id"], "left")
    if notices is not None and "locator" in df.columns:
        df = df.withColumn("page", F.col("locator.page")).join(notices, ["document_id", "page"], "left").drop("page")
    more = []
    if diff is not None:
        df = df.join(diff.where("change <> 'removed'").select("document_id", "block_id", "change"), ["document_id", "block_id"], "left")
        more = [F.col("change")]
    packed = df.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block_id", _fields(df, *more).alias("b")))), lambda s: s["b"]).alias("blocks"))
    if diff is not None and previous is not None:
        old = previous.join(diff.where("change = 'removed'").select("document_id", "block_id"), ["document_id", "block_id"], "left_semi")
        gone = old.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block_id", _fields(old).alias("b")))), lambda s: s["b"]).alias("removed"))
        packed = packed.join(gone, "document_id", "full_outer")
    body = F.struct(*[c for c in ("blocks", "removed") if c in packed.columns])
    return packed.select("document_id", F.replace(F.to_json(body), F.lit("<"), F.lit("\\u003c")).alias("data"))


def html_page(title: str, data: str) -> str:
    return _PAGE.format(title=html.escape(title), data=data)


def view_name(name: str) -> str:
    """File name of a view: the source's stem, in NFC."""
    import unicodedata

    stem = name.rsplit("/", 1)[-1]
    return unicodedata.normalize("NFC", stem.rsplit(".", 1)[0] if "." in stem.lstrip(".") else stem) + ".view.html"
