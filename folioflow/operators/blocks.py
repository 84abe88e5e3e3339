"""Blocks from specs: order, content hash, occurrence and id; sections and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.functions import text as X


def line_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One paragraph spec per non-blank line: document_id, ord, kind, text, line_start, line_end, and its normal text (``_norm``)."""
    text = F.coalesce(text_col, F.lit(""))
    lines = docs.select(F.col(id_col).alias("document_id"), F.split(text, "\n").alias("raw"), X.normal_lines(text).alias("norm"))
    lines = lines.select("document_id", F.posexplode(F.arrays_zip("raw", "norm")).alias("ord", "z")).where("z.norm <> ''")
    return lines.select("document_id", "ord", F.lit("paragraph").alias("kind"), F.col("z.raw").alias("text"), (F.col("ord") + 1).alias("line_start"), (F.col("ord") + 1).alias("line_end"), F.col("z.norm").alias("_norm"))


def with_ids(specs: DataFrame, level: Column | None = None, table_json: Column | None = None, asset: Column | None = None, nfkc: bool = True, keys: tuple = ("document_id",)) -> DataFrame:
    """Specs (document_id, ord, kind, text) with content_hash, occ and block_id.

    A ``_norm`` column is the normal text, where there is one.  An occurrence
    counts the earlier blocks of the document (or of other ``keys``) with the same hash; one shuffle
    by document and hash, sorted within.
    """
    norm = F.col("_norm") if "_norm" in specs.columns else X.normal_text(F.col("text")) if nfkc else X.collapse(F.col("text"))
    df = specs.withColumn("content_hash", X.content_hash(F.col("kind"), norm, level, table_json, asset))
    w = W.partitionBy(*keys, "content_hash").orderBy("ord")
    df = df.withColumn("occ", F.row_number().over(w) - 1)
    return df.withColumn("block_id", X.block_id(F.col("document_id"), F.col("content_hash"), F.col("occ"))).drop("_norm")


def duplicate_blocks(blocks: DataFrame) -> DataFrame:
    """Contents that occur more than once: content_hash, blocks, documents, first document."""
    return blocks.groupBy("content_hash").agg(F.count("*").alias("blocks"), F.count_distinct("document_id").alias("documents"), F.min("document_id").alias("first_document")).where("blocks > 1")


def section_paths(items: DataFrame, key: str, order: str, level: str, text: str) -> DataFrame:
    """Heading path of every item (level null: not a heading; its own heading is not part of it).

    For each level k below the item's own, the last heading of level k counts
    if no heading of a smaller level came after it.
    """
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col(level) == k, F.struct(F.col(order).alias("at"), F.col(text).alias("text"))), True).over(before) for k in range(1, 7)}
    df = items.withColumns({f"_h{k}": c for k, c in last.items()})
    parts = []
    for k in range(1, 7):
        h = F.col(f"_h{k}")
        ok = h.isNotNull() & (F.col(level).isNull() | (F.col(level) > k))
        for j in range(1, k):
            ok = ok & (F.col(f"_h{j}").isNull() | (F.col(f"_h{j}")["at"] < h["at"]))
        parts.append(F.when(ok, h["text"]))
    return df.withColumn("section_path", F.array_compact(F.array(*parts))).drop(*[f"_h{k}" for k in range(1, 7)])


def heading_levels(lines: DataFrame, key: str, size: str, body: str, bold: str | None = None) -> DataFrame:
    """Heading level of each line by dense rank of the distinct heading sizes, largest first, at most 6; null for others."""
    ratio = F.when(F.col(bold), 1.05).otherwise(1.15) if bold else F.lit(1.15)
    df = lines.withColumn("_heading", F.col(size) >= ratio * F.col(body))
    rank = F.dense_rank().over(W.partitionBy(key, "_heading").orderBy(F.col(size).desc()))
    return df.withColumn("level", F.when(F.col("_heading"), F.least(rank, F.lit(6)))).drop("_heading")


def export_markdown(blocks: DataFrame, key: str = "document_id", order: str = "ord", assets_dir: str | None = None) -> DataFrame:
    """One Markdown text per document from kind, level, text and, where present, table_md, asset and caption."""
    has = set(blocks.columns)
    md = F.when(F.col("kind").isin("page_header", "page_footer"), F.lit(None))
    md = md.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(1))), F.lit(" "), F.col("text")))
    md = md.when((F.col("kind") == "list_item") & ~F.col("text").rlike("^\\d+[.)] "), F.concat(F.lit("- "), F.col("text")))
    if "table_md" in has:
        md = md.when((F.col("kind") == "table") & F.col("table_md").isNotNull(), F.col("table_md"))
    if assets_dir is not None and "asset" in has:
        alt = F.regexp_replace(X.collapse(F.coalesce("caption" if "caption" in has else F.lit(""), F.lit(""))), "([\\\\\\[\\]])", "\\\\$1")
        folder = "/".join(__import__("urllib.parse").parse.quote(p) for p in assets_dir.rstrip("/").split("/"))
        image = F.concat(F.lit("!["), alt, F.lit("]("), F.lit(folder + "/" if folder else ""), F.substring(F.regexp_replace("asset", "^sha256:", ""), 1, 16), F.lit(".png)"))
        md = md.when((F.col("kind") == "figure") & F.col("asset").isNotNull(), F.when(X.collapse(F.col("text")) != "", F.concat(image, F.lit("\n\n"), F.col("text"))).otherwise(image))
    md = md.when((F.col("kind") == "figure") & (X.collapse(F.col("text")) == ""), F.lit(None)).otherwise(F.col("text"))
    parts = blocks.select(key, F.struct(F.col(order).alias("o"), md.alias("md")).alias("s")).where("s.md IS NOT NULL")
    joined = parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["md"]), "\n\n").alias("body"))
    return blocks.select(key).distinct().join(joined, key, "left").select(key, F.when(F.col("body").isNotNull(), F.concat("body", F.lit("\n"))).otherwise("").alias("markdown"))
