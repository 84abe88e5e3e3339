"""Constraint queries: rows that break the document model's invariants; each must come back empty."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.config import MAX_ASSET_BYTES

_STATES = {"det": ["det"], "vlm_running": ["det", "unverified"], "vlm_done": ["det", "vlm"], "vlm_failed": ["det"]}


def block_problems(blocks: DataFrame, versions: DataFrame) -> DataFrame:
    """document_id, version, ord, problem for blocks (kind, has_table, level, state, text_source, page) of known versions."""
    key = ["document_id", "version"]
    w = W.partitionBy(*key).orderBy("ord")
    df = blocks.join(versions.select(*key, "layer_state"), key, "left")
    allowed = F.lit(False)
    for layer, states in _STATES.items():
        allowed = allowed | ((F.col("layer_state") == layer) & F.col("state").isin(states))
    twice = F.lag("ord").over(w) == F.col("ord")
    checks = [
        (F.col("has_table") != (F.col("kind") == "table"), "table"),
        (F.col("level").isNotNull() != (F.col("kind") == "heading"), "level"),
        (F.col("level").isNotNull() & ~F.col("level").between(1, 6), "level range"),
        ((F.col("kind") != "table") & (F.col("text_source") == "mixed"), "mixed"),
        ((F.col("text_source") == "vlm") & (F.col("state") != "vlm"), "source"),
        (F.col("layer_state").isNull(), "version"),
        (F.col("layer_state").isNotNull() & ~allowed, "state"),
        (F.coalesce(twice, F.lit(False)), "order"),
    ]
    found = F.array_compact(F.array(*[F.when(c, n) for c, n in checks]))
    return df.withColumn("found", found).select(*key, "ord", F.explode("found").alias("problem"))


def commit_problems(versions: DataFrame, changes: DataFrame, history: DataFrame, current: DataFrame, referenced: DataFrame, given: DataFrame, stored: DataFrame, most: int = MAX_ASSET_BYTES) -> DataFrame:
    """document_id, problem: what keeps a batch of new versions from being committed.

    versions, changes (with previous_version) and history name the same
    (document_id, version); a document's new versions follow its stored latest
    (current) without a gap or a repeat.  Assets given (document_id, asset,
    bytes) are referenced by their document and hash to their key; referenced
    ones are given or stored (asset, size), and add up to at most ``most``
    bytes a document.
    """
    w = W.partitionBy("document_id").orderBy("version")
    nth = lambda df, *more: df.select("document_id", "version", F.row_number().over(w).alias("_n"), *more)
    new = nth(versions).join(current.select("document_id", F.col("version").alias("latest")), "document_id", "left")
    new = new.withColumn("before", F.coalesce(F.lag("version").over(w), F.col("latest")))
    conflict = new.where("version <> coalesce(before, 0) + 1").select("document_id", F.lit("version").alias("problem"))
    pair = lambda df, *more: nth(df, *more).withColumnRenamed("version", "_v").withColumn("_there", F.lit(True))
    own = new.join(pair(changes, "previous_version"), ["document_id", "_n"], "left")
    change = own.where("_there IS NULL OR _v <> version").select("document_id", F.lit("change").alias("problem"))
    previous = own.where("_there AND NOT (previous_version <=> before)").select("document_id", F.lit("previous").alias("problem"))
    past = new.join(pair(history), ["document_id", "_n"], "left").where("_there IS NULL OR _v <> version").select("document_id", F.lit("history").alias("problem"))
    extra = given.join(referenced, ["document_id", "asset"], "left_anti").select("document_id", F.lit("unreferenced asset").alias("problem"))
    wrong = given.where(F.col("asset") != F.concat(F.lit("sha256:"), F.sha2("bytes", 256))).select("document_id", F.lit("asset hash").alias("problem"))
    sizes = referenced.select("document_id", "asset").distinct().join(given.groupBy("document_id", "asset").agg(F.max(F.octet_length("bytes")).alias("_new")), ["document_id", "asset"], "left").join(stored.select("asset", F.col("size").alias("_old")), "asset", "left")
    sizes = sizes.withColumn("_size", F.coalesce("_new", "_old"))
    missing = sizes.where("_size IS NULL").select("document_id", F.lit("missing asset").alias("problem"))
    large = sizes.groupBy("document_id").agg(F.sum(F.col("_size").cast("bigint")).alias("n")).where(F.col("n") > most).select("document_id", F.lit("asset bytes").alias("problem"))
    out = conflict
    for more in (change, previous, past, extra, wrong, missing, large):
        out = out.union(more)
    return out.distinct()


def batch_problems(frames: dict[str, DataFrame], changes: DataFrame, current: DataFrame, stored: DataFrame) -> DataFrame:
    """document_id, problem: everything that keeps a batch of a store's tables from being published.

    frames: versions, blocks and, if any, pages, regions and assets; current
    (document_id, version) and stored assets (asset, size) are what the store
    holds.  Rows of versions that the batch does not name are problems too.
    """
    versions, blocks = frames["versions"], frames["blocks"]
    key = ["document_id", "version"]
    assets = frames.get("assets")
    figures = blocks.where("figure.asset IS NOT NULL").select("document_id", F.col("figure.asset").alias("asset"))
    given = figures.limit(0).withColumn("bytes", F.lit(None).cast("binary")) if assets is None else assets.select("document_id", "asset", "bytes")
    out = commit_problems(versions, changes, versions, current, figures, given, stored)
    flat = blocks.select(*key, "ord", "kind", F.col("table").isNotNull().alias("has_table"), "level", "state", "text_source")
    out = out.union(block_problems(flat, versions).select("document_id", "problem"))
    out = out.union(caption_problems(blocks.withColumn("caption_block_id", F.col("figure.caption_block_id"))).select("document_id", "problem"))
    twice = blocks.groupBy(*key, "block_id").count().where("count > 1").select("document_id", F.lit("block id").alias("problem"))
    out = out.union(twice)
    if "pages" in frames:
        p = frames["pages"].select("document_id", "page", "width_pt", "height_pt", "rotation", "text_layer", "coverage.*")
        out = out.union(page_problems(p).select("document_id", "problem"))
    for name in ("blocks", "pages", "regions"):
        if name in frames:
            stray = frames[name].join(versions.select(*key), key, "left_anti").select("document_id", F.lit(f"{name} of no version").alias("problem"))
            out = out.union(stray)
    return out.distinct()


def caption_problems(blocks: DataFrame) -> DataFrame:
    """Figures whose caption is no caption block of the tree, and captions with two figures."""
    key = ["document_id", "version"]
    f = blocks.where("caption_block_id IS NOT NULL").select(*key, "block_id", F.col("caption_block_id").alias("c"))
    captions = blocks.where("kind = 'caption'").select(*key, F.col("block_id").alias("c"))
    lost = f.join(captions, [*key, "c"], "left_anti").select(*key, "block_id", F.lit("no caption").alias("problem"))
    shared = f.groupBy(*key, "c").agg(F.count("*").alias("n"), F.min("block_id").alias("block_id")).where("n > 1").select(*key, "block_id", F.lit("shared caption").alias("problem"))
    return lost.union(shared)


def page_problems(pages: DataFrame) -> DataFrame:
    """Pages whose numbers, sizes, rotation, state or ledger contradict."""
    checks = [
        ("page < 1", "number"), ("width_pt <= 0 OR height_pt <= 0", "size"), ("rotation NOT IN (0, 90, 180, 270)", "rotation"), ("text_layer NOT IN ('digital', 'scanned', 'unreliable')", "state"),
        ("layer_chars <> in_blocks + hidden + replaced", "ledger"), ("rescued > in_blocks", "rescued"), ("replaced > 0 AND text_layer <> 'unreliable'", "replaced"),
    ]
    found = F.array_compact(F.array(*[F.when(F.expr(c), n) for c, n in checks]))
    return pages.select("document_id", "page", F.explode(found).alias("problem"))


def png_problem(png):
    """Column of PNG bytes to what is wrong with each (null: nothing): a walk over the chunks."""
    @F.pandas_udf("string")
    def check(data: pd.Series) -> pd.Series:
        return data.map(_png)

    return check(png)


def _png(data: bytes | None) -> str | None:
    if data is None or len(data) > 32 << 20:
        return "size"
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return "signature"
    at, kinds = 8, []
    while at + 12 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if not kinds:
            if kind != b"IHDR" or size != 13:
                return "header"
            w, h = (int.from_bytes(data[at + 8 + k : at + 12 + k], "big") for k in (0, 4))
            if not w or not h or w * h > 40_000_000:
                return "pixels"
        kinds.append(kind)
        at += 12 + size
        if kind == b"IEND":
            return "end" if size or at != len(data) else (None if b"IDAT" in kinds else "data")
    return "truncated"
