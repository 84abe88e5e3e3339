"""Versions, differences and the change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.errors import DocumentNotFound, VersionNotFound
from folioflow.operators.grouped import per_group_arrays


def latest(versions: DataFrame, key: str = "document_id", version: str = "version") -> DataFrame:
    """The row of each document's greatest version; combines before its one shuffle."""
    rest = [c for c in versions.columns if c not in (key, version)]
    return versions.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("s")).select(key, "s.*")


def listing(versions: DataFrame, ids: list | None = None, states: list[str] | None = None, state: str = "layer_state") -> DataFrame:
    """Latest versions of the documents in both filters; None filters nothing; in order of id."""
    df = latest(versions)
    if ids is not None:
        df = df.where(F.col("document_id").isin(ids))
    if states is not None:
        df = df.where(F.col(state).isin(states))
    return df.orderBy("document_id")


def tree(blocks: DataFrame, versions: DataFrame, document_id, version: int | None = None) -> DataFrame:
    """Blocks of a document's given or latest version, in order; DocumentNotFound and VersionNotFound tell what is missing."""
    known = versions.where(F.col("document_id") == document_id).select(F.max("version").alias("top"), F.max((F.col("version") == version if version is not None else F.lit(True)).cast("int")).alias("there")).first()
    if known["top"] is None:
        raise DocumentNotFound(f"document not found: {document_id}")
    if not known["there"]:
        raise VersionNotFound(f"version not found: {document_id} {version}")
    return blocks.where((F.col("document_id") == document_id) & (F.col("version") == (version or known["top"]))).orderBy("ord")


def block_diff(old: DataFrame, new: DataFrame, fields: list[str], keys: tuple = ("document_id",)) -> DataFrame:
    """keys, block_id, change, ord: added, updated (a field differs) and removed blocks by one full outer join.

    Blocks with equal ``keys`` are compared; add ``version`` to compare several pairs of one document at once.
    """
    pack = lambda df, name: df.select(*keys, "block_id", F.struct(*fields).alias(name), F.col("ord").alias(f"{name}_ord"))
    j = pack(old, "o").join(pack(new, "n"), [*keys, "block_id"], "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "updated")
    return j.select(*keys, "block_id", change.alias("change"), F.coalesce("n_ord", "o_ord").alias("ord")).where("change IS NOT NULL")


def change_sets(diff: DataFrame, keys: tuple = ("document_id",)) -> DataFrame:
    """Per document (or other keys) the ids added and updated (new order) and removed (old order)."""
    pick = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("change") == name, F.struct("ord", "block_id")))), lambda s: s["block_id"]).alias(name)
    return diff.groupBy(*keys).agg(*[pick(n) for n in ("added", "updated", "removed")])


def successive(stored: DataFrame, new: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(old, new) rows that meet under (document_id, version): what each of the new ``versions`` is compared with.

    ``stored`` holds the rows of the latest stored versions, ``new`` those of
    the new ones, of which a document may have several in a row.
    """
    before = stored.unionByName(new, allowMissingColumns=True).withColumn("version", (F.col("version") + 1).cast("int"))
    return before.join(versions.select("document_id", "version"), ["document_id", "version"], "left_semi"), new


def arrivals(files: DataFrame, force: bool = False) -> DataFrame:
    """``files`` (document_id, arrival, source_hash, latest, stored_hash) with ``version`` and ``fresh``.

    The files of a document follow each other by ``arrival`` from its stored
    latest version on: one with the bytes of the one before is that version
    again, any other the next one.  Versions are a running count of the
    changes, so nothing loops over a document's files.
    """
    w = W.partitionBy("document_id").orderBy("arrival")
    before = F.coalesce(F.lag("source_hash").over(w), F.col("stored_hash"))
    fresh = F.lit(True) if force else ~before.eqNullSafe(F.col("source_hash"))
    df = files.withColumn("fresh", fresh)
    run = F.sum(F.col("fresh").cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return df.withColumn("version", (F.coalesce("latest", F.lit(0)) + run).cast("int"))


def lineage(old: DataFrame, new: DataFrame, keys: tuple = ("document_id",)) -> DataFrame:
    """Blocks of one region under another id: replaced."""
    a = old.where("region_id IS NOT NULL").select(*keys, "region_id", F.col("block_id").alias("old_id"))
    b = new.where("region_id IS NOT NULL").select(*keys, "region_id", F.col("block_id").alias("new_id"))
    return a.join(b, [*keys, "region_id"]).where("old_id <> new_id").select(*keys, "old_id", "new_id", F.lit("replaced").alias("kind")).distinct()


def page_of_changes(log: DataFrame, cursor: int | None, limit: int = 100) -> tuple[DataFrame, dict]:
    """Changes after a cursor in order, and the batch's header.

    The page is a top-k; a cursor beyond the log asks for a resync.
    """
    if limit < 1 or (cursor is not None and cursor < 0):
        raise ValueError("limit must be at least 1 and cursor at least 0")
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    if cursor is not None and cursor > last:
        return log.limit(0), {"cursor_from": cursor, "next_cursor": cursor, "resync_required": True}
    page = log.where(F.col("seq") > (cursor or 0)).orderBy("seq").limit(limit)
    top = page.agg(F.max("seq")).first()[0]
    return page, {"cursor_from": cursor, "next_cursor": top if top is not None else (cursor or 0), "resync_required": False}


def chain_violations(log: DataFrame) -> DataFrame:
    """Changes whose previous_version is not the version before, or whose version does not grow."""
    w = W.partitionBy("document_id").orderBy("seq")
    before = F.lag("version").over(w)
    return log.withColumn("expected", before).where("NOT (previous_version <=> expected) OR version <= coalesce(expected, 0)")


def asset_problems(referenced: DataFrame, supplied: DataFrame, stored: DataFrame) -> DataFrame:
    """asset, problem: supplied but not referenced, referenced but nowhere, or bytes that do not hash to the key."""
    extra = supplied.join(referenced, "asset", "left_anti").select("asset", F.lit("unreferenced").alias("problem"))
    missing = referenced.join(supplied, "asset", "left_anti").join(stored, "asset", "left_anti").select("asset", F.lit("missing").alias("problem"))
    wrong = supplied.where(F.col("asset") != F.concat(F.lit("sha256:"), F.sha2("bytes", 256))).select("asset", F.lit("hash").alias("problem"))
    return extra.union(missing).union(wrong).distinct()


def new_assets(supplied: DataFrame, stored: DataFrame) -> DataFrame:
    """Assets to append: one row per hash, none that is stored."""
    return supplied.dropDuplicates(["asset"]).join(stored, "asset", "left_anti")


def asset_budget(items: DataFrame, key: str, order: str, asset: str, size: str, budget: int) -> DataFrame:
    """Greedy in order: an asset already taken is free, one that would exceed the budget is skipped, later smaller ones may fit.

    What is spent only grows, so an occurrence counts only if it is smaller
    than all before it of its asset: of an asset that has one size, the
    first.  They stream in order, with what is taken as state.  Rows without
    asset or size are never taken.
    """
    before = F.min(size).over(W.partitionBy(key, asset).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    known = F.col(asset).isNotNull() & F.col(size).isNotNull()
    rows = items.withColumn("_b", before).where("_b IS NULL OR `%s` < _b" % size)
    rows = rows.select(key, F.col(order).alias("_o"), F.coalesce(asset, F.lit("")).alias("_a"), F.when(known, F.col(size)).otherwise(budget + 1).cast("bigint").alias("_s"))

    def one(g) -> list[dict]:
        spent, taken = 0, set()
        for a, s in zip(g["_a"].tolist(), g["_s"].tolist()):
            if a not in taken and spent + s <= budget:
                spent += s
                taken.add(a)
        return [{"spent": spent, "assets": len(taken), "taken": ",".join(sorted(taken))}]

    return per_group_arrays(rows, [key], ["_o"], one, "spent bigint, assets int, taken string")
