"""Exact deduplication with a heavy-hitter split, in DataFrame and SQL functions only.

A Misra-Gries family sketch (``approx_top_k``, merged from partial sketches)
names the digests that may be frequent.  Their exact counts and smallest ids
are taken in a second pass; the verified winners, at most ``heavy`` rows by
construction, are broadcast, so rows of large copy groups are settled where
they are read and never shuffled.  All other digests are counted with a
combine before the shuffle, and their rows take the counts in an ordinary
join, which Spark may split where a group is still large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import materialize

#: Most digests that are broadcast, and counters that the sketch tracks.
HEAVY, TRACKED = 256, 8192


def normalized(text: Column) -> Column:
    """Null as empty; every run of blanks and U+0009..000D as one blank."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row per input row.

    Texts are equal when identical after :func:`normalized`.  The row with
    the smallest id stays; null ids sort last and repeated rows with the
    smallest id all stay (they carry one id).  A group whose ids are all null
    keeps its rows.  Other columns of the input are ignored; an empty table
    gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalized(F.col(text_col)), 256).alias("text_sha256"))
    rows = materialize(rows, "digests")
    named = rows.agg(F.expr(f"approx_top_k(text_sha256, {heavy}, {tracked})").alias("top")).select(F.explode("top").alias("t")).select(F.col("t.item").alias("text_sha256"))
    # at most `heavy` rows, whatever the input
    counted = rows.join(F.broadcast(named), "text_sha256", "left_semi").groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = materialize(counted.where("group_size > 1"), "winners")
    hot = rows.join(F.broadcast(winners), "text_sha256")
    rest = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    groups = rest.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    cold = rest.join(groups, "text_sha256")
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    return hot.select(columns).union(cold.select(columns)).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
