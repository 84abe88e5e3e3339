"""Line deduplication by streaming range-partitioned hashes, in DataFrame and SQL functions only.

Every line of at least ten code points becomes two 64-bit hashes of its key
beside its document and position, never its text.  Lines that a merged
frequent-items sketch names as very common are settled where they are read,
against a broadcast of their exact first documents.  All others are dealt
into ranges of their hash and sorted there by document and position; the
window streams each range and compares every occurrence with the first.  What
comes back are bitmaps of the lines to drop, 64 lines a word, with words that
drop nothing left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.llm.common import materialize, workspace

#: What is stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
#: Code points from which a key counts.
LEAST = 10
#: Most lines that are broadcast; counters of a sketch; groups in which sketches of tasks are merged first.
HEAVY, TRACKED, MERGES = 1024, 8192, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters other than A-Z that ``lower`` may change, unassigned ones included: its tables may be newer than those of patterns.
OTHER_UPPER = r"[\P{ASCII}&&[\p{IsUppercase}\p{Lt}\p{Cn}]]"


def lines_of(text: Column) -> Column:
    """The lines of a text; null as one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def lowered(text: Column) -> Column:
    """A-Z as a-z, all else as it is: ``translate``, which is slow, only where ``lower`` would change more."""
    return F.when((F.char_length(text) == F.octet_length(text)) | ~text.rlike(OTHER_UPPER), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_mark(text: Column) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """h, g (hashes of the key), doc_id, mark (of the text), at (from 0) of every line whose key counts."""
    text = F.col(text_col)
    lines = docs.select(F.col(id_col).alias("doc_id"), text_mark(text).alias("mark"), F.posexplode(lines_of(text)).alias("at", "line"))
    lines = lines.select("doc_id", "mark", "at", F.btrim("line", F.lit(BLANKS)).alias("line")).where(F.char_length("line") >= least)
    keys = lines.select("doc_id", "mark", "at", lowered(F.col("line")).alias("key"))
    return keys.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), F.col("key")).alias("g"), "doc_id", "mark", "at")


def common_lines(hashes: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """h, g, first_doc of the lines that a frequent-items sketch names: at most ``heavy`` hashes, their firsts exact.

    Sketches of the tasks are merged in ``MERGES`` groups before the last step.
    """
    parts = hashes.select("h", F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("part"))
    parts = parts.groupBy("part").agg(F.expr(f"approx_top_k_accumulate(h, {tracked})").alias("sketch"))
    # grouped by a constant: without keys, tasks and tables without rows would give empty sketches, which do not combine
    top = parts.groupBy((F.col("part") * 0).alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch")).select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {heavy})")).alias("t"))
    named = top.select(F.col("t.item").alias("h"))
    counted = hashes.join(F.broadcast(named), "h", "left_semi").groupBy("h", "g").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))
    # of hashes that clash in h alone, the commoner: the bound stays
    best = counted.groupBy("h").agg(F.max(F.struct("n", "g", "first_doc")).alias("s")).where("s.n > 1")
    return materialize(best.select("h", "s.g", "s.first_doc"), "common-lines")


def dropped_lines(hashes: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """doc_id, mark, at of the lines whose key an earlier document holds; null ids come last."""
    common = F.broadcast(common_lines(hashes, heavy, tracked))
    hot = hashes.join(common, ["h", "g"]).where(F.col("first_doc").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    rest = hashes.join(common.select("h", "g"), ["h", "g"], "left_anti")
    # the ranges also cluster (h, g), so the window adds no exchange, only the sort within
    run = W.partitionBy("h", "g").orderBy(F.col("doc_id").asc_nulls_last(), "at").rowsBetween(W.unboundedPreceding, W.currentRow)
    later = rest.repartitionByRange("h", "g").withColumn("first_doc", F.first("doc_id").over(run)).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    columns = ["doc_id", "mark", "at"]
    return hot.select(columns).union(later.select(columns))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """doc_id, mark, words array<struct<word, bits>>, n_dropped of the documents that lose lines.

    Line 64 * word + i is kept unless bit i of ``bits`` is set; words that
    keep all their lines are left out.  Keys of at least ``least`` code points
    that two or more documents hold lose all their lines but in the smallest
    doc_id.  Rows of one doc_id are one document; of their texts each has its
    own bitmap under its ``mark``.  Null ids are one document, which comes
    last.  Null and empty texts have one empty line, which never drops; other
    columns are ignored and an empty table gives an empty result.
    """
    with workspace(docs.sparkSession):
        hashes = materialize(line_hashes(docs, id_col, text_col, least), "line-hashes")
        return materialize(_packed(dropped_lines(hashes, heavy, tracked)), "line-bitmaps", keep=True)


def _packed(gone: DataFrame) -> DataFrame:
    word = gone.select("doc_id", "mark", F.floor(F.col("at") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, at % 64)").alias("bit"))
    words = word.groupBy("doc_id", "mark", "word").agg(F.bit_or("bit").alias("bits"))
    return words.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"), F.sum(F.bit_count("bits")).alias("n_dropped"))


def unpacked(words: Column) -> Column:
    """The bits of all words up to the last that drops a line, in order: one long a word."""
    before = F.concat(F.array(F.lit(-1)), F.transform(words, lambda w: w["word"]))
    fill = lambda w, p: F.concat(F.array_repeat(F.lit(0).cast("bigint"), w["word"] - p - 1), F.array(w["bits"]))
    return F.flatten(F.zip_with(words, F.slice(before, 1, F.size(words)), fill))


def with_kept_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text (the lines that stay, joined by line feeds)."""
    own = bitmaps.select(F.col("doc_id").alias("_line_doc"), F.col("mark").alias("_line_mark"), F.col("n_dropped").alias("_line_n"), unpacked(F.col("words")).alias("_line_bits"))
    both = docs.join(own, F.col(id_col).eqNullSafe(F.col("_line_doc")) & (text_mark(F.col(text_col)) == F.col("_line_mark")), "left")
    bits = lambda i: F.coalesce(F.get(F.col("_line_bits"), F.floor(i / 64).cast("int")), F.lit(0).cast("bigint"))
    stays = F.filter(lines_of(F.col(text_col)), lambda line, i: F.getbit(bits(i), i % 64) == 0)
    kept = F.when(F.col("_line_n").isNull(), F.coalesce(text_col, F.lit(""))).otherwise(F.array_join(stays, "\n"))
    rest = [F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    return both.select(*rest, F.size(lines_of(F.col(text_col))).cast("bigint").alias("n_lines"), F.coalesce("_line_n", F.lit(0)).cast("bigint").alias("n_dropped"), kept.alias("kept_text"))


ORACLE_SQL = """
    WITH l AS (
        SELECT doc_id, s.i AS i, s.x AS x, s.y AS k
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS xs FROM documents),
            LATERAL (SELECT unnest(range(1, len(xs) + 1)) AS i, unnest(xs) AS x, translate(trim(unnest(xs), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS y) s),
    f AS (SELECT k, min(doc_id) AS d FROM l WHERE length(k) >= 10 GROUP BY k),
    m AS (SELECT l.doc_id, i, x, f.d IS NOT NULL AND f.d <> l.doc_id AS gone FROM l LEFT JOIN f USING (k))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id"""
