"""Pages: glyph statistics, classes, body size, margins, ledgers, text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow import config as C
from folioflow.functions.geometry import rounded
from folioflow.functions.text import is_private_use, normalized

PAGE = ["document_id", "page"]


def statistics(chars: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """Per page: visible non-blank glyphs, shares of hidden, unmapped and private-use ones among all non-blank, image coverage."""
    ink = F.trim("text") != ""
    n = F.count_if(ink)
    share = lambda cond: F.when(n > 0, rounded(F.count_if(ink & cond) / n, 4)).otherwise(0.0)
    out = chars.groupBy(PAGE).agg(F.count_if(ink & ~F.col("invisible")).alias("chars"), share(F.col("invisible")).alias("invisible_ratio"), share(F.col("unmapped")).alias("unmapped_ratio"), share(is_private_use(F.col("text"))).alias("pua_ratio"))
    if coverage is None:
        return out.withColumn("max_image_coverage", F.lit(0.0))
    return out.join(coverage.groupBy(PAGE).agg(rounded(F.max("coverage"), 4).alias("max_image_coverage")), PAGE, "left").fillna(0.0, ["max_image_coverage"])


def classify(stats: DataFrame) -> DataFrame:
    scanned = (F.col("invisible_ratio") >= C.SCANNED_INVISIBLE) | ((F.col("max_image_coverage") >= C.SCANNED_COVERAGE) & (F.col("chars") < C.SCANNED_CHARS))
    unreliable = (F.col("unmapped_ratio") >= C.UNRELIABLE_RATIO) | (F.col("pua_ratio") >= C.UNRELIABLE_RATIO)
    return stats.withColumn("text_layer", F.when(scanned, "scanned").when(unreliable, "unreliable").otherwise("digital"))


def mode_of(state: Column, ocr: Column) -> Column:
    """How a page is read: its layer, the scan above hidden text, or OCR instead of a broken layer."""
    return F.when((state == "scanned") & ocr, "scan").when((state == "unreliable") & ocr, "ocr").otherwise("layer")


def modal(df: DataFrame, keys: list[str], value: str, smaller: bool = True) -> DataFrame:
    """Most frequent value per group; ties go to the smaller (or larger) one.  Counts combine before both shuffles."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    tie = -F.col(value) if smaller else F.col(value)
    return n.groupBy(*keys).agg(F.max_by(value, F.struct("n", tie)).alias(value))


def body_size(chars: DataFrame) -> DataFrame:
    """document_id, body: most frequent half-point size of the visible ink, the smaller on ties."""
    ink = chars.where("NOT invisible AND trim(text) <> ''").select("document_id", (F.bround(F.col("size") / C.SIZE_STEP) * C.SIZE_STEP).alias("body"))
    return modal(ink, ["document_id"], "body")


def ledger(chars: DataFrame, owned: DataFrame) -> DataFrame:
    """Per page: visible ink, how much is in blocks, missing and doubled; ``owned`` holds document_id, page, char_id per use."""
    ink = chars.where("NOT invisible AND trim(text) <> ''").select(*PAGE, "char_id")
    used = owned.groupBy(*PAGE, "char_id").agg(F.count("*").alias("uses"))
    j = ink.withColumn("ink", F.lit(1)).join(used, [*PAGE, "char_id"], "full_outer")
    return j.groupBy(PAGE).agg(F.count("ink").alias("layer_chars"), F.count_if(F.col("ink").isNotNull() & F.col("uses").isNotNull()).alias("in_blocks"), F.count_if(F.col("ink").isNotNull() & F.col("uses").isNull()).alias("missing"), F.sum(F.when(F.col("ink").isNull(), F.col("uses")).otherwise(F.coalesce(F.col("uses") - 1, F.lit(0)))).alias("doubled"))


def repeated_margins(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines of header and footer zones that repeat on half of the pages of documents of three pages or more.

    lines: document_id, page, line_id, text, centre (0..1 from the top);
    pages: document_id, n_pages.  Keys drop digits and blanks; a key without
    letters counts only when it is the zone's sole such line of its page.
    Pairs are formed within a page-position bucket, not over all lines.
    """
    zone = F.when(F.col("centre") <= C.MARGIN_ZONE, "page_header").when(F.col("centre") >= 1 - C.MARGIN_ZONE, "page_footer")
    df = lines.withColumn("zone", zone).where("zone IS NOT NULL").withColumn("key", F.regexp_replace(normalized(F.col("text"), "NFC"), "(?U)[\\d\\s]+", ""))
    letterless = ~F.col("key").rlike("\\p{L}")
    alone = F.count_if(letterless).over(W.partitionBy(*PAGE, "zone"))
    df = df.withColumn("_alone", alone).where(~letterless | (F.col("_alone") == 1)).drop("_alone")
    df = df.join(pages.where(F.col("n_pages") >= C.MARGIN_PAGES), "document_id")
    # counts per place first: repeated positions collapse before the pairing
    places = df.groupBy("document_id", "zone", "key", "centre").agg(F.collect_set("page").alias("at"))
    near = F.floor(F.col("centre") / C.MARGIN_DRIFT)
    a = places.select("document_id", "zone", "key", "centre", near.alias("b"))
    b = places.select("document_id", "zone", "key", F.col("centre").alias("other"), "at", F.explode(F.array(near - 1, near, near + 1)).alias("b"))
    met = a.join(b, ["document_id", "zone", "key", "b"]).where(F.abs(F.col("centre") - F.col("other")) <= C.MARGIN_DRIFT + 1e-9)
    n = met.select("document_id", "zone", "key", "centre", F.explode("at").alias("page")).groupBy("document_id", "zone", "key", "centre").agg(F.count_distinct("page").alias("seen"))
    return df.join(n, ["document_id", "zone", "key", "centre"]).where("2 * seen >= n_pages").select("document_id", "page", "line_id", "zone", "text", "seen")


def gap_groups(df: DataFrame, keys: list[str], start: str, end: str, limit: Column, order: list[str] | None = None) -> DataFrame:
    """Islands in order: a new group where the gap to the previous row exceeds ``limit``; adds group_id from 0."""
    w = W.partitionBy(*keys).orderBy(*(order or [start]))
    cut = (F.col(start) - F.lag(end).over(w)) > limit
    return df.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int")).withColumn("group_id", F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_cut")


def text_of_lines(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Glyphs of a line as text, with a blank where the gap over the tracking exceeds a fifth of the size and no blank stands.

    fragments: keys, x0, x1, size, text; tracking is the upper median of the
    gaps between letters and digits, at most 0.
    """
    w = W.partitionBy(*keys).orderBy("x0", "x1", "text")
    word = lambda c: c.rlike("^[\\p{L}\\p{N}]+$")
    before = F.lag("text").over(w)
    df = fragments.withColumns({"_gap": F.col("x0") - F.lag("x1").over(w), "_big": F.greatest("size", F.lag("size").over(w)), "_in": F.coalesce(word(F.col("text")) & word(before), F.lit(False)), "_open": ~F.trim("text").eqNullSafe("") & ~F.trim(before).eqNullSafe("")})
    every = F.array_sort(F.collect_list(F.when(F.col("_in"), F.col("_gap"))).over(W.partitionBy(*keys)))
    tracking = F.least(F.coalesce(F.get(every, F.floor(F.size(every) / 2).cast("int")), F.lit(0.0)), F.lit(0.0))
    df = df.withColumn("_piece", F.concat(F.when(F.col("_open") & (F.col("_gap") - tracking > C.SPACE_GAP * F.col("_big")), " ").otherwise(""), "text"))
    return df.groupBy(*keys).agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "text", "_piece"))), lambda s: s["_piece"]), "")).alias("line_text"), F.count("*").alias("glyphs"))


def paragraphs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """OCR lines in reading order (seq) to paragraphs: group_id grows where a line does not continue the one before."""
    w = W.partitionBy(*keys).orderBy("seq")
    p = {c: F.lag(c).over(w) for c in ("x0", "y0", "y1")}
    h, own = p["y1"] - p["y0"], F.col("y1") - F.col("y0")
    joins = (F.col("y0") > p["y0"] + 0.5 * h) & (F.col("y0") - p["y1"] <= C.OCR_PARA_GAP * h) & (F.abs(F.col("x0") - p["x0"]) <= C.OCR_INDENT * h) & (F.abs(own - h) <= C.OCR_HEIGHT * h)
    return lines.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("group_id", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("_new")


def ocr_keep(lines: DataFrame, covered: str = "covered") -> DataFrame:
    """OCR lines that count: score, higher for short ones, and not over text that the layer already has."""
    short = F.length(F.regexp_replace("text", "(?U)\\s+", "")) <= C.OCR_SHORT
    return lines.where((F.col("score") >= C.OCR_SCORE) & (~short | (F.col("score") >= C.OCR_SHORT_SCORE)) & (F.col(covered) < C.OCR_OVERLAP))


def merged_order(items: DataFrame, keys: list[str]) -> DataFrame:
    """Order-preserving merge of lists by rounded top: items hold keys, src (rank on ties), seq (place in its list), top.

    A list need not be sorted by top: its running maximum stands for it.
    """
    w = W.partitionBy(*keys, "src").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return items.withColumn("_top", F.max("top").over(w)).withColumn("ord", F.row_number().over(W.partitionBy(*keys).orderBy("_top", "src", "seq")) - 1).drop("_top")
