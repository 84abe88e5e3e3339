"""Tables with merged cells as a relation of anchor cells.

Cells: table_id, n_rows, n_cols, row, col, rowspan, colspan, text, header
('none', 'column' or 'row').
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.config import MAX_CELLS, MAX_EXPANDED_CHARS
from folioflow.functions.text import html_escape


def _ordered(df: DataFrame, keys: list[str], order: str, value, sep: str, name: str) -> DataFrame:
    """Strings of a group joined in order."""
    rows = df.select(*keys, F.struct(F.col(order).alias("o"), value.alias("v")).alias("s"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]), sep).alias(name))


def _every_row(cells: DataFrame) -> DataFrame:
    return cells.select("table_id", "n_rows").distinct().select("table_id", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row"))


def plain_text(cells: DataFrame) -> DataFrame:
    """table_id, plain: rows by line feed, the cells that start in a row by tab; a row without anchors is an empty line."""
    rows = _ordered(cells, ["table_id", "row"], "col", F.col("text"), "\t", "line")
    rows = _every_row(cells).join(rows, ["table_id", "row"], "left").withColumn("line", F.coalesce("line", F.lit("")))
    return _ordered(rows, ["table_id"], "row", F.col("line"), "\n", "plain")


def plain_of(cells: list[tuple[int, int, str]], n_rows: int) -> str:
    """:func:`plain_text` of one table whose cells (row, col, text) are at hand."""
    rows: list[list[str]] = [[] for _ in range(n_rows)]
    for row, _, text in sorted(cells):
        rows[row].append(text)
    return "\n".join("\t".join(row) for row in rows)


def grid(cells: DataFrame) -> DataFrame:
    """table_id, r, c, text, header: the text of a merged cell at every place it covers."""
    rows = cells.withColumn("r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1)))
    return rows.withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1))).select("table_id", "r", "c", "text", "header")


def markdown(cells: DataFrame) -> DataFrame:
    """table_id, md: the grid as a pipe table whose first row is the head."""
    text = F.regexp_replace("text", "\r\n?", "\n")
    for a, b in (("\\", "\\\\"), ("|", "\\|"), ("\n", "<br>")):
        text = F.replace(text, F.lit(a), F.lit(b))
    lines = _ordered(grid(cells), ["table_id", "r"], "c", text, " | ", "line").select("table_id", "r", F.concat(F.lit("| "), "line", F.lit(" |")).alias("line"))
    rule = cells.select("table_id", F.col("n_cols")).distinct().select("table_id", F.lit(0.5).alias("r"), F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("n_cols"))).alias("line"))
    return _ordered(lines.withColumn("r", F.col("r").cast("double")).unionByName(rule), ["table_id"], "r", F.col("line"), "\n", "md")


def header_rows(cells: DataFrame) -> DataFrame:
    """table_id, head: leading rows whose anchors are all column heads, pulled back to where no cell crosses."""
    rows = _every_row(cells).join(cells.groupBy("table_id", "row").agg(F.bool_and(F.col("header") == "column").alias("all_head")), ["table_id", "row"], "left")
    leading = rows.groupBy("table_id").agg(F.coalesce(F.min(F.when(~F.coalesce("all_head", F.lit(False)), F.col("row"))), F.max("row") + 1).alias("lead"))
    blocked = cells.where("rowspan > 1").select("table_id", F.explode(F.sequence(F.col("row") + 1, F.col("row") + F.col("rowspan") - 1)).alias("at")).distinct()
    free = leading.select("table_id", F.explode(F.sequence(F.lit(0), F.col("lead"))).alias("at")).join(blocked, ["table_id", "at"], "left_anti")
    return free.groupBy("table_id").agg(F.max("at").alias("head"))


def to_html(cells: DataFrame) -> DataFrame:
    """table_id, html: thead, tbody, th for head cells, spans where over 1."""
    tag = F.when(F.col("header") != "none", "th").otherwise("td")
    span = lambda n: F.when(F.col(n) > 1, F.concat(F.lit(f' {n}="'), F.col(n).cast("string"), F.lit('"'))).otherwise("")
    text = F.replace(html_escape(F.regexp_replace("text", "\r\n?", "\n")), F.lit("\n"), F.lit("<br>"))
    one = F.concat(F.lit("<"), tag, span("rowspan"), span("colspan"), F.lit(">"), text, F.lit("</"), tag, F.lit(">"))
    rows = _every_row(cells).join(_ordered(cells, ["table_id", "row"], "col", one, "", "tds"), ["table_id", "row"], "left")
    rows = rows.select("table_id", "row", F.concat(F.lit("<tr>"), F.coalesce("tds", F.lit("")), F.lit("</tr>")).alias("tr")).join(header_rows(cells), "table_id")
    part = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("row", "tr")))), lambda s: s["tr"]), "")
    out = rows.groupBy("table_id").agg(part(F.col("row") < F.col("head")).alias("h"), part(F.col("row") >= F.col("head")).alias("b"))
    return out.select("table_id", F.concat(F.lit("<table>"), F.when(F.col("h") != "", F.concat(F.lit("<thead>"), "h", F.lit("</thead>"))).otherwise(""), F.lit("<tbody>"), "b", F.lit("</tbody></table>")).alias("html"))


def violations(cells: DataFrame) -> DataFrame:
    """table_id, problem: out of bounds, repeated anchors, overlaps, places left open, too large."""
    size = cells.select("table_id", "n_rows", "n_cols").distinct()
    bad = cells.where("row < 0 OR col < 0 OR rowspan < 1 OR colspan < 1 OR row + rowspan > n_rows OR col + colspan > n_cols").select("table_id", F.lit("bounds").alias("problem"))
    anchors = cells.groupBy("table_id", "row", "col").count().where("count > 1").select("table_id", F.lit("anchor").alias("problem"))
    ok = cells.where("rowspan >= 1 AND colspan >= 1")
    places = grid(ok).groupBy("table_id", "r", "c").agg(F.count("*").alias("n"))
    overlap = places.where("n > 1").select("table_id", F.lit("overlap").alias("problem"))
    covered = places.join(size, "table_id").where("r < n_rows AND c < n_cols").groupBy("table_id").agg(F.count("*").alias("places"))
    cover = size.join(covered, "table_id", "left").where("coalesce(places, 0) <> cast(n_rows AS bigint) * n_cols").select("table_id", F.lit("cover").alias("problem"))
    large = size.where(F.col("n_rows").cast("bigint") * F.col("n_cols") > MAX_CELLS).select("table_id", F.lit("cells").alias("problem"))
    chars = cells.groupBy("table_id").agg(F.sum(F.length("text").cast("bigint") * F.col("rowspan") * F.col("colspan")).alias("n")).where(F.col("n") > MAX_EXPANDED_CHARS).select("table_id", F.lit("chars").alias("problem"))
    return bad.union(anchors).union(overlap).union(cover).union(large).union(chars).distinct()


def filled_ratio(cells: DataFrame) -> DataFrame:
    """table_id, filled: share of cells with text."""
    return cells.groupBy("table_id").agg((F.count_if(F.trim("text") != "") / F.count("*")).alias("filled"))


def numbered(rows: DataFrame, key: list[str], order: list[str], columns: list[str], table_id: str) -> DataFrame:
    """A relation as a table: one row per record under a head row of column names."""
    w = W.partitionBy(*key).orderBy(*order)
    body = rows.withColumn("row", F.row_number().over(w)).withColumn("n_rows", (F.count("*").over(W.partitionBy(*key)) + 1).cast("int"))
    cells = body.select(F.expr(table_id).alias("table_id"), "n_rows", "row", F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("col", "text"))
    head = cells.select("table_id", "n_rows").distinct().select("table_id", "n_rows", F.lit(0).alias("row"), F.posexplode(F.array(*map(F.lit, columns))).alias("col", "text"))
    both = head.withColumn("header", F.lit("column")).unionByName(cells.withColumn("header", F.lit("none")))
    return both.select("table_id", "n_rows", F.lit(len(columns)).alias("n_cols"), "row", "col", F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), "text", "header")
