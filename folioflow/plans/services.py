"""Queries over figures, image-model steps, normal forms, views, and the engine from files to feed."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow import schemas as S
from folioflow.functions import text as X
from folioflow.operators import blocks as B
from folioflow.operators import figures as FG
from folioflow.operators import integrity as I
from folioflow.operators import ocr as O
from folioflow.operators import versions as V
from folioflow.operators import view as VW
from folioflow.plans.queries import _IDS, _LINES, _TWO, _blocks, _t, _two_versions, query, spread
from folioflow.sources.storage import Store, shared_path

# --- normal forms -----------------------------------------------------------------------------------


@query("""SELECT n_nationkey, lower(n_name) || ' fi A1 1 (3) a o km ' || chr(54620) || ' x' AS t, chr(233) || n_name AS nfc FROM nation""")
def normal_forms(spark, sf_dir):
    """Ligatures, wide letters, circled numbers, combining marks, jamo and odd blanks."""
    odd = F.concat(F.lower("n_name"), F.lit("  ﬁ　Ａ１ ① ⑶ ª º ㎞\x1c한\tx "))
    return _t(spark, sf_dir, "nation").select("n_nationkey", X.normal_text(odd).alias("t"), X.normalized(F.concat(F.lit("é"), "n_name"), "NFC").alias("nfc"))


# --- figures -----------------------------------------------------------------------------------------


def _sides(x0, y0, x1, y1):
    return [F.lit(float(v)).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1))]


def _figure_pages(spark, sf_dir):
    """A page a customer: two charts in a box, a photo with a caption below, a table with a title, an ornament, a table inside a chart."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), "c_name")
    pages = c.select("page", F.lit("layer").alias("mode"), F.lit(600.0).alias("width_pt"), F.lit(800.0).alias("height_pt"))
    region = lambda cls, score, *b: c.select("page", F.lit(cls).alias("cls"), F.lit(score).alias("score"), *_sides(*b))
    rows = [("chart", 0.9, 50, 50, 250, 200), ("chart", 0.8, 300, 50, 500, 200), ("image", 0.7, 40, 40, 520, 210), ("chart", 0.55, 52, 52, 248, 198), ("image", 0.9, 105, 305, 295, 445), ("figure_title", 0.6, 110, 455, 290, 467), ("figure_title", 0.9, 100, 580, 300, 592), ("table", 0.9, 100, 600, 300, 700), ("seal", 0.9, 400, 600, 500, 700), ("chart", 0.3, 400, 300, 500, 400)]
    regions = region(*rows[0])
    for r in rows[1:]:
        regions = regions.unionByName(region(*r))
    images = c.select("page", *_sides(100, 300, 300, 450)).unionByName(c.select("page", *_sides(405, 605, 495, 695))).unionByName(c.select("page", *_sides(500, 700, 510, 710)))
    tables = c.select("page", F.lit(0).alias("table_no"), *_sides(100, 600, 300, 700)).unionByName(c.select("page", F.lit(1).alias("table_no"), *_sides(60, 60, 200, 150)))
    text = lambda t, x, y: c.select("page", F.lit(y).alias("base"), F.lit(x).alias("x"), t.alias("s"))
    s = text(F.col("c_name"), 120.0, 465.0).unionByName(text(F.lit("Prices"), 110.0, 590.0)).unionByName(text(F.concat(F.lit("bar "), F.col("page").cast("string")), 320.0, 100.0))
    g = s.select("page", "base", "x", F.posexplode(F.split("s", "")).alias("i", "text")).select("page", (F.col("base").cast("bigint") * 1000 + F.col("i")).alias("char_id"), "text", (F.col("x") + F.col("i") * 5).alias("x0"), (F.col("base") - 7).alias("y0"), (F.col("x") + F.col("i") * 5 + 5).alias("x1"), (F.col("base") + 2).alias("y1"), F.col("base").alias("baseline"), F.lit(9.0).alias("size"), F.lit(False).alias("invisible"))
    return pages, regions, images, tables, g


_PLAN_ROWS = "(VALUES ('figure', 0, 'chart', 0.9, true, 50.0, 50.0, 250.0, 200.0, 0), ('figure', 1, 'chart', 0.8, true, 300.0, 50.0, 500.0, 200.0, 1), ('figure', 2, 'image', 0.9, true, 100.0, 300.0, 300.0, 450.0, 0), ('caption', 0, NULL, NULL, NULL, 110.0, 455.0, 290.0, 467.0, 2), ('table', 0, NULL, NULL, true, 100.0, 600.0, 300.0, 700.0, 3), ('dropped', 1, NULL, NULL, false, 60.0, 60.0, 200.0, 150.0, 3)) v(kind, item_no, category, score, model, x0, y0, x1, y1, t)"


@query(f"""SELECT c_custkey AS page, kind, CAST(item_no AS INTEGER) AS item_no, category, CAST(score AS DOUBLE) AS score, model, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CASE t WHEN 0 THEN '' WHEN 1 THEN 'bar ' || c_custkey WHEN 2 THEN c_name END AS text, CAST(CASE WHEN kind = 'figure' AND item_no = 2 THEN 0 END AS INTEGER) AS caption_no FROM customer, {_PLAN_ROWS}""")
def page_plan(spark, sf_dir):
    pages, regions, images, tables, g = _figure_pages(spark, sf_dir)
    return FG.page_plan(pages, regions, ["page"], images, tables, g).select("page", "kind", "item_no", "category", "score", "model", "x0", "y0", "x1", "y1", "text", "caption_no")


@query("""SELECT c_custkey AS page, CAST(e AS INTEGER) AS extra_no, kind, CASE t WHEN 0 THEN '' WHEN 1 THEN 'bar ' || c_custkey ELSE c_name END AS text, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(top AS DOUBLE) AS top
    FROM customer, (VALUES (1, 'figure', 0, 0.083, 0.062, 0.417, 0.25, 0.0625), (4, 'figure', 1, 0.5, 0.062, 0.833, 0.25, 0.0625), (7, 'figure', 0, 0.167, 0.375, 0.5, 0.562, 0.375), (8, 'caption', 2, 0.183, 0.569, 0.483, 0.584, 0.375)) v(e, kind, t, x0, y0, x1, y1, top)""")
def figure_specs(spark, sf_dir):
    pages, regions, images, tables, g = _figure_pages(spark, sf_dir)
    plan = FG.page_plan(pages, regions, ["page"], images, tables, g)
    return FG.figure_extras(plan, pages, ["page"]).select("page", "extra_no", "kind", "text", "box.*", "top")


@query("""WITH r AS (SELECT o_custkey AS page, o_orderkey AS id, (o_orderkey % 40) * 20.0 AS pos, (o_orderkey % 7) * 10.0 AS s, (o_orderkey % 7) * 10.0 + 150 + o_orderkey % 100 AS e FROM orders), l AS (SELECT DISTINCT page, pos FROM r WHERE e - s >= 180 AND NOT (pos BETWEEN 198 AND 402 AND s >= 18 AND e <= 602)),
    m AS (SELECT page, pos, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN s > pe + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY page, pos ORDER BY s, e) AS g FROM (SELECT *, max(e) OVER (PARTITION BY page, pos ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM r)) GROUP BY page, pos, g)
    SELECT page, count(DISTINCT pos) AS rules FROM m WHERE e - s >= 180 AND NOT (pos BETWEEN 198 AND 402 AND s >= 18 AND e <= 602) GROUP BY page""")
def table_rules(spark, sf_dir):
    k = F.col("o_orderkey")
    r = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.lit("h").alias("axis"), (k % 40 * 20.0).alias("pos"), (k % 7 * 10.0).alias("start"), (k % 7 * 10.0 + 150 + k % 100).alias("end"))
    pages = r.select("page").distinct()
    return FG.table_rules(r, pages.select("page", *_sides(20, 200, 600, 400)), pages.withColumn("width_pt", F.lit(600.0)), ["page"])


@query("""WITH r AS (SELECT o_custkey AS page, count(DISTINCT o_orderkey % 3) AS n FROM orders GROUP BY 1) SELECT c_custkey AS page, c_custkey % 5 = 0 OR c_custkey % 17 >= 10 OR c_custkey % 4 = 1 OR coalesce(n, 0) >= 3 AS wanted FROM customer LEFT JOIN r ON page = c_custkey""")
def layout_wanted(spark, sf_dir):
    c = F.col("c_custkey")
    pages = _t(spark, sf_dir, "customer").select(c.alias("page"), F.when(c % 5 == 0, "scan").otherwise("layer").alias("mode"), (c % 17).alias("paths"))
    rules = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.count_distinct(F.col("o_orderkey") % 3).alias("rules"))
    return FG.wants_layout(pages, pages.where("page % 4 = 1").select("page"), rules, ["page"]).select("page", "wanted")


# --- image-model steps -------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name AS text, 0.9::DOUBLE AS score FROM nation")
def decoded_lines(spark, sf_dir):
    """Greedy decoding of names spelt as probabilities: every letter twice, a blank between."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ _0123456789"
    n, m = _t(spark, sf_dir, "nation"), len(letters)
    hot = lambda at, p: F.transform(F.sequence(F.lit(0), F.lit(m)), lambda k: F.when(k == at, p).otherwise(0.001))
    at = lambda ch: F.instr(F.lit(letters), ch)
    spelt = F.flatten(F.transform(F.split("n_name", ""), lambda ch: F.array(hot(at(ch), 0.9), hot(at(ch), 0.9), hot(F.lit(0), 0.95))))
    return O.decoded_lines(n.select("n_nationkey", spelt.alias("probabilities")), ["n_nationkey"], ["", *letters])


@query("""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, id) AS n FROM (SELECT o_custkey AS page, o_orderkey AS id, CAST(o_orderkey % 23 AS INTEGER) - 1 AS c, (o_orderkey * 7 % 97) / 97.0::DOUBLE AS score, (o_orderkey * 13 % 700 - 50)::DOUBLE AS x0, (o_orderkey * 29 % 900 - 40)::DOUBLE AS y0,
        (o_orderkey * 13 % 700 + 250)::DOUBLE AS x1, (o_orderkey * 29 % 900 + 160)::DOUBLE AS y1 FROM orders) WHERE score >= 0.2 AND c BETWEEN 0 AND 19),
    f(page, n, kept) AS (SELECT page, 0::BIGINT, []::STRUCT(id BIGINT, c INTEGER, score DOUBLE, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[] FROM (SELECT DISTINCT page FROM s)
        UNION ALL SELECT f.page, s.n, CASE WHEN len(list_filter(f.kept, lambda k: @I@ / ((k.x1 - k.x0) * (k.y1 - k.y0) + (s.x1 - s.x0) * (s.y1 - s.y0) - @I@) > CASE WHEN k.c = s.c THEN 0.6 ELSE 0.98 END)) = 0 THEN list_append(f.kept, {'id': s.id, 'c': s.c, 'score': s.score, 'x0': s.x0, 'y0': s.y0, 'x1': s.x1, 'y1': s.y1}) ELSE f.kept END FROM f JOIN s ON s.page = f.page AND s.n = f.n + 1),
    u AS (SELECT page, unnest(kept) AS b FROM (SELECT page, arg_max(kept, n) AS kept FROM f GROUP BY page))
    SELECT page, b.id AS row_no, b.c AS cls_id, b.score AS score, greatest(b.x0, 0) AS x0, greatest(b.y0, 0) AS y0, least(b.x1, 800)::DOUBLE AS x1, least(b.y1, 900)::DOUBLE AS y1 FROM u WHERE least(b.x1, 800) > greatest(b.x0, 0) AND least(b.y1, 900) > greatest(b.y0, 0)""".replace("@I@", "(greatest(least(k.x1, s.x1) - greatest(k.x0, s.x0), 0) * greatest(least(k.y1, s.y1) - greatest(k.y0, s.y0), 0))"))
def layout_boxes(spark, sf_dir):
    k = F.col("o_orderkey")
    x, y = (k * 13 % 700 - 50).cast("double"), (k * 29 % 900 - 40).cast("double")
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), k.alias("row_no"), (k % 23 - 1).alias("cls_id"), (k * 7 % 97 / 97.0).alias("score"), x.alias("x0"), y.alias("y0"), (x + 300).alias("x1"), (y + 200).alias("y1"), F.lit(800).alias("width"), F.lit(900).alias("height"))
    number = F.array_position(F.array(*map(F.lit, O.LAYOUT_CLASSES)), F.col("cls")) - 1
    return O.layout_boxes(rows, ["page"]).withColumn("cls_id", number.cast("int")).drop("cls")


@query("""SELECT o_orderkey, greatest((o_orderkey % 1700 - 20) * (612.0::DOUBLE / 1700), 0) AS x0, greatest((o_orderkey % 2200) * (792.0::DOUBLE / 2200), 0) AS y0, least((o_orderkey % 1700 + 180) * (612.0::DOUBLE / 1700), 612) AS x1, least((o_orderkey % 2200 + 40) * (792.0::DOUBLE / 2200), 792) AS y1 FROM orders""")
def pixel_points(spark, sf_dir):
    k = F.col("o_orderkey")
    b = _t(spark, sf_dir, "orders").select(k, (k % 1700 - 20).cast("double").alias("x0"), (k % 2200).cast("double").alias("y0"), (k % 1700 + 180).cast("double").alias("x1"), (k % 2200 + 40).cast("double").alias("y1"), F.lit(1700).alias("width"), F.lit(2200).alias("height"), F.lit(612.0).alias("width_pt"), F.lit(792.0).alias("height_pt"))
    return O.to_points(b).select("o_orderkey", "x0", "y0", "x1", "y1")


def _drawn_images(spark, sf_dir):
    """An image a supplier: two dark bars, whose shade is a letter and whose width the key."""
    @F.pandas_udf("binary")
    def pixels(key: pd.Series) -> pd.Series:
        def one(k: int) -> bytes:
            page = np.full((120, 240, 3), 255, np.uint8)
            page[20:40, 20 : 80 + 20 * (k % 4)] = 10 * (k % 7)
            page[75:95, 30:170] = 10 * (k % 5)
            return page.tobytes()

        return key.map(one)

    return spread(_t(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").select("s_suppkey", F.lit(120).alias("height"), F.lit(240).alias("width"), pixels("s_suppkey").alias("pixels"))


def _shade_models():
    """Models of those images: text is what is dark, and a line's letter is its darkest shade."""
    detector = lambda x: (x[0].mean(0) < 0).astype(np.float32)

    def recogniser(lines):
        out = np.zeros((len(lines), 3, 9), np.float32)
        out[:, :, 0] = 1.0
        shade = np.rint((np.array([line.min() for line in lines]) + 1) * 12.75).astype(int)
        out[np.arange(len(lines)), 1, 0] = 0.0
        out[np.arange(len(lines)), 1, shade + 1] = 1.0
        return out

    return detector, recogniser


@query("""SELECT s_suppkey, CAST(l AS INTEGER) AS line_id, chr(CAST(97 + s_suppkey % (7 - 2 * l) AS INTEGER)) AS text, true AS placed FROM supplier, range(2) r(l)""")
def image_lines(spark, sf_dir):
    """Lines read from images of many pages, batched together, each over the bar that was drawn."""
    lines = O.image_lines(_drawn_images(spark, sf_dir), ["s_suppkey"], _shade_models, ["", *"abcdefgh"])
    left, right = F.array_min(F.filter("quad", lambda v, i: i % 2 == 0)), F.array_max(F.filter("quad", lambda v, i: i % 2 == 0))
    end = F.when(F.col("line_id") == 0, 80 + 20 * (F.col("s_suppkey") % 4)).otherwise(170)
    start = F.when(F.col("line_id") == 0, 20).otherwise(30)
    # the box is the bar grown on all sides by 1.6 times its area over its girth
    width = end - start
    grown = 1.6 * width * 20 / (2 * (width + 20))
    near = lambda a, b: F.abs(a - F.least(F.greatest(b, F.lit(0.0)), F.lit(239.0))) <= 2
    return lines.select("s_suppkey", "line_id", "text", (near(left, start - grown) & near(right, end + grown)).alias("placed"))


# --- views ---------------------------------------------------------------------------------------------


@query(f"""WITH {_TWO}, r AS (SELECT v, doc_id, ord, i.block_id, CASE WHEN v = 2 AND ord % 13 = 5 THEN txt || ' edited' ELSE txt END AS txt FROM i JOIN (SELECT doc_id, ord, txt FROM l WHERE txt <> '') USING (doc_id, ord))
    SELECT b.doc_id AS document_id, CAST(b.ord AS INTEGER) AS ord, b.block_id, sha256(b.txt) AS digest, 'lines ' || (b.ord + 1) || '-' || (b.ord + 1) AS "where", coalesce(d.change, '') AS change FROM (SELECT * FROM r WHERE v = 2) b LEFT JOIN d ON d.document_id = b.doc_id AND d.block_id = b.block_id AND d.change <> 'removed'
    UNION ALL SELECT a.doc_id, CAST(a.ord AS INTEGER), a.block_id, sha256(a.txt), 'lines ' || (a.ord + 1) || '-' || (a.ord + 1), 'removed' FROM (SELECT * FROM r WHERE v = 1) a JOIN d ON d.document_id = a.doc_id AND d.block_id = a.block_id AND d.change = 'removed'""")
def view_contents(spark, sf_dir):
    """The view's JSON read back: every block's text, place and change, and what is gone."""
    old, new = _two_versions(spark, sf_dir)
    data = VW.view_data(new, V.block_diff(old, new, ["ord", "line_start"]), old)
    one = "array<struct<ord: int, block_id: string, text: string, where: string, change: string>>"
    read = data.select("document_id", F.from_json("data", f"blocks {one}, removed {one}").alias("d"))
    part = lambda name, change: read.select("document_id", F.inline(f"d.{name}")).select("document_id", "ord", "block_id", F.sha2(F.trim(F.regexp_replace("text", "(?U)[\\s\\x1c-\\x1f]+", " ")), 256).alias("digest"), "where", change.alias("change"))
    return part("blocks", F.coalesce("change", F.lit(""))).unionByName(part("removed", F.lit("removed")))


@query("""WITH p AS (SELECT o_custkey AS document_id, CAST(o_orderkey AS INTEGER) AS page, CASE o_orderkey % 3 WHEN 0 THEN 'scanned' WHEN 1 THEN 'unreliable' ELSE 'digital' END AS s, o_orderkey % 2 = 0 AS o, o_orderkey % 5 = 0 AS a FROM orders)
    SELECT document_id, page, CASE WHEN s = 'scanned' AND o THEN 'scanned: text read by OCR, unverified' WHEN s = 'scanned' THEN 'scanned: only visible text became blocks' WHEN s = 'unreliable' AND a THEN 'broken text layer: read again by OCR, unverified' WHEN s = 'unreliable' THEN 'broken text layer: little confidence' END AS notice FROM p""")
def page_notices(spark, sf_dir):
    k = F.col("o_orderkey")
    p = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), k.cast("int").alias("page"), F.when(k % 3 == 0, "scanned").when(k % 3 == 1, "unreliable").otherwise("digital").alias("text_layer"))
    blocks = p.select("document_id", "page", F.when(F.col("page") % 2 == 0, "ocr").otherwise("text_layer").alias("text_source"))
    return VW.page_notices(p, blocks, p.where("page % 5 = 0").withColumn("fallback_reason", F.lit("unreliable_text_layer_ocr"))).select("document_id", "page", "notice")


@query(f"""WITH {_TWO}, r AS (SELECT i.*, 'r' || (ord % 50) AS region FROM i) SELECT DISTINCT a.doc_id AS document_id, a.block_id AS old_id, b.block_id AS new_id, 'replaced' AS kind FROM (SELECT * FROM r WHERE v = 1) a JOIN (SELECT * FROM r WHERE v = 2) b ON a.doc_id = b.doc_id AND a.region = b.region AND a.block_id <> b.block_id""")
def block_lineage(spark, sf_dir):
    old, new = (df.withColumn("region_id", F.concat(F.lit("r"), (F.col("ord") % 50).cast("string"))) for df in _two_versions(spark, sf_dir))
    return V.lineage(old, new)


# --- the store -------------------------------------------------------------------------------------------


_COMMIT = """k AS (SELECT o_orderkey AS d, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS version, CAST(CASE WHEN o_orderkey % 3 < 2 THEN 1 END AS INTEGER) AS latest, 'sha256:' || sha256(CAST(o_orderkey % 50 AS VARCHAR)) AS asset, o_orderkey % 50 AS a FROM orders)"""


@query(f"""WITH {_COMMIT} SELECT d AS document_id, p AS problem FROM (SELECT d, 'version' AS p FROM k WHERE version <> coalesce(latest, 0) + 1 UNION SELECT d, 'change' FROM k WHERE d % 5 = 0 UNION SELECT d, 'previous' FROM k WHERE d % 7 = 0 UNION SELECT d, 'history' FROM k WHERE d % 11 = 0
    UNION SELECT d, 'unreferenced asset' FROM k WHERE d % 13 = 0 AND d % 4 = 1 UNION SELECT d, 'asset hash' FROM k WHERE d % 16 = 0 UNION SELECT d, 'missing asset' FROM k WHERE d % 4 = 0 AND d % 8 <> 0 AND a >= 25 UNION SELECT d, 'asset bytes' FROM k WHERE d % 4 = 0 AND d % 8 <> 0 AND a < 25 AND a % 2 = 0)""")
def commit_violations(spark, sf_dir):
    k = F.col("o_orderkey")
    o = _t(spark, sf_dir, "orders").select(k, k.alias("document_id"), F.when(k % 3 == 0, 2).otherwise(1).alias("version"), F.when(k % 3 < 2, 1).alias("latest"), X.asset_key((k % 50).cast("string").cast("binary")).alias("asset"), (k % 50).cast("string").cast("binary").alias("bytes"))
    changes = o.select("document_id", (F.col("version") + F.when(k % 5 == 0, 1).otherwise(0)).alias("version"), F.when(k % 7 == 0, 9).otherwise(F.col("latest")).alias("previous_version"))
    given = o.where((k % 8 == 0) | ((k % 13 == 0) & (k % 4 == 1))).select("document_id", "asset", F.when(k % 16 == 0, F.lit("?").cast("binary")).otherwise(F.col("bytes")).alias("bytes"))
    stored = o.where(k % 50 < 25).groupBy("asset").agg(F.max(F.when(k % 2 == 0, 1000).otherwise(10)).alias("size"))
    return I.commit_problems(o, changes, o.where(k % 11 != 0), o.where("latest IS NOT NULL").select("document_id", F.col("latest").alias("version")), o.where(k % 4 == 0).select("document_id", "asset"), given, stored, 100)


_STORES: dict = {}


def _once(spark, sf_dir, make):
    """What ``make`` builds of the tables: once a session, as several queries read it."""
    key = (spark.sparkContext.applicationId, sf_dir, make.__name__)
    if key not in _STORES:
        from folioflow.engine import Engine

        _STORES[key] = make(Engine(spark, f"{shared_path(spark)}/folio-store-{uuid.uuid4().hex[:12]}"), spark, sf_dir)
    return _STORES[key]


def _engine(spark, sf_dir):
    return _once(spark, sf_dir, _two_rounds)


def _two_rounds(engine, spark, sf_dir):
    """A store after two rounds of the documents' lines as Markdown files: the second with more text in every third one."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t: F.trim(F.regexp_replace(t, "[^\\p{L}]+", " "))), lambda t: t != "")
    text, d = F.array_join(lines, "\n\n"), F.col("doc_id")
    name = F.concat(d.cast("string"), F.when(d % 10 == 7, ".txt").otherwise(".md"))
    content = lambda t: F.when(d % 10 == 9, F.lit(bytearray(b"\xff\xff\xff"))).otherwise(F.encode(t, "UTF-8"))
    docs = _t(spark, sf_dir, "documents")
    files = lambda t: docs.select(d.cast("string").alias("document_id"), name.alias("name"), content(t).alias("content"))
    first = engine.ingest(files(text))
    second = engine.ingest(files(F.when(d % 3 == 0, F.concat(text, F.lit("\n\nadded line here"))).otherwise(text)))
    return engine, first, second


_INGEST = f"""{_LINES}, t AS (SELECT doc_id, ord, trim(regexp_replace(text, '[^\\p{{L}}]+', ' ', 'g')) AS t FROM l), n AS (SELECT doc_id, count(*) FILTER (t <> '') AS blocks FROM t GROUP BY 1)"""


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(CASE WHEN doc_id % 10 NOT IN (7, 9) THEN CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END END AS INTEGER) AS version, CASE WHEN doc_id % 10 IN (7, 9) THEN 'rejected' WHEN doc_id % 3 = 0 THEN 'committed' ELSE 'unchanged' END AS status,
    CASE doc_id % 10 WHEN 7 THEN 'UnsupportedFormat' WHEN 9 THEN 'ParseError' END AS error_code FROM documents""")
def ingest_end_to_end(spark, sf_dir):
    """What the second round of an ingest says of each file."""
    return _engine(spark, sf_dir)[2].select("document_id", "version", "status", "error_code")


@query(f"""WITH {_INGEST} SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(v AS INTEGER) AS version, CAST(CASE WHEN v = 2 THEN 1 END AS INTEGER) AS previous_version, CASE v WHEN 1 THEN blocks ELSE 1 END AS added, 0::BIGINT AS removed FROM n, (VALUES (1), (2)) x(v) WHERE doc_id % 10 NOT IN (7, 9) AND (v = 1 OR doc_id % 3 = 0)""")
def ingest_changes(spark, sf_dir):
    """The change log after both rounds."""
    log = _engine(spark, sf_dir)[0].store.read("change_log", S.CHANGES)
    return log.select("document_id", "version", "previous_version", F.size("added").cast("bigint").alias("added"), (F.size("removed") + F.size("updated")).cast("bigint").alias("removed"))


def _repeats(engine, spark, sf_dir):
    """A store after one batch in which every third document comes again with equal and with more text, and every ninth as it was."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t: F.trim(F.regexp_replace(t, "[^\\p{L}]+", " "))), lambda t: t != "")
    text, d = F.array_join(lines, "\n\n"), F.col("doc_id")
    more = F.concat(text, F.lit("\n\nadded line here"))
    times = F.when(d % 9 == 0, F.array(text, text, more, text)).when(d % 3 == 0, F.array(text, text, more)).otherwise(F.array(text))
    files = _t(spark, sf_dir, "documents").select(d.cast("string").alias("document_id"), F.posexplode(times).alias("arrival", "t"))
    result = engine.ingest(files.select("document_id", "arrival", F.concat("document_id", F.lit("-"), F.col("arrival").cast("string"), F.lit(".md")).alias("name"), F.encode("t", "UTF-8").alias("content")))
    return engine, result


@query("""SELECT CAST(doc_id AS VARCHAR) AS document_id, doc_id || '-' || a || '.md' AS name, CAST(CASE a WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS INTEGER) AS version, CASE a WHEN 1 THEN 'unchanged' ELSE 'committed' END AS status FROM documents, range(4) r(a) WHERE a = 0 OR doc_id % 3 = 0 AND a < 3 OR doc_id % 9 = 0""")
def ingest_repeats(spark, sf_dir):
    """What one batch says of files that repeat a document, with equal and with other bytes."""
    return _once(spark, sf_dir, _repeats)[1].select("document_id", "name", "version", "status")


@query(f"""WITH {_INGEST} SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(v AS INTEGER) AS version, CAST(nullif(v - 1, 0) AS INTEGER) AS previous_version, CASE v WHEN 1 THEN blocks WHEN 2 THEN 1 ELSE 0 END AS added, CAST(v = 3 AS BIGINT) AS removed FROM n, range(1, 4) r(v) WHERE v = 1 OR doc_id % 3 = 0 AND v = 2 OR doc_id % 9 = 0""")
def repeated_changes(spark, sf_dir):
    """The change log of that batch: each version against the one before, also within the batch."""
    log = _once(spark, sf_dir, _repeats)[0].store.read("change_log", S.CHANGES)
    return log.select("document_id", "version", "previous_version", F.size("added").cast("bigint").alias("added"), (F.size("removed") + F.size("updated")).cast("bigint").alias("removed"))


@query("SELECT CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS document_id FROM documents WHERE false")
def repeated_chain(spark, sf_dir):
    """Changes of that batch that do not follow the one before: none."""
    return V.chain_violations(_once(spark, sf_dir, _repeats)[0].store.read("change_log", S.CHANGES)).select("seq", "document_id")


@query("""SELECT k.v AS version, count(*) AS documents, max(k.v) AS latest FROM documents d, (VALUES (1), (2)) k(v) WHERE d.doc_id % 10 NOT IN (7, 9) AND (k.v = 1 OR d.doc_id % 3 = 0) GROUP BY k.v""")
def history_read(spark, sf_dir):
    """Versions of the store, read back by number."""
    v = _engine(spark, sf_dir)[0].store.read("versions", S.VERSIONS)
    return v.groupBy("version").agg(F.count("*").alias("documents"), F.max("version").alias("latest"))


# --- Markdown with every mark, and back -------------------------------------------------------------------


def _marked(spark, sf_dir):
    """A Markdown text a region: headings of both kinds, marks, lists, a quote, a table of its nations, code, a figure."""
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", c.alias("v")))), lambda s: s["v"])
    g = n.groupBy(F.col("r_regionkey").alias("id"), "r_name").agg(own(F.concat(F.lit("| "), "n_name", F.lit(" | a\\|"), F.col("n_nationkey").cast("string"), F.lit(" |"))).alias("rows"))
    parts = [F.concat(F.lit("# "), F.col("r_name")), F.lit("Sub *title*\n---"), F.concat(F.lit("Some **bold**, *slanted* `code` and [a link](http://x.y) of "), "r_name", F.lit("  \nwith a break")), F.lit("1. one\n2) two"), F.lit("- bullet\n  - nested\n\n  rest of it"), F.lit("> quoted\n> text"), F.concat(F.lit("| nation | key |\n| --- | --- |\n"), F.array_join("rows", "\n")), F.lit("```py\nx = 1\n\ny = 2\n```"), F.lit("***"), F.lit("![a *figure*](p.png)"), F.lit("### Deep ###"), F.lit("end & <b>")]
    return g.select("id", F.concat_ws("\n\n", *parts).alias("md"))


_MARKED = """r AS (SELECT r_regionkey AS document_id, r_name, (SELECT string_agg(n_name || chr(9) || 'a|' || n_nationkey, chr(10) ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) AS body, (SELECT string_agg('| ' || n_name || ' | a\\|' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) AS md, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS k FROM region),
    b AS (SELECT document_id, 0 AS ord, 'heading' AS kind, r_name AS text, 1 AS level, '' AS path, '# ' || r_name AS out FROM r UNION ALL SELECT document_id, 1, 'heading', 'Sub title', 2, r_name, '## Sub title' FROM r
        UNION ALL SELECT document_id, 2, 'paragraph', 'Some bold, slanted code and a link of ' || r_name || chr(10) || 'with a break', NULL, r_name || ' / Sub title', NULL FROM r UNION ALL SELECT document_id, 3 + i, 'list_item', t, NULL, r_name || ' / Sub title', o FROM r, (VALUES (0, '1. one', '1. one'), (1, '2) two', '2) two'), (2, 'bullet', '- bullet'), (3, 'nested', '- nested')) v(i, t, o)
        UNION ALL SELECT document_id, 7, 'paragraph', 'rest of it', NULL, r_name || ' / Sub title', NULL FROM r UNION ALL SELECT document_id, 8, 'paragraph', 'quoted' || chr(10) || 'text', NULL, r_name || ' / Sub title', NULL FROM r
        UNION ALL SELECT document_id, 9, 'table', 'nation' || chr(9) || 'key' || chr(10) || body, NULL, r_name || ' / Sub title', '| nation | key |' || chr(10) || '| --- | --- |' || chr(10) || md FROM r UNION ALL SELECT document_id, 10, 'paragraph', 'x = 1' || chr(10) || chr(10) || 'y = 2', NULL, r_name || ' / Sub title', NULL FROM r
        UNION ALL SELECT document_id, 11, 'figure', 'a figure', NULL, r_name || ' / Sub title', NULL FROM r UNION ALL SELECT document_id, 12, 'heading', 'Deep', 3, r_name || ' / Sub title', '### Deep' FROM r UNION ALL SELECT document_id, 13, 'paragraph', 'end & <b>', NULL, r_name || ' / Sub title / Deep', NULL FROM r)"""


@query(f"WITH {_MARKED} SELECT document_id, CAST(ord AS INTEGER) AS ord, kind, text, CAST(level AS INTEGER) AS level, path FROM b")
def markdown_documents(spark, sf_dir):
    from folioflow.operators import markdown as M

    return M.markdown_blocks(_marked(spark, sf_dir), "id", "md").select("document_id", "ord", "kind", "text", "level", F.array_join("section_path", " / ").alias("path"))


@query(f"WITH {_MARKED} SELECT document_id, string_agg(coalesce(out, text), chr(10) || chr(10) ORDER BY ord) || chr(10) AS markdown FROM b GROUP BY 1")
def markdown_round_trip(spark, sf_dir):
    """The scanned blocks written as Markdown again, tables from their cells."""
    from folioflow.operators import markdown as M
    from folioflow.operators import tables as T

    b = M.markdown_blocks(_marked(spark, sf_dir), "id", "md")
    cell = lambda r, c, t: F.struct(r.alias("row"), c.alias("col"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), t.alias("text"), F.lit("none").alias("header"))
    cells = b.where("rows IS NOT NULL").select(F.struct("document_id", "ord").alias("table_id"), F.size("rows").alias("n_rows"), F.size(F.col("rows")[0]).alias("n_cols"), F.inline(F.flatten(F.transform("rows", lambda row, r: F.transform(row, lambda t, c: cell(r, c, t))))))
    md = T.markdown(cells).select("table_id.document_id", "table_id.ord", F.col("md").alias("table_md"))
    return B.export_markdown(b.join(md, ["document_id", "ord"], "left"))


@query("SELECT n_nationkey, n_nationkey % 4 = 0 AS passed FROM nation")
def png_checks(spark, sf_dir):
    """Images of the nations: whole ones, cut ones, ones with a wrong head or more behind the end."""
    from folioflow.operators.integrity import png_problem
    from folioflow.testing.drivers import tiny_png

    whole, k = tiny_png(3, 2, 9), F.col("n_nationkey")
    kinds = F.when(k % 4 == 0, F.lit(bytearray(whole))).when(k % 4 == 1, F.lit(bytearray(whole[:-5]))).when(k % 4 == 2, F.lit(bytearray(b"x" + whole[1:]))).otherwise(F.lit(bytearray(whole + b"!")))
    return _t(spark, sf_dir, "nation").select(k, png_problem(kinds).isNull().alias("passed"))


@query(f"WITH {_MARKED} SELECT document_id, CAST(ord AS INTEGER) AS ord, kind, text, CAST(level AS INTEGER) AS level, path FROM b UNION ALL SELECT r_regionkey + 100, 0, NULL, 'block nesting too deep', NULL, NULL FROM region")
def markdown_in_sql(spark, sf_dir):
    """The block rules as a table function, called in SQL with a partition for each document; texts that nest too deep are rows too."""
    from folioflow.operators import markdown as M

    M.register(spark, "folio_markdown_scan")
    deep = _t(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).cast("bigint").alias("document_id"), F.concat(F.repeat(F.lit(">"), 25), F.lit(" "), "r_name").alias("text"))
    texts = _marked(spark, sf_dir).select(F.col("id").cast("bigint").alias("document_id"), F.col("md").alias("text")).unionByName(deep)
    sql = "SELECT document_id, ord, kind, coalesce(error, text) AS text, level, array_join(section_path, ' / ') AS path FROM folio_markdown_scan(TABLE(SELECT document_id, text FROM {texts}) PARTITION BY document_id)"
    return spark.sql(sql, texts=texts)


@query("""WITH o AS (SELECT o_custkey AS d, CAST(o_orderkey % 40 AS INTEGER) AS page, o_orderkey AS id, o_orderkey % 9 AS f, o_orderkey % 8 = 0 AS invisible, o_orderkey % 5 <> 0 AS there, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 4 = 1 ELSE false END AS hangul FROM orders),
    w AS (SELECT d, bool_or(f IN (2, 5)) AS rendered FROM o WHERE there AND hangul GROUP BY 1)
    SELECT d AS document_id, min(page) AS page, 'font without Hangul glyphs' AS reason FROM o LEFT JOIN w USING (d) WHERE NOT invisible AND NOT there AND f NOT IN (1, 2, 5) AND (f IN (0, 3, 7) OR rendered = false) GROUP BY d""")
def glyph_losses(spark, sf_dir):
    """Text objects without glyphs in fonts that cannot draw Hangul, in documents where that may be lost text."""
    from folioflow.operators import scan

    k, d = F.col("o_orderkey"), F.col("o_custkey")
    o = _t(spark, sf_dir, "orders").select(d.alias("document_id"), (k % 40).cast("int").alias("page"), k.alias("object_id"), (k % 9).alias("font_id"), (k % 8 == 0).alias("invisible"), F.when((d % 3 == 0) & (k % 4 == 1), "가").otherwise("a").alias("text"))
    names = F.array(*[F.lit(n) for n in ("ABCDEF+HYGothic", "Arial", "Times", "NanumGothic", "hyphen", "Courier", "Helvetica", "Noto Sans CJK KR", "SimSun")])
    fonts = o.select("document_id", "font_id").distinct().select("*", F.get(names, F.col("font_id").cast("int")).alias("name"), (F.col("font_id") == 1).alias("embedded"), F.col("font_id").isin(2, 5).alias("draws"))
    return scan.glyph_losses(o.drop("text"), o.where(F.col("object_id") % 5 != 0).select("document_id", "page", "object_id", "text"), fonts)


# --- requests to drivers -----------------------------------------------------------------------------------


def _clerk(request: dict) -> dict:
    """A driver's answer by the last digit of the image: 3 is refused, 7 is busy at first, 9 stays busy."""
    from folioflow.errors import DriverError

    last = request["image_sha256"][-1]
    if last == "3":
        raise DriverError("refused", False, "no table")
    if last == "9" or last == "7" and request["attempt"] == 1:
        raise DriverError("busy", True)
    return {"text": f"{request['task']} {request['image_sha256']}"}


def _asked(spark, sf_dir):
    from folioflow.operators import requests as RQ
    from folioflow.testing.drivers import FunctionDriver

    k = F.col("o_orderkey")
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), k.alias("request_id"), F.when(k % 2 == 0, "TABLE").otherwise("OCR").alias("task"), k.cast("string").alias("image_sha256"), F.lit(None).cast("string").alias("anchor_sha256"), F.array(F.lit("ko")).alias("language_hints"))
    return o, RQ.answered(o, lambda: FunctionDriver(_clerk), at_once=4, attempts=2)


@query("""SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 10 NOT IN (3, 9) THEN CASE o_orderkey % 2 WHEN 0 THEN 'TABLE ' ELSE 'OCR ' END || o_orderkey END AS text, CASE o_orderkey % 10 WHEN 3 THEN 'refused' WHEN 9 THEN 'busy' END AS code, CASE WHEN o_orderkey % 10 IN (3, 9) THEN o_orderkey % 10 = 9 END AS retryable, CAST(CASE WHEN o_orderkey % 10 IN (7, 9) THEN 2 ELSE 1 END AS INTEGER) AS attempts FROM orders""")
def driver_answers(spark, sf_dir):
    """Answers and errors of a driver, some of which pass when asked again."""
    answers = _asked(spark, sf_dir)[1]
    return answers.select("request_id", F.get_json_object("result", "$.text").alias("text"), "error.code", "error.retryable", "attempts")


@query("""SELECT o_custkey AS job, count(*) AS total, count(*) FILTER (o_orderkey % 4 <> 0 AND o_orderkey % 10 NOT IN (3, 9)) AS answered, count(*) FILTER (o_orderkey % 4 <> 0 AND o_orderkey % 10 IN (3, 9)) AS failed, count(*) FILTER (o_orderkey % 4 = 0) AS waiting, count(*) FILTER (o_orderkey % 4 <> 0) / count(*) AS progress FROM orders GROUP BY 1""")
def job_progress(spark, sf_dir):
    """How far each job is while a quarter of its requests still waits."""
    from folioflow.operators import requests as RQ

    requests, answers = _asked(spark, sf_dir)
    return RQ.job_progress(requests, answers.where(F.col("request_id") % 4 != 0), ["job"])


# --- the feed as a stream ---------------------------------------------------------------------------------


def _streamed(spark, sf_dir, make, mode):
    """What a stream over the events gives, batch by batch, as one table with its batch numbers."""
    from folioflow.streaming import feed

    root = f"{shared_path(spark)}/folio-stream-{uuid.uuid4().hex[:12]}"
    events = spark.readStream.schema(_t(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    feed.run_batches(make(events), lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), f"{root}/checkpoint", mode=mode)
    return spark.read.parquet(f"{root}/out")


@query("SELECT user_id AS document_id, event_id + 1 AS version, coalesce(lag(event_id + 1) OVER (PARTITION BY user_id ORDER BY event_id), 0) + 1 AS expected FROM events QUALIFY version <> expected")
def stream_conflicts(spark, sf_dir):
    """Changes that do not follow their document's version before; the state is one number a document."""
    from folioflow.streaming import feed

    make = lambda e: feed.version_conflicts(e.select(F.col("user_id").alias("document_id"), (F.col("event_id") + 1).alias("version")))
    return _streamed(spark, sf_dir, make, "append").select("document_id", "version", "expected")


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Counts by day and type under a watermark; a window's last update counts."""
    from folioflow.streaming import feed

    got = _streamed(spark, sf_dir, lambda e: feed.windowed_counts(e, "ts", ["event_type"], "1 day", "2 days"), "update")
    last = V.latest(got.select(F.struct(F.col("window.start").cast("date").alias("day"), "event_type").alias("document_id"), F.col("batch").cast("bigint").alias("batch"), "n"), version="batch")
    return last.select("document_id.day", "document_id.event_type", "n")


_STREAMED = f"""WITH {_TWO}, k AS (SELECT doc_id, count(*) FILTER (v = 1) AS one, count(*) FILTER (v = 2) AS two FROM i GROUP BY 1),
    n AS (SELECT document_id AS doc_id, count(*) FILTER (change = 'added') AS a, count(*) FILTER (change = 'updated') AS u, count(*) FILTER (change = 'removed') AS r FROM d GROUP BY 1)
    SELECT doc_id AS document_id, CAST(1 AS INTEGER) AS version, one AS added, 0::BIGINT AS updated, 0::BIGINT AS removed, CAST(NULL AS VARCHAR) AS conflict FROM k WHERE one > 0
    UNION ALL SELECT doc_id, 2, coalesce(a, 0), coalesce(u, 0), coalesce(r, 0), NULL FROM k LEFT JOIN n USING (doc_id) WHERE one > 0
    UNION ALL SELECT doc_id, 1, 0, 0, 0, 'late' FROM k WHERE one > 0 AND doc_id % 5 = 0 UNION ALL SELECT doc_id, 4, 0, 0, 0, 'gap' FROM k WHERE one > 0 AND doc_id % 7 = 0"""


@query(_STREAMED)
def stream_changes(spark, sf_dir):
    """Three micro-batches of versions, some late and some ahead, as changes out of keyed state."""
    from folioflow.streaming import changes as CH
    from folioflow.streaming import feed

    one, two = _two_versions(spark, sf_dir)
    d = F.col("document_id")
    rows = lambda blocks, v: CH.version_rows(blocks.withColumn("version", F.lit(v)), ids.select("document_id", F.lit(v).alias("version"), F.lit(f"sha256:{v}").alias("source_hash")), ["ord"])
    ids = one.select("document_id").distinct()
    first, second = rows(one, 1), rows(two, 2)
    root = f"{shared_path(spark)}/folio-stream-{uuid.uuid4().hex[:12]}"
    ahead = first.where(d % 7 == 0).withColumn("version", F.lit(4))
    for k, part in enumerate((first, second.where(d % 2 == 0).unionByName(first.where((d % 5 == 0) & (d % 2 == 0))), second.where(d % 2 == 1).unionByName(first.where((d % 5 == 0) & (d % 2 == 1))).unionByName(ahead))):
        part.coalesce(1).write.parquet(f"{root}/in/part={k}")
    key, provider = CH.STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        stream = feed.read_stream(spark, f"{root}/in/*", first.schema, max_files=1)
        feed.run_batches(CH.emit_changes(stream), lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), f"{root}/checkpoint")
    finally:
        spark.conf.set(key, before)
    out = spark.read.parquet(f"{root}/out")
    return out.select("document_id", "version", *[F.size(c).cast("bigint").alias(c) for c in ("added", "updated", "removed")], "conflict")


@query("""SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(v AS INTEGER) AS version, 1::BIGINT AS times, v - 1 AS batch FROM documents, (VALUES (1), (2)) x(v) WHERE doc_id % 10 NOT IN (7, 9) AND (v = 1 OR doc_id % 3 = 0)""")
def feed_source(spark, sf_dir):
    """The change log of a store as a stream, a commit a micro-batch, followed twice from one checkpoint: each change once."""
    from folioflow.streaming import changes as CH

    store, root = _engine(spark, sf_dir)[0].store, f"{shared_path(spark)}/folio-stream-{uuid.uuid4().hex[:12]}"
    for _ in range(2):
        CH.follow(store, lambda df, n: df.write.mode("append").parquet(f"{root}/out/batch={n}"), f"{root}/checkpoint", max_commits=1)
    out = spark.read.parquet(f"{root}/out")
    return out.groupBy("document_id", "version").agg(F.count("*").alias("times"), F.max("batch").cast("bigint").alias("batch"))


# --- a page put together --------------------------------------------------------------------------------------


@query("""SELECT c_custkey AS document_id, CAST(o AS INTEGER) AS ord, kind, CASE o WHEN 0 THEN 'Intro ' || c_name ELSE t END AS text, confidence, source AS text_source, CAST(CASE WHEN kind = 'table' THEN 0 END AS INTEGER) AS table_no, CAST(e AS INTEGER) AS extra_no
    FROM customer, (VALUES (0, 'paragraph', '', 0.7::DOUBLE, 'text_layer', NULL), (1, 'table', 'cell', 0.6::DOUBLE, 'text_layer', NULL), (2, 'paragraph', 'Next to it', 0.7::DOUBLE, 'text_layer', NULL), (3, 'paragraph', 'read by OCR', 0.45::DOUBLE, 'ocr', 0), (4, 'figure', '', 0.7::DOUBLE, 'text_layer', 1), (5, 'caption', 'Figure 1', 0.7::DOUBLE, 'text_layer', 2), (6, 'paragraph', 'The end', 0.7::DOUBLE, 'text_layer', NULL)) v(o, kind, t, confidence, source, e)""")
def merged_page(spark, sf_dir):
    """Text, a table whose glyphs it owns, an OCR paragraph and a figure with its caption, in the page's order."""
    from folioflow.operators import flow as FL

    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), "c_name")
    page = F.lit(1).alias("page")
    pages = c.select("document_id", page, F.lit(600.0).alias("width_pt"), F.lit(800.0).alias("height_pt"), F.lit("digital").alias("text_layer"), F.lit("layer").alias("mode"))
    line = lambda t, base: c.select("document_id", page, t.alias("s"), F.lit(float(base)).alias("baseline"))
    text = line(F.concat(F.lit("Intro "), "c_name"), 70).unionByName(line(F.lit("cell"), 230)).unionByName(line(F.lit("Next to it"), 330)).unionByName(line(F.lit("The end"), 700))
    g = text.select("document_id", "page", "baseline", F.posexplode(F.split("s", "")).alias("i", "text"))
    g = g.select("document_id", "page", "text", (F.col("baseline").cast("bigint") * 100 + F.col("i")).alias("char_id"), (60 + F.col("i") * 6.0).alias("x0"), (66 + F.col("i") * 6.0).alias("x1"), (F.col("baseline") - 8).alias("y0"), (F.col("baseline") + 2).alias("y1"), "baseline", F.lit(10.0).alias("size"), F.lit(False).alias("bold"), F.lit(False).alias("invisible"), F.lit(0).alias("along"), F.lit(1).alias("down"))
    box = lambda a, b: F.struct(*[F.lit(v).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (0.1, a, 0.9, b))])
    tables = c.select("document_id", page, F.lit(0).alias("table_no"), F.lit(0).alias("along"), F.lit(1).alias("down"), box(0.25, 0.35).alias("box"), F.lit("cell").alias("text"), F.lit(0.6).alias("confidence"))
    extra = lambda no, rank, top, kind, t, sure, source: c.select("document_id", page, F.lit(no).alias("extra_no"), F.lit(rank).alias("rank"), F.lit(top).alias("top"), F.lit(kind).alias("kind"), F.lit(t).alias("text"), F.lit(sure).alias("confidence"), F.lit(source).alias("text_source"), box(top, top + 0.05).alias("box"))
    extras = extra(0, 1, 0.5, "paragraph", "read by OCR", 0.45, "ocr").unionByName(extra(1, 2, 0.6, "figure", "", 0.7, "text_layer")).unionByName(extra(2, 2, 0.6, "caption", "Figure 1", 0.7, "text_layer"))
    taken = g.where("baseline = 230").select("document_id", "page", "char_id")
    return FL.page_blocks(g, pages, taken, tables, extras).select("document_id", "ord", "kind", "text", "confidence", "text_source", "table_no", "extra_no")


_READ = "(VALUES (0, 'heading', 'Report', 0.6::DOUBLE), (1, 'paragraph', 'p', 0.7::DOUBLE), (2, 'table', 't', 0.6::DOUBLE), (3, 'figure', '', 0.7::DOUBLE), (4, 'caption', 'Figure 1', 0.7::DOUBLE), (5, 'table', 'b', 0.4::DOUBLE), (6, 'list_item', '- the end', 0.7::DOUBLE)) v(o, kind, t, confidence)"


def _read_customer(row: dict) -> dict:
    """A page a customer: a heading, two lines, a drawn table, a photo with a caption, a table without rules, a list item."""
    key = str(row["document_id"])
    pieces = [("Report", 60, 60, 20.0), (row["c_name"], 60, 100, 10.0), ("goes on here", 60, 114, 10.0), ("Figure 1", 70, 430, 10.0), ("- the end", 60, 700, 10.0)]
    pieces += [(f"r{i}" if j == 0 else f"v{i}{j}x{key}", 65 + j * 150, 162 + i * 20, 10.0) for i in range(3) for j in range(3)]
    pieces += [(f"name{i}" if j == 0 else f"q{i}{j}y{key}", 60 + j * 180, 560 + i * 25, 10.0) for i in range(4) for j in range(3)]
    text = "".join([p[0] for p in pieces])
    long = [len(p[0]) for p in pieces]
    x, base, size = (np.repeat([float(p[k]) for p in pieces], long) for k in (1, 2, 3))
    i = np.arange(len(text)) - np.repeat(np.cumsum(long) - long, long)
    w, no, one = 0.6 * size, np.zeros(len(text), bool), np.ones(len(text), np.int64)
    chars = {"char_id": (base * 100_000 + x * 100 + i).astype(np.int64), "text": np.array([*text], object), "x0": x + i * w, "x1": x + (i + 1) * w, "y0": base - 0.8 * size, "y1": base + 0.2 * size, "baseline": base, "size": size, "bold": no, "invisible": no, "unmapped": no, "along": one - 1, "down": one}
    rules = {"axis": np.array(["h"] * 4 + ["v"] * 4, object), "pos": np.array([150.0, 170, 190, 210, 50, 200, 350, 500]), "start": np.repeat([50.0, 150.0], 4), "end": np.repeat([500.0, 210.0], 4), "fill": np.zeros(8, bool)}
    regions = np.array(["figure_title"], object), np.array([0.8]), np.array([[60.0, 418.0, 300.0, 434.0]])
    return {"width_pt": 600.0, "height_pt": 800.0, "chars": chars, "rules": rules, "images": np.array([[60.0, 260.0, 300.0, 415.0]]), "regions": regions}


def _customer_pages(spark, sf_dir):
    """Those pages as they lie: a row a customer."""
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.lit(1).alias("page"), "c_name")


@query(f"""WITH t AS (SELECT c_custkey AS d, string_agg('r' || i || chr(9) || 'v' || i || '1x' || c_custkey || chr(9) || 'v' || i || '2x' || c_custkey, chr(10) ORDER BY i) AS t FROM customer, range(3) r(i) GROUP BY 1), b AS (SELECT c_custkey AS d, string_agg('name' || i || chr(9) || 'q' || i || '1y' || c_custkey || chr(9) || 'q' || i || '2y' || c_custkey, chr(10) ORDER BY i) AS b FROM customer, range(4) r(i) GROUP BY 1)
    SELECT c_custkey AS document_id, CAST(o AS INTEGER) AS ord, kind, CASE v.t WHEN 'p' THEN c_name || chr(10) || 'goes on here' WHEN 't' THEN t.t WHEN 'b' THEN b.b ELSE v.t END AS text, confidence, CASE WHEN o = 0 THEN '' ELSE 'Report' END AS path FROM customer JOIN t ON t.d = c_custkey JOIN b ON b.d = c_custkey, {_READ}""")
def read_pages(spark, sf_dir):
    """Pages to blocks in one plan: text, both kinds of tables, a photo and its caption."""
    from folioflow.operators import document as D

    return D.read_drawn(_customer_pages(spark, sf_dir), _read_customer).blocks.select("document_id", "ord", "kind", "text", "confidence", F.array_join("section_path", " / ").alias("path"))


@query("""SELECT c_custkey AS document_id, 1 AS page, n AS layer_chars, n AS in_blocks, 0::BIGINT AS doubled FROM (SELECT c_custkey, 6 + length(replace(c_name, ' ', '')) + 10 + 7 + 7 + 3 * 2 + 6 * (4 + length(CAST(c_custkey AS VARCHAR))) + 4 * 5 + 8 * (4 + length(CAST(c_custkey AS VARCHAR))) AS n FROM customer)""")
def read_ledger(spark, sf_dir):
    """Every glyph of the pages is in exactly one block."""
    from folioflow.operators import document as D

    return D.read_drawn(_customer_pages(spark, sf_dir), _read_customer).ledger


@query("""SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS document_id, CAST(1 AS INTEGER) AS version, 'committed' AS status FROM conversations WHERE conv_id % 5 <> 3 UNION ALL SELECT CAST(conv_id * 1000 + turn AS VARCHAR), NULL, 'rejected' FROM conversations WHERE conv_id % 5 = 3""")
def stream_ingest(spark, sf_dir):
    """Turns of the conversations as a stream of files into a store, a fifth of them of no known format."""
    from folioflow.engine import Engine
    from folioflow.streaming import feed

    root = f"{shared_path(spark)}/folio-stream-{uuid.uuid4().hex[:12]}"
    turns = spark.readStream.schema(_t(spark, sf_dir, "conversations").schema).parquet(f"{sf_dir}/conversations.parquet*")
    key = (F.col("conv_id") * 1000 + F.col("turn")).cast("string")
    name = F.concat(key, F.when(F.col("conv_id") % 5 == 3, ".docx").otherwise(".md"))
    files = turns.select(key.alias("document_id"), name.alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    feed.ingest_stream(Engine(spark, f"{root}/store"), files, f"{root}/results", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/results").select("document_id", "version", "status")


def _page_store(engine, spark, sf_dir):
    """A store after two rounds of a page a customer: every other one comes again with an image of its figure."""
    pages, key = _customer_pages(spark, sf_dir), F.col("document_id")
    source = pages.select("document_id", F.concat(key.cast("string"), F.lit(".pdf")).alias("name"))
    digest = lambda round: F.concat(F.lit("sha256:"), F.sha2(F.concat(key.cast("string"), F.when(key % 2 == 0, round).otherwise("")), 256))
    text = lambda df: df.withColumn("document_id", key.cast("string"))
    drawn = dict(pages=text(pages), read=_read_customer)
    first = engine.ingest_pages(text(source.withColumn("source_hash", digest("1"))), **drawn)
    png = F.encode(F.concat(F.lit("image "), (key % 10).cast("string")), "UTF-8")
    crops = pages.where(key % 2 == 0).select(key.cast("string").alias("document_id"), "page", F.lit(0).alias("item_no"), F.lit("image/png").alias("mime"), png.alias("bytes"), F.lit(100).alias("width_px"), F.lit(65).alias("height_px"), F.lit(200).alias("dpi"))
    return engine, first, engine.ingest_pages(text(source.withColumn("source_hash", digest("2"))), **drawn, crops=crops)


@query(f"""WITH t AS (SELECT c_custkey AS d, string_agg('r' || i || chr(9) || 'v' || i || '1x' || c_custkey || chr(9) || 'v' || i || '2x' || c_custkey, chr(10) ORDER BY i) AS t FROM customer, range(3) r(i) GROUP BY 1), b AS (SELECT c_custkey AS d, string_agg('name' || i || chr(9) || 'q' || i || '1y' || c_custkey || chr(9) || 'q' || i || '2y' || c_custkey, chr(10) ORDER BY i) AS b FROM customer, range(4) r(i) GROUP BY 1)
    SELECT CAST(c_custkey AS VARCHAR) AS document_id, CAST(w AS INTEGER) AS version, CAST(o AS INTEGER) AS ord, kind, CASE v.t WHEN 'p' THEN c_name || chr(10) || 'goes on here' WHEN 't' THEN t.t WHEN 'b' THEN b.b ELSE v.t END AS text, CAST(CASE o WHEN 2 THEN 9 WHEN 5 THEN 12 END AS INTEGER) AS cells, CASE WHEN o = 3 AND w = 2 THEN 'Figure 1' END AS caption
    FROM customer JOIN t ON t.d = c_custkey JOIN b ON b.d = c_custkey, {_READ}, range(1, 3) r(w) WHERE w = 1 OR c_custkey % 2 = 0""")
def page_ingest(spark, sf_dir):
    """Blocks of every version that pages became, tables with their cells, figures with their captions."""
    blocks = _once(spark, sf_dir, _page_store)[0].store.read("blocks", S.BLOCKS)
    captions = blocks.where("kind = 'caption'").select("document_id", "version", F.col("block_id").alias("_c"), F.col("text").alias("caption"))
    rows = blocks.withColumn("_c", F.col("figure.caption_block_id")).join(captions, ["document_id", "version", "_c"], "left")
    return rows.select("document_id", "version", "ord", "kind", "text", F.when(F.col("table").isNotNull(), F.size("table.cells")).alias("cells"), "caption")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS document_id, CAST(w AS INTEGER) AS version, kind, reason, 1 AS page FROM customer, range(1, 3) r(w), (VALUES ('table', 'borderless_table'), ('figure', 'figure_without_image')) k(kind, reason) WHERE (w = 1 OR c_custkey % 2 = 0) AND (w = 1 OR kind = 'table')""")
def page_history(spark, sf_dir):
    """Regions read back: what of each version became no block, or one without its image."""
    rows = _once(spark, sf_dir, _page_store)[0].store.read("regions", S.REGIONS)
    return rows.select("document_id", "version", "kind", F.col("fallback_reason").alias("reason"), F.col("locator.page").alias("page"))


@query("""SELECT 'sha256:' || sha256('image ' || (c_custkey % 10)) AS asset, 'image ' || (c_custkey % 10) AS content, count(*) AS figures FROM customer WHERE c_custkey % 2 = 0 GROUP BY c_custkey % 10""")
def page_assets(spark, sf_dir):
    """Assets read back, each once however many figures show it."""
    store = _once(spark, sf_dir, _page_store)[0].store
    figures = store.read("blocks", S.BLOCKS).where("figure IS NOT NULL").groupBy(F.col("figure.asset").alias("asset")).agg(F.count("*").alias("figures"))
    return store.read("assets", S.ASSETS).select("asset", F.decode("bytes", "UTF-8").alias("content")).join(figures, "asset")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS document_id, CAST(w AS INTEGER) AS version, CAST(nullif(w - 1, 0) AS INTEGER) AS previous_version, CAST(CASE w WHEN 1 THEN 7 ELSE 1 END AS BIGINT) AS added, CAST(w - 1 AS BIGINT) AS removed FROM customer, range(1, 3) r(w) WHERE w = 1 OR c_custkey % 2 = 0""")
def page_changes(spark, sf_dir):
    """The change log of the pages: a figure that got its image is another block."""
    log = _once(spark, sf_dir, _page_store)[0].store.read("change_log", S.CHANGES)
    return log.select("document_id", "version", "previous_version", F.size("added").cast("bigint").alias("added"), F.size("removed").cast("bigint").alias("removed"))
