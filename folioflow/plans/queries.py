"""Every operator over the driver's tables, next to SQL that must give the same rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.functions import geometry as G
from folioflow.functions import text as X
from folioflow.operators import blocks as B
from folioflow.operators import integrity as I
from folioflow.operators import layout as L
from folioflow.operators import markdown as M
from folioflow.operators import pages as P
from folioflow.operators import planning as N
from folioflow.operators import provenance as R
from folioflow.operators import ruled as RT
from folioflow.operators import tables as T
from folioflow.operators import versions as V
from folioflow.operators import view as VW

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in as many partitions as a shuffle has: rows of few bytes and much work, which adaptive execution would put together by their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


_WS = "'[\\s\\x1c-\\x1f]+'"
_LINES = f"""l AS (SELECT doc_id, ord, text, trim(regexp_replace(text, {_WS}, ' ', 'g')) AS txt FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents))"""
_IDS = f"""{_LINES},
    h AS (SELECT doc_id, ord, text, txt, 'c_' || substring(sha256('{{"kind":"paragraph","level":null,"table":null,"text":"' || replace(replace(txt, '\\', '\\\\'), '"', '\\"') || '","v":"norm-v1"}}'), 1, 32) AS content_hash FROM l WHERE txt <> ''),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, content_hash ORDER BY ord) - 1 AS occ FROM h),
    b AS (SELECT *, 'b_' || substring(sha256(doc_id || chr(31) || content_hash || chr(31) || occ), 1, 24) AS block_id FROM o)"""


def _blocks(spark, sf_dir):
    return B.with_ids(B.line_blocks(_t(spark, sf_dir, "documents")))


# --- text and identity --------------------------------------------------------------


@query(f"WITH {_IDS} SELECT doc_id AS document_id, CAST(ord AS INTEGER) AS ord, content_hash, block_id, CAST(occ AS INTEGER) AS occ FROM b")
def block_ids(spark, sf_dir):
    return _blocks(spark, sf_dir).select("document_id", "ord", "content_hash", "block_id", "occ")


@query(f"WITH {_IDS} SELECT content_hash, count(*) AS blocks, count(DISTINCT doc_id) AS documents, min(doc_id) AS first_document FROM b GROUP BY content_hash HAVING count(*) > 1")
def block_duplicates(spark, sf_dir):
    return B.duplicate_blocks(_blocks(spark, sf_dir))


@query(f"SELECT doc_id, sha256(trim(regexp_replace(text, {_WS}, ' ', 'g'))) AS digest, length(trim(regexp_replace(text, {_WS}, ' ', 'g'))) AS n FROM documents")
def normalize_text(spark, sf_dir):
    df = _t(spark, sf_dir, "documents").select("doc_id", X.normal_text(F.col("text")).alias("t"))
    return df.select("doc_id", F.sha2("t", 256).alias("digest"), F.length("t").cast("bigint").alias("n"))


@query(
    """WITH i AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '1. ' WHEN 1 THEN '- ' WHEN 2 THEN '2024. ' ELSE '' END || text AS t FROM conversations)
    SELECT conv_id, turn, regexp_matches(t, '^\\s*(\\d+[.)]|[-•])\\s') AS marked FROM i"""
)
def list_marker(spark, sf_dir):
    prefix = F.when(F.col("turn") % 4 == 0, "1. ").when(F.col("turn") % 4 == 1, "- ").when(F.col("turn") % 4 == 2, "2024. ").otherwise("")
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", X.has_list_marker(F.concat(prefix, "text")).alias("marked"))


@query(
    """SELECT vec_id, '{"anchor_sha256":"' || sha256(CAST(label AS VARCHAR)) || '","image_sha256":"' || sha256(CAST(vec_id AS VARCHAR)) || '","language_hints":["de","en"],"task":"TABLE"}' AS body,
        substring(sha256('{"anchor_sha256":"' || sha256(CAST(label AS VARCHAR)) || '","image_sha256":"' || sha256(CAST(vec_id AS VARCHAR)) || '","language_hints":["de","en"],"task":"TABLE"}'), 1, 32) AS fingerprint FROM embeddings"""
)
def request_fingerprint(spark, sf_dir):
    image, anchor = F.sha2(F.col("vec_id").cast("string"), 256), F.sha2(F.col("label").cast("string"), 256)
    body = F.concat(F.lit('{"anchor_sha256":"'), anchor, F.lit('","image_sha256":"'), image, F.lit('","language_hints":["de","en"],"task":"TABLE"}'))
    return _t(spark, sf_dir, "embeddings").select("vec_id", body.alias("body"), R.request_fingerprint(F.lit("TABLE"), image, anchor, F.array(F.lit("en"), F.lit("de"))).alias("fingerprint"))


# --- sections and exports -----------------------------------------------------------


_LEVEL = "CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 END"


@query(
    f"""WITH i AS (SELECT conv_id, turn, {_LEVEL} AS level, role || ' ' || turn AS t FROM conversations),
    p AS (SELECT i.conv_id, i.turn, h.level, h.t FROM i JOIN i h ON h.conv_id = i.conv_id AND h.turn < i.turn AND h.level IS NOT NULL AND (i.level IS NULL OR h.level < i.level)
        WHERE NOT EXISTS (SELECT 1 FROM i x WHERE x.conv_id = i.conv_id AND x.turn > h.turn AND x.turn < i.turn AND x.level <= h.level))
    SELECT i.conv_id, i.turn, coalesce(string_agg(p.t, ' / ' ORDER BY p.level), '') AS path FROM i LEFT JOIN p ON p.conv_id = i.conv_id AND p.turn = i.turn GROUP BY i.conv_id, i.turn"""
)
def section_path(spark, sf_dir):
    items = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_LEVEL).alias("level"), F.concat("role", F.lit(" "), F.col("turn").cast("string")).alias("t"))
    return B.section_paths(items, "conv_id", "turn", "level", "t").select("conv_id", "turn", F.array_join("section_path", " / ").alias("path"))


@query(
    """WITH s AS (SELECT p_partkey, p_brand, CAST(p_size AS DOUBLE) / 2 AS size FROM part), b AS (SELECT p_brand, size AS body FROM (SELECT p_brand, size, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, size) AS r FROM s GROUP BY p_brand, size) WHERE r = 1),
    h AS (SELECT *, size >= 1.15 * body AS head FROM s JOIN b USING (p_brand))
    SELECT p_partkey, body, CASE WHEN head THEN CAST(least(dense_rank() OVER (PARTITION BY p_brand, head ORDER BY size DESC), 6) AS INTEGER) END AS level FROM h"""
)
def heading_levels(spark, sf_dir):
    s = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size").cast("double") / 2).alias("size"))
    body = P.modal(s, ["p_brand"], "size").withColumnRenamed("size", "body")
    return B.heading_levels(s.join(body, "p_brand"), "p_brand", "size", "body").select("p_partkey", "body", "level")


@query(
    """SELECT conv_id AS document_id, string_agg(CASE role WHEN 'system' THEN '# ' || text WHEN 'user' THEN '- ' || text ELSE text END, chr(10) || chr(10) ORDER BY turn) || chr(10) AS markdown FROM conversations GROUP BY conv_id"""
)
def export_markdown(spark, sf_dir):
    kind = F.when(F.col("role") == "system", "heading").when(F.col("role") == "user", "list_item").otherwise("paragraph")
    blocks = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("ord"), kind.alias("kind"), F.lit(1).alias("level"), "text")
    return B.export_markdown(blocks)


# --- tables -------------------------------------------------------------------------


def _nation_cells(spark, sf_dir):
    """One table per region: head row, the region merged over its nations, nation and key."""
    n = _t(spark, sf_dir, "nation").withColumn("row", F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")))
    n = n.withColumn("n_rows", (F.count("*").over(W.partitionBy("n_regionkey")) + 1).cast("int")).join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cell = lambda row, col, span, text, head: F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), span.cast("int").alias("rowspan"), F.lit(1).alias("colspan"), text.cast("string").alias("text"), F.lit(head).alias("header"))
    one = F.lit(1)
    cells = F.array(
        F.when(F.col("row") == 1, cell(F.lit(0), 0, one, F.lit("region"), "column")), F.when(F.col("row") == 1, cell(F.lit(0), 1, one, F.lit("nation"), "column")), F.when(F.col("row") == 1, cell(F.lit(0), 2, one, F.lit("a|b\nkey"), "column")),
        F.when(F.col("row") == 1, cell(one, 0, F.col("n_rows") - 1, F.col("r_name"), "row")), cell(F.col("row"), 1, one, F.col("n_name"), "none"), cell(F.col("row"), 2, one, F.col("n_nationkey"), "none"),
    )
    return n.select(F.col("n_regionkey").alias("table_id"), "n_rows", F.lit(3).alias("n_cols"), F.inline(F.array_compact(cells)))


_CELLS = """n AS (SELECT n_regionkey AS t, r_name, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r, count(*) OVER (PARTITION BY n_regionkey) AS k FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query(f"""WITH {_CELLS} SELECT t AS table_id, 'region' || chr(9) || 'nation' || chr(9) || 'a|b' || chr(10) || 'key' || chr(10) || string_agg(CASE WHEN r = 1 THEN r_name || chr(9) ELSE '' END || n_name || chr(9) || n_nationkey, chr(10) ORDER BY r) AS plain FROM n GROUP BY t""")
def table_plain_text(spark, sf_dir):
    return T.plain_text(_nation_cells(spark, sf_dir))


@query(f"""WITH {_CELLS} SELECT t AS table_id, CAST(r AS INTEGER) AS r, CAST(0 AS INTEGER) AS c, r_name AS text, 'row' AS header FROM n UNION ALL SELECT t, r, 1, n_name, 'none' FROM n UNION ALL SELECT t, r, 2, CAST(n_nationkey AS VARCHAR), 'none' FROM n
    UNION ALL SELECT t, 0, c, x, 'column' FROM (SELECT DISTINCT t FROM n), (VALUES (0, 'region'), (1, 'nation'), (2, 'a|b' || chr(10) || 'key')) v(c, x)""")
def table_grid_merged(spark, sf_dir):
    return T.grid(_nation_cells(spark, sf_dir))


@query(f"""WITH {_CELLS} SELECT t AS table_id, '| region | nation | a\\|b<br>key |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || r_name || ' | ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY r) AS md FROM n GROUP BY t""")
def table_markdown(spark, sf_dir):
    return T.markdown(_nation_cells(spark, sf_dir))


@query(f"""WITH {_CELLS} SELECT t AS table_id, '<table><thead><tr><th>region</th><th>nation</th><th>a|b<br>key</th></tr></thead><tbody>' || string_agg('<tr>' || CASE WHEN r = 1 THEN '<th' || CASE WHEN k > 1 THEN ' rowspan="' || k || '"' ELSE '' END || '>' || r_name || '</th>' ELSE '' END || '<td>' || n_name || '</td><td>' || n_nationkey || '</td></tr>', '' ORDER BY r) || '</tbody></table>' AS html FROM n GROUP BY t""")
def table_html(spark, sf_dir):
    return T.to_html(_nation_cells(spark, sf_dir))


@query(f"""WITH {_CELLS} SELECT t AS table_id, p.problem FROM (SELECT DISTINCT t FROM n), (VALUES (0, 'overlap'), (0, 'anchor'), (1, 'cover'), (2, 'bounds'), (2, 'cover')) p(m, problem) WHERE t % 4 = m""")
def table_violations(spark, sf_dir):
    cells = _nation_cells(spark, sf_dir)
    kind = F.col("table_id") % 4
    twice = cells.where((kind == 0) & (F.col("row") == 0) & (F.col("col") == 1))
    left = cells.where(~((kind == 1) & (F.col("row") == 0) & (F.col("col") == 1)))
    wide = left.withColumn("col", F.when((kind == 2) & (F.col("row") == 0) & (F.col("col") == 2), 3).otherwise(F.col("col")))
    return T.violations(wide.unionByName(twice))


@query("""WITH b AS (SELECT p_brand, p_name, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) SELECT p_brand AS table_id, 'p_name' || chr(9) || 'p_size' || chr(10) || string_agg(p_name || chr(9) || p_size, chr(10) ORDER BY r) AS plain FROM b GROUP BY p_brand""")
def relation_tables(spark, sf_dir):
    return T.plain_text(T.numbered(_t(spark, sf_dir, "part"), ["p_brand"], ["p_partkey"], ["p_name", "p_size"], "p_brand"))


# --- versions and changes --------------------------------------------------------------


@query("SELECT user_id AS document_id, max(event_id) AS version, arg_max(event_type, event_id) AS layer_state FROM events GROUP BY user_id")
def latest_versions(spark, sf_dir):
    return V.latest(_t(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("version"), F.col("event_type").alias("layer_state")))


@query("""WITH l AS (SELECT user_id AS document_id, max(event_id) AS version, arg_max(event_type, event_id) AS layer_state FROM events GROUP BY user_id) SELECT * FROM l WHERE layer_state IN ('click', 'view') AND document_id < 100""")
def documents_listing(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("version"), F.col("event_type").alias("layer_state"))
    return V.listing(e, ids=list(range(100)), states=["click", "view"])


@query("""WITH l AS (SELECT user_id AS document_id, max(event_id) AS version, arg_max(event_type, event_id) AS layer_state FROM events GROUP BY user_id) SELECT * FROM l""")
def documents_listing_all(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("version"), F.col("event_type").alias("layer_state"))
    return V.listing(e)


def _two_versions(spark, sf_dir):
    lines = B.line_blocks(_t(spark, sf_dir, "documents"))
    more = lambda c: F.when(F.col("ord") % 13 == 5, F.concat(c, F.lit(" edited"))).otherwise(F.col(c))
    edited = lines.where("ord % 7 <> 3").withColumns({"text": more("text"), "_norm": more("_norm")})
    return B.with_ids(lines), B.with_ids(edited)


_TWO = f"""{_LINES},
    v AS (SELECT 1 AS v, doc_id, ord, txt FROM l WHERE txt <> '' UNION ALL SELECT 2, doc_id, ord, trim(CASE WHEN ord % 13 = 5 THEN txt || ' edited' ELSE txt END) FROM l WHERE txt <> '' AND ord % 7 <> 3),
    o AS (SELECT *, row_number() OVER (PARTITION BY v, doc_id, txt ORDER BY ord) - 1 AS occ FROM v),
    i AS (SELECT v, doc_id, ord, 'b_' || substring(sha256(doc_id || chr(31) || 'c_' || substring(sha256('{{"kind":"paragraph","level":null,"table":null,"text":"' || replace(replace(txt, '\\', '\\\\'), '"', '\\"') || '","v":"norm-v1"}}'), 1, 32) || chr(31) || occ), 1, 24) AS block_id FROM o),
    d AS (SELECT coalesce(a.doc_id, b.doc_id) AS document_id, coalesce(a.block_id, b.block_id) AS block_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.ord <> b.ord THEN 'updated' END AS change, coalesce(b.ord, a.ord) AS ord
        FROM (SELECT * FROM i WHERE v = 1) a FULL JOIN (SELECT * FROM i WHERE v = 2) b ON a.doc_id = b.doc_id AND a.block_id = b.block_id)"""


@query(f"WITH {_TWO} SELECT document_id, block_id, change, CAST(ord AS INTEGER) AS ord FROM d WHERE change IS NOT NULL")
def version_diff(spark, sf_dir):
    old, new = _two_versions(spark, sf_dir)
    return V.block_diff(old, new, ["ord", "line_start"])


@query(f"WITH {_TWO} SELECT document_id, coalesce(string_agg(CASE WHEN change = 'added' THEN block_id END, ',' ORDER BY ord), '') AS added, coalesce(string_agg(CASE WHEN change = 'updated' THEN block_id END, ',' ORDER BY ord), '') AS updated, coalesce(string_agg(CASE WHEN change = 'removed' THEN block_id END, ',' ORDER BY ord), '') AS removed FROM d WHERE change IS NOT NULL GROUP BY document_id")
def change_sets(spark, sf_dir):
    old, new = _two_versions(spark, sf_dir)
    return V.change_sets(V.block_diff(old, new, ["ord", "line_start"])).select("document_id", *[F.array_join(c, ",").alias(c) for c in ("added", "updated", "removed")])


def _log(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    w = W.partitionBy("user_id").orderBy("event_id")
    n = F.row_number().over(w)
    return e.select((F.col("event_id") + 1).alias("seq"), F.col("user_id").alias("document_id"), n.alias("version"), F.when((n > 1) & (F.col("event_id") % 101 != 7), n - 1).alias("previous_version"))


_LOG = "g AS (SELECT event_id + 1 AS seq, user_id AS document_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id FROM events), log AS (SELECT seq, document_id, CAST(n AS INTEGER) AS version, CAST(CASE WHEN n > 1 AND event_id % 101 <> 7 THEN n - 1 END AS INTEGER) AS previous_version FROM g)"


@query(f"WITH {_LOG} SELECT * FROM log WHERE seq > 200 ORDER BY seq LIMIT 50")
def changes_page(spark, sf_dir):
    return V.page_of_changes(_log(spark, sf_dir), 200, 50)[0]


@query("SELECT max(event_id) + 1000 AS cursor_from, max(event_id) + 1000 AS next_cursor, true AS resync_required, CAST(0 AS BIGINT) AS changes FROM events")
def changes_resync(spark, sf_dir):
    log = _log(spark, sf_dir)
    top = log.agg(F.max("seq")).first()[0] + 999
    page, head = V.page_of_changes(log, top, 50)
    return page.agg(F.count("*").alias("changes")).select(F.lit(head["cursor_from"]).cast("bigint").alias("cursor_from"), F.lit(head["next_cursor"]).cast("bigint").alias("next_cursor"), F.lit(head["resync_required"]).alias("resync_required"), "changes")


@query(f"WITH {_LOG} SELECT seq, document_id, version, previous_version, expected FROM (SELECT *, lag(version) OVER (PARTITION BY document_id ORDER BY seq) AS expected FROM log) WHERE previous_version IS DISTINCT FROM expected")
def version_chain_violations(spark, sf_dir):
    return V.chain_violations(_log(spark, sf_dir))


def _assets(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    return d.select("doc_id", F.when(F.col("doc_id") % 53 == 5, "sha256:0").otherwise(X.asset_key(F.col("bytes"))).alias("asset"), "bytes")


_ASSETS = "a AS (SELECT doc_id, CASE WHEN doc_id % 53 = 5 THEN 'sha256:0' ELSE 'sha256:' || sha256(text) END AS asset, 'sha256:' || sha256(text) AS real, octet_length(encode(text)) AS size FROM documents)"


@query(f"WITH {_ASSETS} SELECT DISTINCT asset FROM a WHERE asset NOT IN (SELECT asset FROM a WHERE doc_id % 2 = 0)")
def asset_dedupe(spark, sf_dir):
    a = _assets(spark, sf_dir)
    return V.new_assets(a.where("doc_id % 2 = 1"), a.where("doc_id % 2 = 0").select("asset")).select("asset").union(a.limit(0).select("asset"))


@query(f"""WITH {_ASSETS}, r AS (SELECT DISTINCT asset FROM a WHERE doc_id % 3 <> 0), s AS (SELECT DISTINCT asset, real FROM a WHERE doc_id % 2 = 0), k AS (SELECT DISTINCT asset FROM a WHERE doc_id % 5 = 0)
    SELECT DISTINCT asset, 'unreferenced' AS problem FROM s WHERE asset NOT IN (SELECT asset FROM r) UNION SELECT asset, 'missing' FROM r WHERE asset NOT IN (SELECT asset FROM s) AND asset NOT IN (SELECT asset FROM k) UNION SELECT asset, 'hash' FROM s WHERE asset <> real""")
def asset_problems(spark, sf_dir):
    a = _assets(spark, sf_dir)
    return V.asset_problems(a.where("doc_id % 3 <> 0").select("asset").distinct(), a.where("doc_id % 2 = 0"), a.where("doc_id % 5 = 0").select("asset"))


@query(
    f"""WITH RECURSIVE {_ASSETS}, i AS (SELECT doc_id % 40 AS k, asset, size, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS n FROM a),
    f AS (SELECT k, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS spent, CAST([] AS VARCHAR[]) AS taken FROM (SELECT DISTINCT k FROM i)
        UNION ALL SELECT f.k, i.n, CASE WHEN NOT list_contains(taken, asset) AND spent + size <= 20000 THEN spent + size ELSE spent END, CASE WHEN NOT list_contains(taken, asset) AND spent + size <= 20000 THEN list_append(taken, asset) ELSE taken END FROM f JOIN i ON i.k = f.k AND i.n = f.n + 1)
    SELECT k, spent, CAST(len(taken) AS INTEGER) AS assets, array_to_string(list_sort(taken), ',') AS taken FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC) AS z FROM f) WHERE z = 1"""
)
def asset_budget(spark, sf_dir):
    a = _assets(spark, sf_dir).select((F.col("doc_id") % 40).alias("k"), "doc_id", "asset", F.octet_length("bytes").alias("size"))
    return V.asset_budget(a, "k", "doc_id", "asset", "size", 20000)


# --- pages and lines --------------------------------------------------------------------


def _chars(spark, sf_dir):
    """Documents typeset on a fixed grid: 80 columns, 50 lines a page."""
    d = _t(spark, sf_dir, "documents").where("length(text) > 0")
    c = d.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "")).alias("i", "text"))
    line, col = F.floor(F.col("i") / 80), F.col("i") % 80
    row = line % 50
    x0, base = 60 + col * 6.0, 70 + row * 14.0
    return c.select("document_id", (F.floor(line / 50) + 1).cast("int").alias("page"), "i", F.col("i").alias("char_id"), "text", x0.alias("x0"), (base - 8).alias("y0"), (x0 + 6).alias("x1"), (base + 2).alias("y1"), base.alias("baseline"), F.when(row == 0, 14.0).otherwise(10.0).alias("size"), (F.col("document_id") % 5 == 0).alias("invisible"), (F.col("text") == "%").alias("unmapped"))


_CHARS = "c AS (SELECT doc_id AS document_id, i, ch, i // 80 AS line FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM documents WHERE length(text) > 0)), p AS (SELECT *, CAST(line // 50 + 1 AS INTEGER) AS page, line % 50 AS r, trim(ch, ' ') <> '' AS ink FROM c)"


@query(f"""WITH {_CHARS} SELECT document_id, page, count(*) FILTER (ink AND document_id % 5 <> 0) AS chars, CASE WHEN count(*) FILTER (ink) > 0 AND document_id % 5 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS invisible_ratio, CASE WHEN count(*) FILTER (ink) > 0 THEN round(count(*) FILTER (ch = '%')::DOUBLE / count(*) FILTER (ink), 4) ELSE 0.0::DOUBLE END AS unmapped_ratio,
    CASE WHEN document_id % 5 = 0 AND count(*) FILTER (ink) > 0 THEN 'scanned' WHEN count(*) FILTER (ink) > 0 AND round(count(*) FILTER (ch = '%')::DOUBLE / count(*) FILTER (ink), 4) >= 0.1 THEN 'unreliable' ELSE 'digital' END AS text_layer FROM p GROUP BY document_id, page""")
def page_state(spark, sf_dir):
    return P.classify(P.statistics(_chars(spark, sf_dir))).select("document_id", "page", "chars", "invisible_ratio", "unmapped_ratio", "text_layer")


@query(f"WITH {_CHARS}, s AS (SELECT document_id, CASE WHEN r = 0 THEN 14.0::DOUBLE ELSE 10.0::DOUBLE END AS size, count(*) AS n FROM p WHERE ink AND document_id % 5 <> 0 GROUP BY ALL) SELECT document_id, arg_max(size, n * 100 - size) AS body FROM s GROUP BY document_id")
def body_size_mode(spark, sf_dir):
    return P.body_size(_chars(spark, sf_dir))


@query(f"""WITH {_CHARS}, v AS (SELECT document_id, page, i FROM p WHERE ink AND document_id % 5 <> 0) SELECT document_id, page, count(*) FILTER (k = 0) AS layer_chars, count(*) FILTER (k = 0 AND i % 97 <> 3) AS in_blocks, count(*) FILTER (k = 0 AND i % 97 = 3) AS missing, CAST(count(*) FILTER (k = 1 AND i % 89 = 4 AND i % 97 <> 3) AS BIGINT) AS doubled FROM v, (VALUES (0), (1)) z(k) GROUP BY document_id, page""")
def ledger_mismatch(spark, sf_dir):
    chars = _chars(spark, sf_dir)
    owned = chars.where("NOT invisible AND trim(text) <> '' AND char_id % 97 <> 3").select("document_id", "page", "char_id")
    return P.ledger(chars, owned.union(owned.where("char_id % 89 = 4")))


@query("""WITH g AS (SELECT user_id, event_id, sum(CASE WHEN gap > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS group_id FROM (SELECT user_id, event_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS gap FROM events)) SELECT user_id, CAST(group_id AS BIGINT) AS group_id, count(*) AS n, min(event_id) AS first_event FROM g GROUP BY ALL""")
def gap_split(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return P.gap_groups(e, ["user_id"], "us", "us", F.lit(3_600_000_000), ["us", "event_id"]).groupBy("user_id", "group_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(f"""WITH {_LINES}, z AS (SELECT doc_id AS document_id, CAST(ord // 10 + 1 AS INTEGER) AS page, ord AS line_id, CASE WHEN ord % 10 = 0 THEN 'Report ' || (ord // 10) WHEN ord % 10 = 9 THEN CAST(ord // 10 AS VARCHAR) ELSE text END AS text, CASE WHEN ord % 10 = 0 THEN 0.05 WHEN ord % 10 = 9 THEN 0.95 ELSE 0.5 END AS centre FROM l),
    n AS (SELECT document_id, max(page) AS n_pages FROM z GROUP BY 1), k AS (SELECT *, regexp_replace(text, '[\\d\\s]+', '', 'g') AS key, CASE WHEN centre < 0.1 THEN 'page_header' ELSE 'page_footer' END AS zone FROM z JOIN n USING (document_id) WHERE centre <> 0.5 AND n_pages >= 3),
    c AS (SELECT *, count(*) OVER (PARTITION BY document_id, zone, key) AS seen FROM k) SELECT document_id, page, CAST(line_id AS INTEGER) AS line_id, zone, text, seen FROM c WHERE 2 * seen >= n_pages""")
def repeated_margins(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("line_id", "text"))
    k, page = F.col("line_id") % 10, F.floor(F.col("line_id") / 10)
    lines = d.select("document_id", (page + 1).cast("int").alias("page"), "line_id", F.when(k == 0, F.concat(F.lit("Report "), page.cast("string"))).when(k == 9, page.cast("string")).otherwise(F.col("text")).alias("text"), F.when(k == 0, 0.05).when(k == 9, 0.95).otherwise(0.5).alias("centre"))
    return P.repeated_margins(lines, lines.groupBy("document_id").agg(F.max("page").alias("n_pages")))


@query("""WITH i AS (SELECT l_orderkey AS k, l_linenumber % 2 AS src, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS seq, l_quantity AS top FROM lineitem), m AS (SELECT *, max(top) OVER (PARTITION BY k, src ORDER BY seq) AS z FROM i) SELECT k, CAST(src AS INTEGER) AS src, CAST(seq AS INTEGER) AS seq, CAST(row_number() OVER (PARTITION BY k ORDER BY z, src, seq) - 1 AS INTEGER) AS ord FROM m""")
def order_merge(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") % 2).alias("src"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("top"))
    li = li.withColumn("seq", F.row_number().over(W.partitionBy("k", "src").orderBy("l_linenumber", "l_partkey", "l_suppkey", "top")))
    return P.merged_order(li, ["k"]).select("k", "src", "seq", "ord")


# --- geometry -----------------------------------------------------------------------------


def _first_lines(spark, sf_dir):
    """One row per order and line number: the greatest, as some repeat."""
    fields = ("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag")
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct(*fields)).alias("s")).select("l_orderkey", "l_linenumber", "s.*")


_FIRST = "SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_discount DESC, l_returnflag DESC"


def _all_lines(spark, sf_dir):
    """Every row, repeated ones too."""
    return _t(spark, sf_dir, "lineitem")


def _numbered(rows, name, *keys):
    """Rows with a number within ``keys`` that all other columns decide."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*[c for c in rows.columns if c not in (*keys, name)])).cast("bigint"))


def _boxes(spark, sf_dir, lines=_first_lines):
    """Boxes of a page from the lines of 25 orders."""
    li = lines(spark, sf_dir)
    x, y = (F.col("l_partkey") * 37 % 400).cast("double"), (F.col("l_suppkey") * 91 % 600).cast("double")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    if lines is not _first_lines:  # keys repeat
        li, key = _numbered(li.withColumn("page", F.floor(F.col("l_orderkey") / 25)), "box_id", "page"), F.col("box_id")
    return li.select(F.floor(F.col("l_orderkey") / 25).alias("page"), key.alias("box_id"), F.when(F.col("l_returnflag") == "A", "table").otherwise("image").alias("cls"), (F.lit(0.15) + F.col("l_discount") * 8).alias("score"), x.alias("x0"), y.alias("y0"), (x + 60 + F.col("l_quantity") * 4).alias("x1"), (y + 40 + F.col("l_quantity") * 4).alias("y1"))


_BOXES = f"bx AS (SELECT l_orderkey // 25 AS page, l_orderkey * 10 + l_linenumber AS box_id, (l_partkey * 37 % 400)::DOUBLE AS x0, (l_suppkey * 91 % 600)::DOUBLE AS y0, (l_partkey * 37 % 400)::DOUBLE + 60 + l_quantity * 4 AS x1, (l_suppkey * 91 % 600)::DOUBLE + 40 + l_quantity * 4 AS y1 FROM ({_FIRST}))"


@query(f"""WITH {_BOXES}, j AS (SELECT a.page, a.box_id AS a, b.box_id AS b, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s FROM bx a JOIN bx b ON a.page = b.page AND a.box_id < b.box_id) SELECT page, a, b, round(i / (s - i), 6) AS iou FROM j WHERE i / (s - i) >= 0.3""")
def box_iou(spark, sf_dir, lines=_first_lines):
    return L.overlapping(_boxes(spark, sf_dir, lines), ["page"], 0.3).withColumn("iou", F.round("iou", 6))


@query(f"""WITH RECURSIVE {_BOXES}, e AS (SELECT a.page, a.box_id AS a, b.box_id AS b FROM bx a JOIN bx b ON a.page = b.page AND a.box_id <> b.box_id WHERE a.page < 40 AND (greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)) / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)) >= 0.6),
    r(page, a, b) AS (SELECT page, a, b FROM e UNION SELECT r.page, r.a, e.b FROM r JOIN e ON r.page = e.page AND r.b = e.a) SELECT page, a AS node, least(a, min(b)) AS component FROM r GROUP BY page, a""".replace("a.page < 40 AND ", ""))
def connected_components(spark, sf_dir, lines=_first_lines):
    return L.components(L.overlapping(_boxes(spark, sf_dir, lines), ["page"], 0.6).select("page", "a", "b"), ["page"])


_IOU_K = "greatest(least(k.x1, s.x1) - greatest(k.x0, s.x0), 0) * greatest(least(k.y1, s.y1) - greatest(k.y0, s.y0), 0)"


@query(f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, box_id) AS n FROM (SELECT l_orderkey // 25 AS page, l_orderkey * 10 + l_linenumber AS box_id, CASE l_returnflag WHEN 'A' THEN 'table' ELSE 'image' END AS cls, 0.15::DOUBLE + l_discount * 8 AS score,
        (l_partkey * 37 % 400)::DOUBLE AS x0, (l_suppkey * 91 % 600)::DOUBLE AS y0, (l_partkey * 37 % 400)::DOUBLE + 60 + l_quantity * 4 AS x1, (l_suppkey * 91 % 600)::DOUBLE + 40 + l_quantity * 4 AS y1 FROM ({_FIRST})) WHERE score >= 0.2),
    f(page, n, kept) AS (SELECT page, 0::BIGINT, []::STRUCT(box_id BIGINT, cls VARCHAR, score DOUBLE, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[] FROM (SELECT DISTINCT page FROM s)
        UNION ALL SELECT f.page, s.n, CASE WHEN len(list_filter(f.kept, lambda k: {_IOU_K} > CASE WHEN k.cls = s.cls THEN 0.6 ELSE 0.98 END * ((k.x1 - k.x0) * (k.y1 - k.y0) + (s.x1 - s.x0) * (s.y1 - s.y0) - {_IOU_K}))) = 0
            THEN list_append(f.kept, {{'box_id': s.box_id, 'cls': s.cls, 'score': s.score, 'x0': s.x0, 'y0': s.y0, 'x1': s.x1, 'y1': s.y1}}) ELSE f.kept END FROM f JOIN s ON s.page = f.page AND s.n = f.n + 1)
    SELECT page, u.box_id, u.cls, u.score, u.x0, u.y0, u.x1, u.y1 FROM (SELECT page, unnest(kept) AS u FROM (SELECT page, arg_max(kept, n) AS kept FROM f GROUP BY page))""")
def nms_greedy(spark, sf_dir, lines=_first_lines):
    return L.suppress(_boxes(spark, sf_dir, lines), ["page"])


@query("""WITH s AS (SELECT o_custkey AS k, (o_orderkey * 7 % 1000)::DOUBLE AS a, (o_orderkey * 7 % 1000 + 20 + o_orderkey % 30)::DOUBLE AS b FROM orders), m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS z FROM s), g AS (SELECT *, sum(CASE WHEN z IS NULL OR a > z THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM m) SELECT k, min(a) AS start, max(b) AS "end", count(*) AS pieces FROM g GROUP BY k, grp""")
def interval_union(spark, sf_dir):
    a = (F.col("o_orderkey") * 7 % 1000).cast("double")
    return L.interval_union(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), a.alias("start"), (a + 20 + F.col("o_orderkey") % 30).alias("end")), ["k"])


def _rules(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    start = (k * 13 % 500).cast("double")
    return o.select(F.floor(k / 100).alias("page"), k.alias("rule_id"), F.when(k % 2 == 0, "h").otherwise("v").alias("axis"), (k * 31 % 700).cast("double").alias("pos"), start.alias("start"), (start + 50 + k % 200).alias("end"))


_RULES = "ru AS (SELECT o_orderkey // 100 AS page, o_orderkey AS id, o_orderkey % 2 AS v, (o_orderkey * 31 % 700)::DOUBLE AS pos, (o_orderkey * 13 % 500)::DOUBLE AS s, (o_orderkey * 13 % 500 + 50 + o_orderkey % 200)::DOUBLE AS e FROM orders)"


@query(f"WITH {_RULES} SELECT h.page, h.id AS h_id, v.id AS v_id FROM ru h JOIN ru v ON h.page = v.page AND h.v = 0 AND v.v = 1 WHERE v.pos BETWEEN h.s - 2 AND h.e + 2 AND h.pos BETWEEN v.s - 2 AND v.e + 2")
def rule_band_join(spark, sf_dir):
    return L.crossings(_rules(spark, sf_dir), ["page"]).select("page", "h_id", "v_id")


@query(f"""WITH {_RULES}, c AS (SELECT *, sum(CASE WHEN d > 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY page, v ORDER BY pos, s, e ROWS UNBOUNDED PRECEDING) AS ch FROM (SELECT *, pos - lag(pos) OVER (PARTITION BY page, v ORDER BY pos, s, e) AS d FROM ru)), m AS (SELECT *, max(e) OVER (PARTITION BY page, v, ch ORDER BY s, e, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS z FROM c), g AS (SELECT *, sum(CASE WHEN z IS NULL OR s > z + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY page, v, ch ORDER BY s, e, pos ROWS UNBOUNDED PRECEDING) AS grp FROM m)
    SELECT page, CASE v WHEN 0 THEN 'h' ELSE 'v' END AS axis, round(avg(pos), 6) AS pos, min(s) AS start, max(e) AS "end", count(*) AS pieces FROM g GROUP BY page, v, ch, grp""")
def rule_merge(spark, sf_dir):
    return L.merge_rules(_rules(spark, sf_dir), ["page"]).withColumn("pos", F.round("pos", 6))


@query(f"""WITH {_BOXES}, g AS (SELECT o_orderkey // 25 AS page, o_orderkey AS id, (o_orderkey * 17 % 500 + 3)::DOUBLE AS cx, (o_orderkey * 29 % 700 + 5)::DOUBLE AS cy FROM orders) SELECT bx.page, box_id, count(*) AS glyphs FROM g JOIN bx ON g.page = bx.page AND cx BETWEEN x0 - 1 AND x1 + 1 AND cy BETWEEN y0 - 1 AND y1 + 1 GROUP BY ALL""")
def glyphs_in_boxes(spark, sf_dir, lines=_first_lines):
    k = F.col("o_orderkey")
    x, y = (k * 17 % 500).cast("double"), (k * 29 % 700).cast("double")
    chars = _t(spark, sf_dir, "orders").select(F.floor(k / 25).alias("page"), k.alias("char_id"), x.alias("x0"), y.alias("y0"), (x + 6).alias("x1"), (y + 10).alias("y1"))
    return L.glyphs_in_boxes(chars, _boxes(spark, sf_dir, lines), ["page"], 1.0).groupBy("page", "box_id").agg(F.count("*").alias("glyphs"))


@query(f"""WITH RECURSIVE {_BOXES}, c AS (SELECT bx.*, l_returnflag = 'A' AS cap FROM bx JOIN ({_FIRST}) l ON bx.box_id = l.l_orderkey * 10 + l.l_linenumber),
    p AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY gap, figure, caption) AS n FROM (SELECT a.page, a.box_id AS figure, b.box_id AS caption, greatest(b.y0 - a.y1, a.y0 - b.y0 - 12, 0)::DOUBLE AS gap FROM c a JOIN c b ON a.page = b.page AND NOT a.cap AND b.cap
        WHERE least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.3 * least(a.x1 - a.x0, b.x1 - b.x0)) WHERE gap <= 30),
    f(page, n, fs, cs) AS (SELECT page, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM (SELECT DISTINCT page FROM p)
        UNION ALL SELECT f.page, p.n, CASE WHEN list_contains(fs, figure) OR list_contains(cs, caption) THEN fs ELSE list_append(fs, figure) END, CASE WHEN list_contains(fs, figure) OR list_contains(cs, caption) THEN cs ELSE list_append(cs, caption) END FROM f JOIN p ON p.page = f.page AND p.n = f.n + 1),
    t AS (SELECT page, arg_max(fs, n) AS fs, arg_max(cs, n) AS cs FROM f GROUP BY page)
    SELECT u.page, u.figure, u.caption, p.gap FROM (SELECT page, unnest(fs) AS figure, unnest(cs) AS caption FROM t) u JOIN p USING (page, figure, caption)""")
def caption_pairs(spark, sf_dir, lines=_first_lines):
    b = _boxes(spark, sf_dir, lines)
    captions = b.where("cls = 'table'").withColumn("y1", F.col("y0") + 12)
    return L.caption_pairs(b.where("cls = 'image'"), captions, ["page"])


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN v WHEN 2 THEN 1 - u WHEN 3 THEN 1 - v ELSE u END AS x, CASE o_orderkey % 4 WHEN 1 THEN u WHEN 2 THEN v WHEN 3 THEN 1 - u ELSE 1 - v END AS y FROM (SELECT o_orderkey, (o_orderkey % 600)::DOUBLE / 600 AS u, (o_custkey % 800)::DOUBLE / 800 AS v FROM orders)""")
def visible_points(spark, sf_dir):
    frame = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(800.0).alias("y1"))
    p = G.visible_point((F.col("o_orderkey") % 600).cast("double"), (F.col("o_custkey") % 800).cast("double"), frame, (F.col("o_orderkey") % 4) * 90)
    return _t(spark, sf_dir, "orders").select("o_orderkey", p.alias("p")).select("o_orderkey", "p.x", "p.y")


def _ocr(spark, sf_dir, lines=_first_lines):
    """Lines of a two-column page from order lines."""
    li, key = lines(spark, sf_dir), F.col("l_linenumber")
    if lines is not _first_lines:
        li, key = _numbered(li, "line_id", "l_orderkey"), F.col("line_id")
    x, y = F.when(F.col("l_linenumber") % 2 == 0, 320.0).otherwise(40.0), 60 + F.floor(F.col("l_linenumber") / 2) * 14.0 + F.col("l_quantity") % 3
    return li.select(F.col("l_orderkey").alias("page"), key.alias("line_id"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("text"), (1 - F.col("l_discount") * 5).alias("score"), x.alias("x0"), y.alias("y0"), (x + 200).alias("x1"), (y + 10).alias("y1"))


@query(f"""WITH o AS (SELECT l_orderkey AS page, l_linenumber AS line_id, l_linenumber % 2 = 0 AS rgt, 60 + l_linenumber // 2 * 14.0 + l_quantity % 3 AS y FROM ({_FIRST})) SELECT page, line_id, CAST(row_number() OVER (PARTITION BY page ORDER BY rgt, y, line_id) - 1 AS BIGINT) AS seq FROM o""")
def reading_order(spark, sf_dir, lines=_first_lines):
    return L.reading_order(_ocr(spark, sf_dir, lines), ["page"]).select("page", "line_id", "seq")


@query(f"""WITH o AS (SELECT l_orderkey AS page, l_linenumber AS line_id, l_linenumber % 2 = 0 AS rgt, 60 + l_linenumber // 2 * 14.0::DOUBLE + l_quantity % 3 AS y, 1 - l_discount * 5 AS score FROM ({_FIRST})),
    q AS (SELECT *, row_number() OVER w AS seq, lag(y) OVER w AS py, lag(rgt) OVER w AS pr FROM o WHERE score >= 0.5 WINDOW w AS (PARTITION BY page ORDER BY rgt, y, line_id)),
    g AS (SELECT *, sum(CASE WHEN py IS NOT NULL AND y > py + 5 AND y - py - 10 <= 8 AND rgt = pr THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY seq) - 1 AS group_id FROM q)
    SELECT page, group_id, string_agg('line ' || line_id, chr(10) ORDER BY seq) AS text, round(avg(score) * 0.5, 3) AS confidence FROM g GROUP BY ALL""")
def ocr_paragraphs(spark, sf_dir, lines=_first_lines):
    lines = P.paragraphs(L.reading_order(P.ocr_keep(_ocr(spark, sf_dir, lines).withColumn("covered", F.lit(0.0))), ["page"]), ["page"])
    return lines.groupBy("page", "group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "\n").alias("text"), F.round(F.avg("score") * 0.5, 3).alias("confidence"))


def _drawn(spark, sf_dir):
    """The nation tables drawn with rules: rows of 20 points, columns of 100, the first column merged, its text at the top."""
    cells = _nation_cells(spark, sf_dir).withColumn("page", F.col("table_id"))
    size = cells.select("page", "n_rows").distinct()
    h = size.select("page", F.lit("h").alias("axis"), F.explode(F.sequence(F.lit(0), F.col("n_rows"))).alias("i"), "n_rows").select("page", "axis", (100 + F.col("i") * 20.0).alias("pos"), F.when((F.col("i") > 1) & (F.col("i") < F.col("n_rows")), 150.0).otherwise(50.0).alias("start"), F.lit(350.0).alias("end"))
    v = size.select("page", F.lit("v").alias("axis"), F.explode(F.array(*[F.lit(50.0 + 100 * i) for i in range(4)])).alias("pos"), F.lit(100.0).alias("start"), (100 + F.col("n_rows") * 20.0).alias("end"))
    glyphs = cells.select("page", (55 + F.col("col") * 100.0).alias("x"), (100 + F.col("row") * 20.0 + F.when(F.col("rowspan") > 1, 9).otherwise(12)).alias("baseline"), F.posexplode(F.split(F.regexp_replace("text", "\n", " "), "")).alias("i", "text"))
    return h.union(v), glyphs.select("page", "text", (F.col("x") + F.col("i") * 5).alias("x0"), (F.col("baseline") - 8).alias("y0"), (F.col("x") + F.col("i") * 5 + 5).alias("x1"), (F.col("baseline") + 2).alias("y1"), "baseline")


@query(f"""WITH {_CELLS} SELECT t AS page, CAST(0 AS INTEGER) AS table_no, CAST(k + 1 AS INTEGER) AS n_rows, CAST(3 AS INTEGER) AS n_cols, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, CAST(h AS INTEGER) AS rowspan, CAST(1 AS INTEGER) AS colspan, x AS text FROM (
    SELECT t, k, 1 AS r, 0 AS c, k AS h, r_name AS x FROM n WHERE r = 1 UNION ALL SELECT t, k, r, 1, 1, n_name FROM n UNION ALL SELECT t, k, r, 2, 1, CAST(n_nationkey AS VARCHAR) FROM n UNION ALL SELECT t, k, 0, c, 1, x FROM n, (VALUES (0, 'region'), (1, 'nation'), (2, 'a|b key')) v(c, x) WHERE r = 1)""")
def ruled_tables(spark, sf_dir):
    return RT.ruled_tables(*_drawn(spark, sf_dir), ["page"]).select("page", "table_no", "n_rows", "n_cols", "row", "col", "rowspan", "colspan", "text")


# --- Markdown, provenance, views -----------------------------------------------------------


@query("""WITH i AS (SELECT conv_id, role, turn, text FROM conversations WHERE text NOT LIKE '%' || chr(10) || '%' AND regexp_full_match(text, '[\\p{L} .,]+') AND trim(text) = text AND NOT contains(text, '  ')) SELECT conv_id AS document_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ord, CASE role WHEN 'system' THEN 'heading' WHEN 'user' THEN 'list_item' ELSE 'paragraph' END AS kind, text, CAST(CASE role WHEN 'system' THEN 1 END AS INTEGER) AS level FROM i""")
def markdown_blocks(spark, sf_dir):
    i = _t(spark, sf_dir, "conversations").where("text NOT LIKE '%\n%' AND text rlike '^[\\\\p{L} .,]+$' AND trim(text) = text AND NOT contains(text, '  ')")
    line = F.concat(F.when(F.col("role") == "system", "# ").when(F.col("role") == "user", "- ").otherwise(""), "text")
    docs = i.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("md")))), lambda s: s["md"]), "\n\n").alias("md"))
    return M.markdown_blocks(docs, "conv_id", "md").select("document_id", "ord", "kind", "text", "level")


@query()
def markdown_blocks_all(spark, sf_dir):
    """Every turn's whole text, each a document of its own; `markdown_blocks` keeps to the turns that its SQL can follow."""
    turns = _t(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text")
    return M.markdown_blocks(turns, "id", "text").select("document_id.conv_id", "document_id.turn", "ord", "kind", "text", "level", "section_path", "line_start", "line_end", "rows", "error")


@query("SELECT o_orderkey, o_orderkey % 3 <> 0 AND o_totalprice > 100000 AS passed FROM orders")
def gate_results(spark, sf_dir):
    check = lambda name, ok: F.struct(F.lit(name).alias("name"), ok.alias("passed"))
    g = R.gate(F.array(check("third", F.col("o_orderkey") % 3 != 0), check("price", F.col("o_totalprice") > 100000)))
    return _t(spark, sf_dir, "orders").select("o_orderkey", g["passed"].alias("passed"))


@query("SELECT o_orderkey, o_orderkey % 10 + 5 AS segments_total FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0")
def correction_violations(spark, sf_dir):
    k = F.col("o_orderkey")
    c = _t(spark, sf_dir, "orders").select("o_orderkey", (k % 10 + 5).alias("segments_total"), (k % 10).alias("fixed"), F.lit(2).alias("unchanged"), F.when(k % 7 == 0, 3).otherwise(2).alias("unmatched"), F.lit(1).alias("skipped"), F.when(k % 11 == 0, 9).otherwise(1).alias("unmatched_with_digits"))
    return R.correction_violations(c).select("o_orderkey", "segments_total")


@query("SELECT c.conv_id, c.turn, r.vec_id IS NOT NULL AS recorded FROM conversations c LEFT JOIN embeddings r ON r.vec_id = c.conv_id * 3 + c.turn")
def replay_join(spark, sf_dir):
    req = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2((F.col("conv_id") * 3 + F.col("turn")).cast("string"), 256).alias("fingerprint"))
    hits, misses = R.replay(req, _t(spark, sf_dir, "embeddings").select(F.sha2(F.col("vec_id").cast("string"), 256).alias("fingerprint")))
    return hits.select("conv_id", "turn", F.lit(True).alias("recorded")).union(misses.select("conv_id", "turn", F.lit(False)))


@query(f"WITH {_CHARS}, s AS (SELECT document_id, page, CASE WHEN document_id % 5 = 0 AND count(*) FILTER (ink) > 0 THEN 'scanned' WHEN count(*) FILTER (ink) > 0 AND round(count(*) FILTER (ch = '%')::DOUBLE / count(*) FILTER (ink), 4) >= 0.1 THEN 'unreliable' ELSE 'digital' END AS text_layer FROM p GROUP BY document_id, page) SELECT document_id, text_layer, count(*) AS pages FROM s GROUP BY ALL")
def view_page_states(spark, sf_dir):
    return VW.page_states(P.classify(P.statistics(_chars(spark, sf_dir))))


@query(f"WITH {_IDS} SELECT doc_id AS document_id, count(*) AS blocks, min(ord) = 0 OR count(*) > 0 AS shown FROM b GROUP BY doc_id")
def view_blocks(spark, sf_dir):
    data = VW.view_data(_blocks(spark, sf_dir))
    return data.select("document_id", F.size(F.from_json("data", "blocks array<struct<ord: int>>")["blocks"]).cast("bigint").alias("blocks"), (~F.col("data").contains("<")).alias("shown"))


# --- planning and integrity -----------------------------------------------------------------

_KINDS = "k AS (SELECT *, box_id % 3 AS m FROM bx)"
_OVER = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"


@query(f"""WITH {_BOXES}, {_KINDS} SELECT DISTINCT a.page, a.box_id FROM k a JOIN k b ON a.page = b.page AND a.m = 0 AND b.m = 1 AND {_OVER} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_OVER}) >= 0.5""")
def confirmed_tables(spark, sf_dir, lines=_first_lines):
    b = _boxes(spark, sf_dir, lines)
    return N.confirmed(b.where("box_id % 3 = 0"), b.where("box_id % 3 = 1"), ["page"]).select("page", "box_id")


@query(f"""WITH {_BOXES} SELECT page, box_id FROM bx a WHERE NOT EXISTS (SELECT 1 FROM bx b WHERE a.page = b.page AND a.box_id <> b.box_id AND a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1 AND (a.x1 - a.x0) * (a.y1 - a.y0) > (b.x1 - b.x0) * (b.y1 - b.y0))""")
def inner_boxes(spark, sf_dir, lines=_first_lines):
    return N.inner_boxes(_boxes(spark, sf_dir, lines), ["page"]).select("page", "box_id")


@query(f"""WITH {_BOXES}, {_KINDS}, j AS (SELECT a.page, a.box_id AS figure, b.box_id AS photo, (a.box_id * 7 % 100)::DOUBLE AS score, row_number() OVER (PARTITION BY a.page, a.box_id ORDER BY (b.x1 - b.x0) * (b.y1 - b.y0), b.box_id) AS r FROM k a JOIN k b ON a.page = b.page AND a.m = 0 AND b.m = 1 AND {_OVER} / ((a.x1 - a.x0) * (a.y1 - a.y0)) >= 0.8)
    SELECT page, photo, figure FROM (SELECT *, row_number() OVER (PARTITION BY page, photo ORDER BY score DESC, figure) AS z FROM j WHERE r = 1) WHERE z = 1""")
def photo_hosts(spark, sf_dir, lines=_first_lines):
    b = _boxes(spark, sf_dir, lines).withColumn("score", (F.col("box_id") * 7 % 100).cast("double"))
    return N.photo_hosts(b.where("box_id % 3 = 0"), b.where("box_id % 3 = 1"), ["page"])


_GAP = "CASE WHEN least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.3 * least(a.x1 - a.x0, b.x1 - b.x0) THEN greatest(b.y0 - a.y1, a.y0 - b.y1, 0) END"


@query(f"""WITH {_BOXES}, {_KINDS}, n AS (SELECT a.page, a.box_id AS caption, min({_GAP}) FILTER (b.m = 0) AS t, min({_GAP}) FILTER (b.m = 1) AS f FROM (SELECT * REPLACE (y0 + 10 AS y1) FROM k WHERE m = 2) a JOIN k b ON a.page = b.page AND b.m <> 2 GROUP BY ALL) SELECT page, caption, t FROM n WHERE t <= 30 AND (f IS NULL OR f > 30 OR t <= f)""")
def table_titles(spark, sf_dir, lines=_first_lines):
    b = _boxes(spark, sf_dir, lines)
    return N.table_titles(b.where("box_id % 3 = 2").withColumn("y1", F.col("y0") + 10), b.where("box_id % 3 = 0"), b.where("box_id % 3 = 1"), ["page"])


@query("""WITH s AS (SELECT o_custkey AS k, o_orderkey * 7 % 1000 AS lo, o_orderkey * 7 % 1000 + 20 + o_orderkey % 300 AS hi FROM orders), e AS (SELECT k, lo AS pos FROM s UNION SELECT k, hi FROM s), c AS (SELECT *, lead(pos) OVER (PARTITION BY k ORDER BY pos) AS nxt FROM e), n AS (SELECT c.k, c.pos, c.nxt, (SELECT count(*) FROM s WHERE s.k = c.k AND s.lo <= c.pos AND s.hi > c.pos) <= 1 AS ok FROM c WHERE nxt IS NOT NULL),
    g AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY pos ROWS UNBOUNDED PRECEDING) AS grp FROM n) SELECT k, min(pos) AS lo, max(nxt) AS hi FROM g WHERE ok GROUP BY k, grp""")
def free_runs(spark, sf_dir):
    lo = F.col("o_orderkey") * 7 % 1000
    return N.free_runs(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), lo.alias("lo"), (lo + 20 + F.col("o_orderkey") % 300).alias("hi")), ["k"], 1)


@query(f"""WITH {_RULES}, e AS (SELECT o_orderkey // 100 AS page, o_orderkey AS edge_id, o_orderkey % 2 AS v, (o_orderkey * 17 % 700)::DOUBLE AS pos, (o_orderkey * 5 % 400)::DOUBLE AS lo, (o_orderkey * 5 % 400 + 90)::DOUBLE AS hi FROM orders), m AS (SELECT e.page, edge_id, lo, hi, greatest(s, lo) AS a, least(e, hi) AS z FROM e JOIN ru ON e.page = ru.page AND e.v = ru.v AND abs(e.pos - ru.pos) <= 1.5 WHERE least(e, hi) > greatest(s, lo)),
    g AS (SELECT *, greatest(z - greatest(a, coalesce(max(z) OVER (PARTITION BY page, edge_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a)), 0) AS gain FROM m) SELECT page, edge_id, round(sum(gain) / 90, 6) AS cover FROM g GROUP BY page, edge_id""")
def edge_cover(spark, sf_dir):
    k = F.col("o_orderkey")
    edges = _t(spark, sf_dir, "orders").select(F.floor(k / 100).alias("page"), k.alias("edge_id"), F.when(k % 2 == 0, "h").otherwise("v").alias("axis"), (k * 17 % 700).cast("double").alias("pos"), (k * 5 % 400).cast("double").alias("lo"), (k * 5 % 400 + 90).cast("double").alias("hi"))
    return N.edge_cover(edges, _rules(spark, sf_dir), ["page"]).where("cover > 0").select("page", "edge_id", F.round("cover", 6).alias("cover"))


@query(f"""WITH {_CHARS}, ln AS (SELECT DISTINCT document_id, page, line AS line_id, 70 + r * 14.0 AS base FROM p), m AS (SELECT ln.document_id, ln.page, line_id, count(*) FILTER (r = (line_id % 50) AND i % 80 < 40 AND document_id % 5 <> 0) AS n FROM ln JOIN p USING (document_id, page) GROUP BY ALL)
    SELECT document_id, page, line_id, round(n * 6.0 / 240, 6)::DOUBLE AS covered FROM m""".replace("FROM ln JOIN p USING (document_id, page) GROUP BY ALL", "FROM ln JOIN (SELECT document_id, page, line AS line_id, r, i FROM p) q USING (document_id, page, line_id) GROUP BY ALL"))
def covered_share(spark, sf_dir):
    chars = _chars(spark, sf_dir)
    line = F.floor(F.col("char_id") / 80)
    lines = chars.select("document_id", "page", line.alias("line_id"), F.lit(60.0).alias("x0"), F.lit(300.0).alias("x1"), F.col("baseline").alias("b")).distinct().select("document_id", "page", "line_id", "x0", "x1", (F.col("b") - 7).alias("y0"), (F.col("b") + 1).alias("y1"))
    return N.covered_share(lines, chars, ["document_id", "page"]).select("document_id", "page", "line_id", F.round("covered", 6).alias("covered"))


@query("""WITH d AS (SELECT o_custkey AS page, o_orderkey % 50 AS row, count(*) AS n FROM orders GROUP BY ALL) SELECT page, row * 3.0::DOUBLE AS pos, 10.0::DOUBLE AS start, (10 + (n * 6 - 1) * 2 + 1)::DOUBLE AS "end", CAST(n * 6 AS INTEGER) AS pieces FROM d""")
def dash_join(spark, sf_dir):
    d = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page"), (F.col("o_orderkey") % 50).alias("row")).agg(F.count("*").alias("n"))
    p = d.select("page", F.lit("h").alias("axis"), (F.col("row") * 3.0).alias("pos"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") * 6 - 1)).alias("i"))
    return N.join_dashes(p.select("page", "axis", "pos", (10.0 + F.col("i") * 2).alias("start"), (11.0 + F.col("i") * 2).alias("end")), ["page"]).select("page", "pos", "start", "end", "pieces")


@query("""SELECT o_custkey AS document_id, CAST(1 AS INTEGER) AS version, o_orderkey AS ord, p.problem FROM orders, (VALUES (3, 'table'), (5, 'level'), (7, 'mixed'), (11, 'source'), (11, 'state')) p(m, problem) WHERE o_orderkey % p.m = 0 AND (p.m <> 11 OR o_orderkey % 7 <> 0)""")
def block_problems(spark, sf_dir):
    k = F.col("o_orderkey")
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.lit(1).alias("version"), k.alias("ord"), F.lit("paragraph").alias("kind"), (k % 3 == 0).alias("has_table"), F.when(k % 5 == 0, 2).alias("level"), F.when((k % 11 == 0) & (k % 7 != 0), "unverified").otherwise("det").alias("state"), F.when(k % 7 == 0, "mixed").when(k % 11 == 0, "vlm").otherwise("native").alias("text_source"))
    return I.block_problems(o, o.select("document_id", "version").distinct().withColumn("layer_state", F.lit("det")))


@query("""SELECT o_custkey AS document_id, CAST(o_orderkey + 1 AS INTEGER) AS page, p.problem FROM orders, (VALUES (4, 'rotation'), (6, 'ledger'), (10, 'replaced')) p(m, problem) WHERE o_orderkey % p.m = 0""")
def page_problems(spark, sf_dir):
    k = F.col("o_orderkey")
    pages = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), (k + 1).cast("int").alias("page"), F.lit(600.0).alias("width_pt"), F.lit(800.0).alias("height_pt"), F.when(k % 4 == 0, 45).otherwise(90).alias("rotation"), F.lit("digital").alias("text_layer"), F.when(k % 6 == 0, 9).otherwise(F.when(k % 10 == 0, 8).otherwise(7)).alias("layer_chars"), F.lit(5).alias("in_blocks"), F.lit(2).alias("hidden"), F.when(k % 10 == 0, 1).otherwise(0).alias("replaced"), F.lit(0).alias("rescued"))
    return I.page_problems(pages)


@query("SELECT user_id AS document_id, max(event_id) AS version, count(*) AS changes FROM events GROUP BY user_id")
def stream_latest(spark, sf_dir):
    """The feed as a stream, every file once, folded into one table batch by batch."""
    import uuid

    from folioflow.sources.storage import shared_path
    from folioflow.streaming import feed

    root = f"{shared_path(spark)}/folio-stream-{uuid.uuid4().hex[:12]}"
    events = spark.readStream.schema(_t(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("version"))
    feed.run_batches(feed.latest_per_document(events), lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), f"{root}/checkpoint", mode="update")
    out = spark.read.parquet(f"{root}/out").withColumn("batch", F.col("batch").cast("bigint"))
    return V.latest(out.select("document_id", "batch", F.struct("version", "changes").alias("s")), version="batch").select("document_id", "s.version", "s.changes")


#: The same over every row; the SQL of the queries above keeps one row of each repeated key.
for _f in (box_iou, connected_components, nms_greedy, caption_pairs, glyphs_in_boxes, confirmed_tables, inner_boxes, photo_hosts, table_titles, reading_order, ocr_paragraphs):
    QUERIES[f"{_f.__name__}_all"] = partial(_f, lines=_all_lines)
