"""From files to the store and back: ingest, reads, views, the command line, schemas, streams."""

import json
import os

import pytest

from folioflow import cli, schemas
from folioflow.engine import Engine
from folioflow.errors import AssetNotFound, DocumentNotFound, StoreConflict, VersionNotFound, VlmUnavailable

MD = "# Title\n\nOne *line* <b>.\n\n- item\n\n| a | b |\n| --- | --- |\n| 1 | 2\\|3 |\n"


def files(spark, rows):
    return spark.createDataFrame([(n, bytearray(c), i) for n, c, i in rows], "name string, content binary, document_id string")


def test_ingest_versions_reads_and_rejects(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    first = {r["document_id"]: r for r in e.ingest(files(spark, [("a.md", MD.encode(), "a"), ("b.md", "한글".encode("cp949"), "b"), ("c.txt", b"x", "c"), ("d.md", b"\xff\xff\xff", "d"), ("e.md", (">" * 25 + " deep").encode(), "e"), ("f.md", b"", "f")])).collect()}
    assert {k: (r["status"], r["version"], r["error_code"]) for k, r in first.items()} == {"a": ("committed", 1, None), "b": ("committed", 1, None), "c": ("rejected", None, "UnsupportedFormat"), "d": ("rejected", None, "ParseError"), "e": ("rejected", None, "ParseError"), "f": ("committed", 1, None)}
    again = {r["document_id"]: (r["status"], r["version"]) for r in e.ingest(files(spark, [("a.md", (MD + "\nmore\n").encode(), "a"), ("b.md", "한글".encode("cp949"), "b")])).collect()}
    assert again == {"a": ("committed", 2), "b": ("unchanged", 1)}
    assert {r["document_id"]: (r["status"], r["version"]) for r in e.ingest(files(spark, [("b.md", "한글".encode("cp949"), "b")]), force=True).collect()} == {"b": ("committed", 2)}
    kinds = [(r["kind"], r["level"]) for r in e.tree("a", 1).collect()]
    assert kinds == [("heading", 1), ("paragraph", None), ("list_item", None), ("table", None)] and e.tree("a").count() == 5
    table = e.tree("a", 1).where("kind = 'table'").first()
    assert [(c["row"], c["col"], c["text"], c["header"]) for c in table["table"]["cells"]] == [(0, 0, "a", "column"), (0, 1, "b", "column"), (1, 0, "1", "none"), (1, 1, "2|3", "none")]
    page, head = e.changes(None, 10)
    log = {(r["document_id"], r["version"]): r for r in page.collect()}
    assert set(log) == {("a", 1), ("b", 1), ("f", 1), ("a", 2), ("b", 2)} and head["next_cursor"] == 5
    assert len(log["a", 2]["added"]) == 1 and not log["a", 2]["removed"] and log["a", 2]["previous_version"] == 1 and not log["b", 2]["added"] and log["f", 1]["added"] == []
    assert e.markdown("a", 1) == "# Title\n\nOne line <b>.\n\n- item\n\n| a | b |\n| --- | --- |\n| 1 | 2\\|3 |\n" and e.markdown("f") == ""
    tree = json.loads(e.tree_json("a", 2))
    assert tree["version"] == 2 and [b["ord"] for b in tree["blocks"]] == [0, 1, 2, 3, 4] and tree["blocks"][0]["locator"]["line_start"] == 1
    page = e.view("a", 2, 1)
    assert '"change":"added"' in page and "\\u003cb>" in page and "<b>." not in page and "default-src 'none'" in page
    assert [r["document_id"] for r in e.documents().collect()] == ["a", "b", "f"] and e.history("a").count() == 0
    for call, error in ((lambda: e.tree("z"), DocumentNotFound), (lambda: e.history("a", 9), VersionNotFound), (lambda: e.asset("sha256:0"), AssetNotFound), (lambda: e.run_vlm("a"), VlmUnavailable), (lambda: e.job("j"), VlmUnavailable)):
        with pytest.raises(error):
            call()


def test_a_conflict_is_tried_again_once(spark, tmp_path, monkeypatch):
    e = Engine(spark, f"file://{tmp_path}/store")
    real, calls = e.store.commit, []

    def commit(*args):
        calls.append(1)
        if len(calls) < fail:
            raise StoreConflict("taken")
        return real(*args)

    monkeypatch.setattr(e.store, "commit", commit)
    fail = 2
    assert e.ingest(files(spark, [("a.md", b"x", "a")])).first()["version"] == 1 and len(calls) == 2
    fail = 9
    with pytest.raises(StoreConflict):
        e.ingest(files(spark, [("a.md", b"y", "a")]))
    assert len(calls) == 4


def test_manifests_sum_up_the_markers(spark, tmp_path, monkeypatch):
    from folioflow.sources import storage

    monkeypatch.setattr(storage, "MANIFEST", 2)
    log = "seq bigint, document_id string, version int, previous_version int"
    store = storage.Store(spark, f"file://{tmp_path}/store")
    for v in range(1, 6):
        store.commit({}, spark.createDataFrame([("a", v, v - 1 or None)], "document_id string, version int, previous_version int"), log)
    names = sorted(os.listdir(f"{tmp_path}/store/_commits"))
    assert [n for n in names if n.endswith(".sum")] == ["000000000002.sum", "000000000004.sum"]
    read = []
    monkeypatch.setattr(store, "_read", lambda path, real=store._read: read.append(str(path)) or real(path))
    assert [c["n"] for c in store.commits()] == [1, 2, 3, 4, 5] and len(read) == 3  # two manifests of two commits each, one marker


def test_command_line(spark, tmp_path, capfd, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "in.md").write_text(MD, encoding="utf-8")
    (tmp_path / "in.txt").write_text("x")
    (tmp_path / "bad.md").write_bytes(b"\xff\xff\xff")
    run = lambda *a: (cli.main(["--store", f"file://{tmp_path}/store", *a], spark), capfd.readouterr().out)
    code, out = run("parse", "in.md", "--id", "a", "--format", "md")
    assert code == 0 and out.startswith("# Title\n")
    assert [run("parse", "in.txt")[0], run("parse", "bad.md")[0], run("export", "zz")[0], run("parse", "none.md")[0], run("changes", "--limit", "0")[0], run("nothing")[0]] == [3, 4, 5, 1, 2, 2]
    assert run("export", "a", "--out", "out.json", "--assets", "images")[0] == 0 and json.loads((tmp_path / "out.json").read_text())["document_id"] == "a"
    assert run("export", "a", "--out", "images")[0] == 1
    assert json.loads(run("documents")[1])[0]["document_id"] == "a" and json.loads(run("changes")[1])["next_cursor"] == 1 and json.loads(run("history", "a")[1]) == []
    assert run("view", "in.md", "--id", "a")[0] == 0 and "Title" in (tmp_path / "in.view.html").read_text()
    assert run("schemas", "s")[0] == 0 and run("schemas", "s", "--check")[0] == 0
    (tmp_path / "s" / "old.schema.json").write_text("{}")
    (tmp_path / "s" / "blocks.schema.json").write_text("{}")
    assert schemas.check(str(tmp_path / "s")) == ["orphan: old.schema.json", "stale: blocks.schema.json"] and run("schemas", "s", "--check")[0] == 1
    import hashlib

    (tmp_path / "m.bin").write_bytes(b"model")
    entry = {"name": "m", "path": "m.bin", "bytes": 5, "sha256": hashlib.sha256(b"model").hexdigest()}
    (tmp_path / "m.json").write_text(json.dumps({"files": [entry]}))
    assert run("models", "m.json")[0] == 0
    (tmp_path / "m.json").write_text(json.dumps({"files": [{**entry, "bytes": 6}]}))
    assert run("models", "m.json")[0] == 1


def test_a_stream_that_outlasts_its_timeout_raises(spark, tmp_path):
    import time

    from folioflow.streaming import feed

    path = f"file://{tmp_path}/in"
    spark.range(5).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("id bigint").parquet(path)
    with pytest.raises(TimeoutError):
        feed.run_batches(stream, lambda df, n: time.sleep(20), f"file://{tmp_path}/c", timeout=1)
    seen = []
    feed.run_batches(spark.readStream.schema("id bigint").parquet(path), lambda df, n: seen.append(df.count()), f"file://{tmp_path}/c2")
    assert seen == [5]


def test_notices_and_export_of_figures(spark):
    from folioflow.operators import blocks as B
    from folioflow.operators.view import view_name

    rows = [("d", 0, "figure", None, "alt text", "sha256:" + "ab" * 32, "A [cap]"), ("d", 1, "figure", None, "", "sha256:" + "cd" * 32, None), ("d", 2, "figure", None, "", None, None), ("d", 3, "list_item", None, "12) twelve", None, None), ("d", 4, "page_header", None, "head", None, None), ("d", 5, "caption", None, "A [cap]", None, None)]
    df = spark.createDataFrame(rows, "document_id string, ord int, kind string, level int, text string, asset string, caption string")
    assert B.export_markdown(df, assets_dir="my images").first()["markdown"] == f"![A \\[cap\\]](my%20images/{'ab' * 8}.png)\n\nalt text\n\n![](my%20images/{'cd' * 8}.png)\n\n12) twelve\n\nA [cap]\n"
    assert view_name("a/b/Report.v2.pdf") == "Report.v2.view.html" and view_name(".hidden") == ".hidden.view.html"


def told(rows):
    return sorted((r["document_id"], r["name"], r["status"], r["version"]) for r in rows.collect())


def test_files_of_one_document_follow_each_other(spark, tmp_path):
    """Equal and other bytes under one id, in one batch: no version twice, every change from the one before."""
    from folioflow import schemas as S
    from folioflow.operators import versions as V

    e = Engine(spark, f"file://{tmp_path}/store")
    rows = [("1.md", b"one", "a"), ("2.md", b"one", "a"), ("3.md", b"two\n\none", "a"), ("4.md", b"\xff\xff\xff", "a"), ("5.md", b"two\n\none", "a"), ("6.md", b"one", "a"), ("x.md", b"same", None), ("y.md", b"same", None), ("z.txt", b"same", None)]
    got = told(e.ingest(files(spark, rows)))
    hashed = next(d for d, n, *_ in got if n == "x.md")
    assert got == sorted([("a", "1.md", "committed", 1), ("a", "2.md", "unchanged", 1), ("a", "3.md", "committed", 2), ("a", "4.md", "rejected", None), ("a", "5.md", "unchanged", 2), ("a", "6.md", "committed", 3), (hashed, "x.md", "committed", 1), (hashed, "y.md", "unchanged", 1), (hashed, "z.txt", "rejected", None)], key=str)
    assert told(e.ingest(files(spark, [("7.md", b"one", "a"), ("8.md", b"one\n\nthree", "a")]))) == [("a", "7.md", "unchanged", 3), ("a", "8.md", "committed", 4)]
    log = e.store.read("change_log", S.CHANGES)
    sets = {r["version"]: (r["previous_version"], len(r["added"]), len(r["updated"]), len(r["removed"])) for r in log.where("document_id = 'a'").collect()}
    assert sets == {1: (None, 1, 0, 0), 2: (1, 1, 1, 0), 3: (2, 0, 1, 1), 4: (3, 1, 0, 0)}
    assert V.chain_violations(log).isEmpty() and [r["seq"] for r in log.orderBy("seq").collect()] == [1, 2, 3, 4, 5]
    assert [[r["text"] for r in e.tree("a", v).collect()] for v in (1, 2, 3, 4)] == [["one"], ["two", "one"], ["one"], ["one", "three"]]
    assert e.store.read("blocks", S.BLOCKS).groupBy("document_id", "version", "ord").count().where("count > 1").isEmpty()


def test_arrival_orders_files(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([("b.md", bytearray(b"first"), "a", 1), ("a.md", bytearray(b"second"), "a", 2)], "name string, content binary, document_id string, arrival int")
    assert told(e.ingest(rows)) == [("a", "a.md", "committed", 2), ("a", "b.md", "committed", 1)]
    assert told(e.ingest(rows, force=True)) == [("a", "a.md", "committed", 4), ("a", "b.md", "committed", 3)]


def test_commits_refuse_what_does_not_follow(spark, tmp_path):
    from folioflow.sources import storage

    log = "seq bigint, document_id string, version int, previous_version int"
    store = storage.Store(spark, f"file://{tmp_path}/store")
    change = lambda *rows: spark.createDataFrame(list(rows), "document_id string, version int, previous_version int")
    store.commit({}, change(("a", 1, None), ("a", 2, 1)), log)
    for bad in ([("a", 3, 2), ("a", 3, 2)], [("a", 4, 3)], [("a", 3, 1)], [("b", 1, None), ("b", 1, None)], [("a", 3, 2), ("a", 5, 4)]):
        with pytest.raises(StoreConflict):
            store.commit({}, change(*bad), log)
    v = "document_id string, version int"
    for versions in ([("a", 3), ("a", 3)], [("b", 1)], []):
        with pytest.raises(StoreConflict):
            store.commit({"versions": spark.createDataFrame(versions, v)}, change(("a", 3, 2)), log)
    assert len(store.commits()) == 1 and os.listdir(f"{tmp_path}/store/change_log") == [f"batch={store.commits()[0]['batch']}"]


def test_what_fails_before_its_marker_leaves_nothing(spark, tmp_path, monkeypatch):
    """A failing task and a failing driver step: no marker, no files; what a lost driver leaves is swept."""
    from pyspark.sql import functions as F

    from folioflow.sources import storage

    log = "seq bigint, document_id string, version int, previous_version int"
    store = storage.Store(spark, f"file://{tmp_path}/store")
    change = spark.createDataFrame([("a", 1, None)], "document_id string, version int, previous_version int")
    broken = spark.range(3).select(F.col("id").cast("string").alias("document_id"), F.raise_error(F.lit("lost")).cast("int").alias("page"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"pages": broken}, change, log)
    left = lambda: [d for t in ("pages", "change_log", "_index") if os.path.isdir(f"{tmp_path}/store/{t}") for d in os.listdir(f"{tmp_path}/store/{t}")]
    assert store.commits() == [] and left() == []
    real = store._create
    monkeypatch.setattr(store, "_create", lambda path, value: (_ for _ in ()).throw(StoreConflict(path)))
    with pytest.raises(StoreConflict):
        store.commit({}, change, log)
    assert left() == []
    monkeypatch.setattr(store, "_delete", lambda batch: None)  # the driver is lost: nobody tidies up
    with pytest.raises(StoreConflict):
        store.commit({}, change, log)
    monkeypatch.undo()
    monkeypatch.setattr(store, "_create", real)
    assert len(set(left())) == 1 and store.sweep(3600) == []
    store.commit({}, change, log)
    assert len(store.sweep(0)) == 1 and set(left()) == {f"batch={store.commits()[0]['batch']}"}


def test_point_reads_open_few_files(spark, tmp_path):
    """Of many batches a read opens those files alone whose ranges and Bloom filters may hold its document."""
    from folioflow import schemas as S

    e = Engine(spark, f"file://{tmp_path}/store")
    for k in range(3):
        rows = [(f"{i}.md", f"# Doc {i}\n\ntext {k}".encode(), f"doc{i:03d}") for i in range(k, 30, 3)]
        e.ingest(files(spark, rows))
    tree = e.tree("doc007")
    assert [r["text"] for r in tree.collect()] == ["Doc 7", "text 1"]
    whole = e.store.read("blocks", S.BLOCKS).inputFiles()
    assert len(whole) >= 3 and len(tree.inputFiles()) == 1 and tree.inputFiles()[0] in whole
    assert e.store.keyed("blocks", S.BLOCKS, "document_id", "nobody").isEmpty()


def test_pages_become_versions(spark, tmp_path):
    """A page with text, a table and a figure: blocks, page record, regions and asset in one batch; a bad batch leaves no marker."""
    from folioflow import schemas as S
    from folioflow.errors import InvalidBatch
    from pyspark.sql import functions as F

    e = Engine(spark, f"file://{tmp_path}/store")
    glyphs, n = [], 0
    for text, x, y in (("Hello there.", 60, 100), ("Figure 1", 70, 430)):
        for i, c in enumerate(text):
            glyphs.append(("d", 1, n, c, x + 6.0 * i, y - 8.0, x + 6.0 * (i + 1), y + 2.0, float(y), 10.0, False, False, False, 0, 1))
            n += 1
    chars = spark.createDataFrame(glyphs, "document_id string, page int, char_id bigint, text string, x0 double, y0 double, x1 double, y1 double, baseline double, size double, bold boolean, invisible boolean, unmapped boolean, along int, down int")
    pages = spark.createDataFrame([("d", 1, 600.0, 800.0)], "document_id string, page int, width_pt double, height_pt double")
    images = spark.createDataFrame([("d", 1, 60.0, 260.0, 300.0, 415.0)], "document_id string, page int, x0 double, y0 double, x1 double, y1 double")
    regions = spark.createDataFrame([("d", 1, "figure_title", 0.8, 60.0, 418.0, 300.0, 434.0)], "document_id string, page int, cls string, score double, x0 double, y0 double, x1 double, y1 double")
    source = lambda h: spark.createDataFrame([("d", "d.pdf", h)], "document_id string, name string, source_hash string")
    given = dict(pages=pages, chars=chars, images=images, regions=regions)
    assert told(e.ingest_pages(source("sha256:1"), **given)) == [("d", "d.pdf", "committed", 1)]
    assert [(r["kind"], r["text"], r["figure"]) for r in e.tree("d").collect()] == [("paragraph", "Hello there.", None), ("figure", "", None), ("caption", "Figure 1", None)]
    assert [(r["region_id"], r["fallback_reason"]) for r in e.history("d").collect()] == [("p1-figure-" + str(e.history("d").first()["region_id"].split("-")[-1]), "figure_without_image")]
    item = int(e.history("d").first()["region_id"].split("-")[-1])
    png = bytearray(b"\x89PNG not quite")
    crops = spark.createDataFrame([("d", 1, item, "image/png", png, 100, 80, 200)], "document_id string, page int, item_no int, mime string, bytes binary, width_px int, height_px int, dpi int")
    assert told(e.ingest_pages(source("sha256:1"), **given, crops=crops)) == [("d", "d.pdf", "unchanged", 1)]
    assert told(e.ingest_pages(source("sha256:2"), **given, crops=crops)) == [("d", "d.pdf", "committed", 2)]
    tree = e.tree("d").collect()
    figure = tree[1]["figure"]
    assert figure["caption_block_id"] == tree[2]["block_id"] and e.asset(figure["asset"]) == bytes(png) and e.history("d").count() == 0
    page = e.store.rows("pages", S.PAGES, S.VERSIONS, "d").first()
    assert (page["text_layer"], page["coverage"]["layer_chars"], page["coverage"]["in_blocks"]) == ("digital", 18, 18)
    change = e.changes(1, 10)[0].first()
    assert (change["version"], change["previous_version"], len(change["added"]), len(change["removed"])) == (2, 1, 1, 1)
    with pytest.raises(InvalidBatch):
        wide = pages.withColumn("width_pt", F.lit(-5.0)).withColumn("rotation", F.lit(7))
        e.ingest_pages(source("sha256:3"), wide, chars)
    assert len(e.store.commits()) == 2


def test_following_a_store_neither_loses_nor_repeats(spark, tmp_path):
    """Commits between runs come once; a failed micro-batch comes again; another store asks for a resync."""
    from folioflow.errors import ResyncRequired
    from folioflow.sources import storage
    from folioflow.streaming import changes

    log = "seq bigint, document_id string, version int, previous_version int"
    change = lambda *rows: spark.createDataFrame(list(rows), "document_id string, version int, previous_version int")
    store = storage.Store(spark, f"file://{tmp_path}/store")
    seen, at = [], f"file://{tmp_path}/cursor"
    take = lambda df, n: seen.extend((n, r["seq"], r["document_id"]) for r in df.select("seq", "document_id").orderBy("seq").collect())
    changes.follow(store, take, at)
    assert seen == []
    store.commit({}, change(("a", 1, None), ("b", 1, None)), log)
    changes.follow(store, take, at)
    store.commit({}, change(("a", 2, 1)), log)
    with pytest.raises(Exception, match="no"):
        changes.follow(store, lambda df, n: (_ for _ in ()).throw(ValueError("no")), at)
    store.commit({}, change(("c", 1, None)), log)
    changes.follow(store, take, at)
    changes.follow(store, take, at)
    assert [s[1:] for s in seen] == [(1, "a"), (2, "b"), (3, "a"), (4, "c")]
    other = storage.Store(spark, f"file://{tmp_path}/other")
    other.commit({}, change(("z", 1, None)), log)
    with pytest.raises(ResyncRequired):
        changes.follow(other, take, at)
