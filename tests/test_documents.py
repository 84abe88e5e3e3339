import hashlib
import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import blocks as B
from folioflow.operators import layout as L
from folioflow.operators import markdown as M
from folioflow.operators import pages as P
from folioflow.operators import tables as T
from folioflow.operators import versions as V


def py_hash(kind, text, level=None, table=None):
    norm = " ".join(unicodedata.normalize("NFKC", text).split())
    body = json.dumps({"kind": kind, "level": level, "table": table, "text": norm, "v": "norm-v1"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return "c_" + hashlib.sha256(body.encode()).hexdigest()[:32]


def test_content_hash_and_ids_match_the_definition(spark):
    texts = ["plain", 'quo"te \\ back', "ﬁ Ａ１", "tab\tand  spaces ", "\x0e\x1a\x1b ctl", "literal \\u001B", "한글 각", "plain", "é", "\x1c sep \x1f x"]
    df = spark.createDataFrame([("d", i, "paragraph", t) for i, t in enumerate(texts)], "document_id string, ord int, kind string, text string")
    got = {r["ord"]: r for r in B.with_ids(df).collect()}
    seen = {}
    for i, t in enumerate(texts):
        h = py_hash("paragraph", t)
        occ = seen[h] = seen.get(h, -1) + 1
        assert got[i]["content_hash"] == h, t
        assert got[i]["block_id"] == "b_" + hashlib.sha256("\x1f".join(["d", h, str(occ)]).encode()).hexdigest()[:24]


def random_table(r, n, m):
    """A random partition of an n x m grid into rectangles."""
    free, cells = {(i, j) for i in range(n) for j in range(m)}, []
    while free:
        i, j = min(free)
        h, w = r.randint(1, 3), r.randint(1, 3)
        while not all((i + a, j + b) in free for a in range(h) for b in range(w)):
            h, w = (h - 1, w) if h > 1 else (h, w - 1)
        free -= {(i + a, j + b) for a in range(h) for b in range(w)}
        cells.append((i, j, h, w))
    return cells


def test_random_tables_are_valid_and_render(spark):
    r = random.Random(5)
    rows, want = [], {}
    for t in range(30):
        n, m = r.randint(1, 5), r.randint(1, 5)
        cells = random_table(r, n, m)
        rows += [(t, n, m, i, j, h, w, f"{i}.{j}", "column" if i == 0 else "none") for i, j, h, w in cells]
        grid = [[""] * m for _ in range(n)]
        for i, j, h, w in cells:
            for a in range(h):
                for b in range(w):
                    grid[i + a][j + b] = f"{i}.{j}"
        by_row = [[c for c in sorted(cells) if c[0] == i] for i in range(n)]
        want[t] = ("\n".join("\t".join(f"{i}.{j}" for i, j, _, _ in row) for row in by_row), "\n".join(["| " + " | ".join(grid[0]) + " |", "|" + " --- |" * m] + ["| " + " | ".join(g) + " |" for g in grid[1:]]))
    df = spark.createDataFrame(rows, "table_id int, n_rows int, n_cols int, row int, col int, rowspan int, colspan int, text string, header string")
    assert T.violations(df).count() == 0
    assert {r["table_id"]: r["plain"] for r in T.plain_text(df).collect()} == {t: p for t, (p, _) in want.items()}
    assert {r["table_id"]: r["md"] for r in T.markdown(df).collect()} == {t: m for t, (_, m) in want.items()}
    assert {r["problem"] for r in T.violations(df.where("NOT (row = 0 AND col = 0)")).collect()} == {"cover"}


def test_section_paths_equal_a_stack(spark):
    r = random.Random(3)
    rows, want = [], {}
    for d in range(20):
        stack = []
        for i in range(25):
            level = r.choice([None, 1, 2, 3, 4, 5, 6])
            if level:
                while stack and stack[-1][0] >= level:
                    stack.pop()
            want[d, i] = [t for _, t in stack]
            if level:
                stack.append((level, f"h{i}"))
            rows.append((d, i, level, f"h{i}"))
    df = spark.createDataFrame(rows, "d int, i int, level int, t string")
    assert {(r["d"], r["i"]): r["section_path"] for r in B.section_paths(df, "d", "i", "level", "t").collect()} == want


def test_diff_of_a_version_with_itself_is_empty_and_applies(spark):
    a = B.with_ids(spark.createDataFrame([("d", i, "paragraph", f"line {i % 4}") for i in range(8)], "document_id string, ord int, kind string, text string"))
    b = B.with_ids(spark.createDataFrame([("d", i, "paragraph", f"line {i % 3}") for i in range(7)], "document_id string, ord int, kind string, text string"))
    assert V.block_diff(a, a, ["ord"]).count() == 0
    d = V.change_sets(V.block_diff(a, b, ["ord"])).first()
    ids = lambda df: {r["block_id"] for r in df.collect()}
    assert (ids(a) - set(d["removed"])) | set(d["added"]) == ids(b)


def test_paging(spark):
    log = spark.createDataFrame([(i, "d", i, i - 1 or None) for i in range(1, 11)], "seq bigint, document_id string, version int, previous_version int")
    page, head = V.page_of_changes(log, 3, 4)
    assert [r["seq"] for r in page.collect()] == [4, 5, 6, 7] and head["next_cursor"] == 7
    assert V.page_of_changes(log, 99, 4)[1] == {"cursor_from": 99, "next_cursor": 99, "resync_required": True}
    assert V.page_of_changes(log, 10, 4)[1]["next_cursor"] == 10
    assert V.chain_violations(log).count() == 0
    with pytest.raises(ValueError):
        V.page_of_changes(log, -1)
    blocks = spark.createDataFrame([("d", 1, 0)], "document_id string, version int, ord int")
    with pytest.raises(LookupError, match="version"):
        V.tree(blocks, blocks, "d", 2)
    with pytest.raises(LookupError, match="document"):
        V.tree(blocks, blocks, "x")


MD = """# Title

Intro *with* **marks** and `code`
second line  
third [link](http://x.y "t")

Sub
---

1. one
2. two

   more of two

- a
  - b

![alt](p.png)

> quoted text
> goes on

| h1 | h2 |
|----|----|
| a\\|b | c |
| d |

```py
code block
```

***
<div>
raw
</div>
"""


def test_markdown_blocks():
    got = [(b["kind"], b["text"], b["level"], b["section_path"]) for b in M.scan(MD)]
    assert got == [
        ("heading", "Title", 1, []),
        ("paragraph", "Intro with marks and code\nsecond line\nthird link", None, ["Title"]),
        ("heading", "Sub", 2, ["Title"]),
        ("list_item", "1. one", None, ["Title", "Sub"]),
        ("list_item", "2. two", None, ["Title", "Sub"]),
        ("paragraph", "more of two", None, ["Title", "Sub"]),
        ("list_item", "a", None, ["Title", "Sub"]),
        ("list_item", "b", None, ["Title", "Sub"]),
        ("figure", "alt", None, ["Title", "Sub"]),
        ("paragraph", "quoted text\ngoes on", None, ["Title", "Sub"]),
        ("table", "h1\th2\na|b\tc\nd\t", None, ["Title", "Sub"]),
        ("paragraph", "code block", None, ["Title", "Sub"]),
        ("paragraph", "<div>\nraw\n</div>", None, ["Title", "Sub"]),
    ]
    with pytest.raises(M.TooDeep):
        M.scan("> " * 30 + "x")
    assert M.scan("") == []


def test_suppression_and_captions_equal_the_greedy_loop(spark):
    r = random.Random(9)
    rows = [(p, i, r.choice("ab"), r.random(), *(lambda x, y, w, h: (x, y, x + w, y + h))(r.uniform(0, 50), r.uniform(0, 50), r.uniform(5, 40), r.uniform(5, 40))) for p in range(5) for i in range(40)]
    df = spark.createDataFrame(rows, "page int, box_id int, cls string, score double, x0 double, y0 double, x1 double, y1 double")
    got = {(r["page"], r["box_id"]) for r in L.suppress(df, ["page"]).collect()}

    def iou(a, b):
        w, h = max(0, min(a[6], b[6]) - max(a[4], b[4])), max(0, min(a[7], b[7]) - max(a[5], b[5]))
        return w * h / ((a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - w * h)

    want = set()
    for p in range(5):
        kept = []
        for a in sorted((x for x in rows if x[0] == p and x[3] >= 0.2), key=lambda x: -x[3]):
            if all(iou(a, k) <= (0.6 if a[2] == k[2] else 0.98) for k in kept):
                kept.append(a)
        want |= {(p, k[1]) for k in kept}
    assert got == want
    pairs = {(r["page"], r["figure"], r["caption"]) for r in L.caption_pairs(df.where("cls = 'a'"), df.where("cls = 'b'"), ["page"]).collect()}
    want = set()
    for p in range(5):
        cand = []
        for f in (x for x in rows if x[0] == p and x[2] == "a"):
            for c in (x for x in rows if x[0] == p and x[2] == "b"):
                gap = max(c[5] - f[7], f[5] - c[7], 0.0)
                if min(f[6], c[6]) - max(f[4], c[4]) >= 0.3 * min(f[6] - f[4], c[6] - c[4]) and gap <= 30:
                    cand.append((gap, f[1], c[1]))
        used_f, used_c = set(), set()
        for _, f, c in sorted(cand):
            if f not in used_f and c not in used_c:
                used_f.add(f)
                used_c.add(c)
                want.add((p, f, c))
    assert pairs == want


def test_ledger_and_margins(spark):
    chars = spark.createDataFrame([("d", 1, i, c, False) for i, c in enumerate("a bc")], "document_id string, page int, char_id int, text string, invisible boolean")
    owned = spark.createDataFrame([("d", 1, 0), ("d", 1, 2), ("d", 1, 2), ("d", 1, 77)], "document_id string, page int, char_id int")
    assert tuple(P.ledger(chars, owned).first())[2:] == (3, 2, 1, 2)
    lines = spark.createDataFrame([("d", p, 0, f"Report {p}", 0.05) for p in (1, 2, 3)] + [("d", p, 1, str(p), 0.95) for p in (1, 2, 3)] + [("d", 1, 2, "2", 0.96)], "document_id string, page int, line_id int, text string, centre double")
    got = {(r["page"], r["line_id"]) for r in P.repeated_margins(lines, lines.groupBy("document_id").agg(F.max("page").alias("n_pages"))).collect()}
    assert got == {(1, 0), (2, 0), (3, 0), (2, 1), (3, 1)}


def test_store_commits_conflicts_and_feed(spark, tmp_path):
    from folioflow.sources.storage import Store, StoreConflict

    log = "seq bigint, document_id string, version int, previous_version int"
    store = Store(spark, f"file://{tmp_path}/store")
    rows = lambda v, p: spark.createDataFrame([(d, v, p) for d in "abc"], "document_id string, version int, previous_version int")
    assert store.commit({}, rows(1, None), log) == (1, 3)
    assert store.commit({}, rows(2, 1), log) == (4, 6)
    with pytest.raises(StoreConflict):
        store.commit({}, rows(2, 1), log)
    got = store.read("change_log", log).orderBy("seq").collect()
    assert [(r["seq"], r["document_id"], r["version"]) for r in got] == [(1, "a", 1), (2, "b", 1), (3, "c", 1), (4, "a", 2), (5, "b", 2), (6, "c", 2)]
    with pytest.raises(StoreConflict):
        store._create(f"{store.root}/_commits/000000000002.json", {})


def test_stream_equals_batch(spark, tmp_path):
    from folioflow.streaming import feed

    path, schema = f"file://{tmp_path}/in", "document_id string, version bigint"
    spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), ("b", 3)], schema).coalesce(1).write.parquet(path)
    out = []
    feed.run_batches(feed.version_conflicts(feed.read_stream(spark, path, schema)), lambda df, n: out.extend(map(tuple, df.collect())), f"file://{tmp_path}/c1")
    assert out == [("b", 3, 2)]


def test_decode_and_dispatch(spark):
    from folioflow.sources import readers

    rows = [("a.MD", "﻿x\r\ny".encode()), ("b.txt", "한글".encode("cp949")), ("c.md", b"\xff\xff\xff")]
    files = readers.with_identity(spark.createDataFrame(rows, "name string, content binary"))
    assert {r["name"]: r["parser"] for r in readers.dispatch(files).collect()} == {"a.MD": "markdown", "b.txt": None, "c.md": "markdown"}
    texts, rejects = readers.decoded(files)
    assert {r["name"]: r["text"] for r in texts.collect()} == {"a.MD": "x\ny", "b.txt": "한글"}
    assert [r["name"] for r in rejects.collect()] == ["c.md"]
    assert X.LIST_MARKER


def test_markdown_query_reads_every_turn(spark, tmp_path):
    from folioflow.plans.queries import QUERIES

    texts = ["plain words", "# Title 1\n\nSome *text* with 3 digits.\n\n- a\n- b", "```py\nx = 1\n", "| a | b |\n| --- | --- |\n| 1 | 2 |", "[link](http://x.y)  two  blanks ", "", None]
    rows = [(i // 3, i % 3, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r)[:6] for r in QUERIES["markdown_blocks_all"](spark, str(tmp_path)).collect()]
    want = [(c, n, i, b["kind"], b["text"], b["level"]) for c, n, _, t in rows for i, b in enumerate(M.scan(t or ""))]
    assert sorted(got, key=lambda r: r[:3]) == want and {r[3] for r in got} >= {"heading", "list_item", "table", "paragraph"}


def test_box_queries_keep_repeated_line_keys(spark, tmp_path):
    from folioflow.plans import queries as Q

    r = random.Random(3)
    rows = [(k, n, r.randrange(200), r.randrange(100), float(r.randrange(1, 50)), r.randrange(11) / 100, r.choice("ANR")) for k in range(60) for n in (1, 1, 2, 3, 3)]
    rows += rows[:4]  # equal in all columns
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    box = lambda x: (x[2] * 37 % 400, x[3] * 91 % 600, x[2] * 37 % 400 + 60 + x[4] * 4, x[3] * 91 % 600 + 40 + x[4] * 4)
    want = []
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[0] // 25 == b[0] // 25:
                p, q = box(a), box(b)
                both = max(min(p[2], q[2]) - max(p[0], q[0]), 0) * max(min(p[3], q[3]) - max(p[1], q[1]), 0)
                area = (p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - both
                if both / area >= 0.3:
                    want.append((a[0] // 25, round(both / area, 6)))
    got = Q.QUERIES["box_iou_all"](spark, str(tmp_path)).collect()
    assert [x[0] for x in sorted((x["page"], x["iou"]) for x in got)] == [x[0] for x in sorted(want)]
    assert sorted(x["iou"] for x in got) == pytest.approx(sorted(x[1] for x in want)) and len({(x["page"], x["a"], x["b"]) for x in got}) == len(want)
    order = Q.QUERIES["reading_order_all"](spark, str(tmp_path)).collect()
    assert len(order) == len({(x["page"], x["seq"]) for x in order}) == len(rows)
    for name in ("connected_components", "nms_greedy", "caption_pairs", "confirmed_tables", "inner_boxes", "photo_hosts", "table_titles", "ocr_paragraphs"):
        Q.QUERIES[f"{name}_all"](spark, str(tmp_path)).count()


def test_the_unfiltered_listing_holds_every_document(spark, tmp_path):
    from folioflow.plans.queries import QUERIES

    rows = [(u, e, ("click", "view", "buy")[(u + e) % 3]) for u in range(0, 500, 7) for e in range(u, u + 3)]
    spark.createDataFrame(rows, "user_id bigint, event_id bigint, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["document_id"]: (r["version"], r["layer_state"]) for r in QUERIES["documents_listing_all"](spark, str(tmp_path)).collect()}
    assert got == {u: (e, t) for u, e, t in sorted(rows)}


def test_budget_takes_a_later_smaller_asset_of_the_same_key(spark):
    r = random.Random(7)
    rows = [("g", 0, "a", 90), ("g", 1, "a", 40), ("g", 2, "b", 30), ("g", 3, "a", 5), ("n", 0, None, 5), ("n", 1, "x", None)]
    rows += [(f"r{k}", i, r.choice("abcdef"), r.randint(1, 60)) for k in range(30) for i in range(40)]
    expected = {}
    for key, _, asset, size in rows:
        spent, taken = expected.setdefault(key, (0, []))
        if asset is not None and size is not None and asset not in taken and spent + size <= 80:
            expected[key] = (spent + size, [*taken, asset])
    items = spark.createDataFrame(rows, "k string, o int, asset string, size int")
    got = {x["k"]: (x["spent"], x["assets"], x["taken"]) for x in V.asset_budget(items, "k", "o", "asset", "size", 80).collect()}
    assert got == {k: (s, len(t), ",".join(sorted(t))) for k, (s, t) in expected.items()}
