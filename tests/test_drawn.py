"""Pages read where they lie give what the same pages give as rows of glyphs."""

import numpy as np
from pyspark.sql import functions as F

from folioflow.operators import document as D
from folioflow.operators import flow as FL
from folioflow.operators import ruled as R
from folioflow.operators import tables as TB
from folioflow.plans.services import _read_customer

SIDES = ("x0", "y0", "x1", "y1")


def reader():
    def read(row):
        """A customer's page; every third one is turned by a quarter and half hidden."""
        drawn = _read_customer(row)
        if row["document_id"] % 3 == 0:
            chars = drawn["chars"]
            n = len(chars["char_id"])
            chars |= {"along": np.ones(n, np.int64), "down": np.full(n, 2), "invisible": np.arange(n) % 2 == 0}
        return drawn

    return read  # workers do not import tests


def as_rows(spark, rows):
    chars, rules, images, regions, pages = [], [], [], [], []
    for row in rows:
        key, d = (row["document_id"], row["page"]), reader()(row)
        pages.append((*key, d["width_pt"], d["height_pt"]))
        g, r = d["chars"], d["rules"]
        names = ("char_id", "text", *SIDES, "baseline", "size", "bold", "invisible", "unmapped", "along", "down")
        chars += [(*key, *v) for v in zip(*(g[c].tolist() for c in names))]
        rules += [(*key, *v) for v in zip(*(r[c].tolist() for c in ("axis", "pos", "start", "end", "fill")))]
        images += [(*key, *b) for b in d["images"].tolist()]
        regions += [(*key, c, s, *b) for c, s, b in zip(d["regions"][0].tolist(), d["regions"][1].tolist(), d["regions"][2].tolist())]
    key, box = "document_id bigint, page int, ", "x0 double, y0 double, x1 double, y1 double"
    make = lambda rows, schema: spark.createDataFrame(rows, key + schema)
    return {
        "pages": make(pages, "width_pt double, height_pt double"),
        "chars": make(chars, f"char_id bigint, text string, {box}, baseline double, size double, bold boolean, invisible boolean, unmapped boolean, along int, down int"),
        "rules": make(rules, "axis string, pos double, start double, `end` double, fill boolean"), "images": make(images, box), "regions": make(regions, f"cls string, score double, {box}"),
    }


def test_pages_where_they_lie_equal_pages_as_rows(spark):
    rows = [{"document_id": k, "page": p, "c_name": f"Customer {k} {p}"} for k in (1, 2, 3) for p in (1, 2)]
    lying = D.read_drawn(spark.createDataFrame([tuple(r.values()) for r in rows], "document_id bigint, page int, c_name string"), reader())
    flat = D.read_pages(**as_rows(spark, rows))
    for name in ("pages", "blocks", "cells", "plan", "notes", "ledger"):
        a, b = (sorted(str(r) for r in getattr(x, name).select(*sorted(getattr(x, name).columns)).collect()) for x in (lying, flat))
        assert a == b and a, name
    ledger = {(r["document_id"], r["page"]): (r["layer_chars"], r["in_blocks"], r["doubled"]) for r in lying.ledger.collect()}
    assert len(ledger) == 6 and all(a == b and d == 0 for a, b, d in ledger.values())
    assert {r["text_layer"] for r in lying.pages.where("document_id = 3").collect()} == {"scanned"}
    texts = TB.plain_text(lying.cells.select(F.struct("document_id", "page", "table_no").alias("table_id"), "n_rows", "n_cols", "row", "col", "rowspan", "colspan", "text"))
    held = lying.blocks.where("kind = 'table'").select(F.struct("document_id", "page", "table_no").alias("table_id"), "text")
    assert {str(r[0]): r[1] for r in texts.collect()} == {str(r[0]): r[1] for r in held.collect()} and held.count() == 8


def test_turned_arrays_equal_turned_columns(spark):
    rows = [(a, d, 10.0 * a + 1, 20.0 + d, 10.0 * a + 5, 29.0 + d) for a in range(4) for d in range(4) if a % 2 != d % 2]
    want = FL.reading(spark.createDataFrame(rows, "along int, down int, x0 double, y0 double, x1 double, y1 double").withColumns({"width_pt": F.lit(600.0), "height_pt": F.lit(800.0)})).collect()
    g = dict(zip(("along", "down", *SIDES), map(np.array, zip(*rows))))
    got = FL.turned(g, 600.0, 800.0)
    assert [tuple(r[c] for c in SIDES) for r in want] == list(zip(*(got[c].tolist() for c in SIDES)))


def test_running_most_restarts_with_the_code():
    r = np.random.default_rng(5)
    code, values = np.sort(r.integers(0, 9, 200)), r.normal(size=200)
    want = [values[code == c][: k + 1].max() for c in np.unique(code) for k in range((code == c).sum())]
    assert R._running_most(values, code).tolist() == want
