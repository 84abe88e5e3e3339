"""The pipeline on null ids, repeated rows, clashing columns and empty tables; ties of benchmark passages and license windows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import common as C

WORDS = [f"w{i}" for i in range(400)]
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, component string, kept int, text_sha256 string, score string"


def clean(r, n=60):
    return " ".join(str(w) for w in r.choice(WORDS, n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents of all odd kinds beside toxic ones; columns that clash with the operators' own."""
    path, r = tmp_path_factory.mktemp("tables"), np.random.default_rng(31)
    a, b, c = clean(r), clean(r), clean(r)
    rows = [(1, a), (1, a), (1, b), (2, a.replace(" ", "\n", 2)), (None, b), (None, b), (None, c), (3, None), (4, ""), (5, " \n"), (None, None)]
    rows += [(100 + k, clean(r)) for k in range(30)]
    toxic = [(3000 + k, clean(r, 6) + " horrible " + clean(r, 6)) for k in range(60)]
    more = ("en", "s", 0, "x", 7, "y", "z")
    spark.createDataFrame([(*x, *more) for x in rows + toxic], COLUMNS).repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 3000)) for i, _ in rows + toxic if i is not None], "doc_id bigint, quality int, toxic int").distinct().write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, clean(r, 20))], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows


def test_stages_on_odd_rows(spark, folder):
    import corpus_pipeline as P

    path, rows = folder
    docs, after = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in P.STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, path), name)
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        after[name] = Counter((r["doc_id"], r["text"]) for r in docs.collect())
        assert docs.where("component <> 'x' OR kept <> 7 OR text_sha256 <> 'y' OR score <> 'z'").isEmpty()
    own = Counter(rows)
    assert Counter({k: n for k, n in after["toxicity"].items() if (k[0] or 0) < 3000}) == own  # clean rows stay, repeated ones too
    a, b, c = rows[0][1], rows[2][1], rows[6][1]
    exact = Counter({k: n for k, n in after["exact_dedup"].items() if (k[0] or 0) < 3000})
    odd = {k: n for k, n in exact.items() if k[0] is None or k[0] < 100}
    # one row of each text: the smallest id's, ids before none; null, empty and blank are two texts
    assert sum(odd.values()) == 5 and odd[1, a] == 1 and odd[1, b] == 1 and odd[None, c] == 1
    assert sum(n for (i, t), n in odd.items() if not (t or "")) == 1 and odd[5, " \n"] == 1
    assert after["near_dedup"] == after["exact_dedup"] and after["decontamination"] == after["near_dedup"]
    packed = P.run(spark, path)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {i for i, _ in after["decontamination"]}


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    for name, schema in (("documents", COLUMNS), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_license_windows_that_tie(spark):
    """The first of equally good windows counts, also in a text much longer than the longest template."""
    from folioflow.llm import licenses as L

    r = np.random.default_rng(3)
    notice = L.TEMPLATES["gpl-3.0-notice"]
    text = clean(r, 3000) + " " + notice + " " + clean(r, 4000) + " " + notice + " " + clean(r, 10)
    got = L.license_matches(spark.createDataFrame([(1, text), (2, notice), (2, notice)], "doc_id bigint, text string")).where("template = 'gpl-3.0-notice'").collect()
    assert sorted((x["doc_id"], x["containment"], x["first_word"]) for x in got) == [(1, 1.0, 3000), (2, 1.0, 0)]
