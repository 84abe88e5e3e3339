"""Empty tables, nulls everywhere, clashing columns, giant texts and ties for all ten operators; models against plain code."""

import itertools
import math
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.llm import common as C

DOCS = "doc_id bigint, text string"
CLASH = ["component", "rep", "node", "value", "comp", "n", "sketch", "row", "salt", "bucket", "h", "w", "at", "section", "shard", "label", "score", "host", "path", "evidence", "keep_id", "text_sha256", "first", "held_out", "kind", "item_id", "predicted", "url", "n_chars", "_gone_id"]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id bigint, quality int, toxic int")


def operators(spark, labels):
    from folioflow.llm import decontaminate, exact, html_crf, licenses, minhash, packing, pst, quality, token_counts, toxicity

    bench = spark.createDataFrame([(1, "what is the name of the river that runs by here? it is the long river of the north")], "item_id bigint, text string")
    return {
        1: lambda d: minhash.NearDuplicates().classes(d),
        2: lambda d: token_counts.section_token_counts(d),
        3: lambda d: pst.LanguageModelScores(order=3).scores(d),
        4: lambda d: decontaminate.contaminated(d, bench),
        5: lambda d: exact.exact_duplicates(d),
        6: lambda d: licenses.license_matches(d),
        7: lambda d: toxicity.score_texts(d, toxicity.train(d, labels)),
        8: lambda d: html_crf.extract(d.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").drop("url").withColumn("url", F.lit("u"))),
        9: lambda d: packing.pack(d),
        10: lambda d: quality.site_quality(d, quality.train(d, labels, F.lit(True)), F.lit("h"), F.lit("p")),
    }


@pytest.mark.parametrize("n", range(1, 11))
def test_empty_tables_nulls_and_clashing_columns(spark, labels, n):
    run = operators(spark, labels)[n]
    empty = spark.createDataFrame([], DOCS)
    assert run(empty).count() == 0
    rows = [(None, None), (None, "a b c d e f"), (1, None), (1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (4, "x")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    plain = run(docs)
    key = lambda df: sorted(map(repr, df.select(*[c for c in df.columns if c not in ("sequence_id", "ids")]).collect()))
    clash = docs
    for c in CLASH:
        clash = clash.withColumn(c, F.lit(7))
    assert key(run(clash)) == key(plain)
    if n not in (4, 6):  # those report only matches
        assert plain.count() >= len(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 9, 10])
def test_giant_texts(spark, labels, n):
    """A text of several slices, one giant word, one giant run of blanks, repeated lines."""
    run = operators(spark, labels)[n]
    words = " ".join(f"w{i % 997}" for i in range(500_000))
    rows = [(1, words), (2, "y" * 1_500_000), (3, "a" + " " * 1_500_000 + "b"), (4, "line of text\n" * 120_000), (5, words)]
    out = run(spark.createDataFrame(rows, DOCS).repartition(2))
    got = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    if n in (4, 6):
        assert not got
    elif n == 2:
        assert got[1] == got[2] == got[3] == 1 and got[4] == 120_000
    elif n != 9:
        assert got == Counter({i: 1 for i in range(1, 6)})
    if n == 9:
        sizes = {r["doc_id"]: (r["a"], r["b"]) for r in out.groupBy("doc_id").agg(F.sum("length").alias("a"), F.max("doc_tokens").alias("b")).collect()}
        assert len(sizes) == 5 and all(a == b for a, b in sizes.values())
    if n == 1:
        assert {r["doc_id"]: r["component_id"] for r in out.collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_deep_and_long_pages_cost_in_proportion():
    from folioflow.llm.html_crf import blocks, main_text, trained

    model, took = trained(), []
    for n in (4_000, 16_000):
        page = "<html><body>" + "".join(f'<div class="w{i} content">text {i} here' for i in range(n)) + "</p></li></td>" * n
        began = time.process_time()
        main_text(page, model)
        took.append(time.process_time() - began)
        assert len(blocks(page)) == n
    assert took[1] < 12 * took[0] + 0.5


# --- 1 ------------------------------------------------------------------------------------


def test_a_large_group_around_a_common_passage(spark):
    """3,000 near copies and 1,500 texts that share only a passage: components equal those of all pairs of sets."""
    from folioflow.llm.minhash import NearDuplicates, shingle_sets

    r = np.random.default_rng(17)
    words = np.array([f"v{i}" for i in range(5000)])
    base, passage = r.choice(words, 40), " ".join(r.choice(words, 25))
    rows = []
    for i in range(3000):
        w = base.copy()
        w[r.choice(40, int(r.integers(0, 3)), replace=False)] = r.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(3000 + i, passage + " " + " ".join(r.choice(words, 12))) for i in range(1500)]
    got = {x["doc_id"]: x["component_id"] for x in NearDuplicates().classes(spark.createDataFrame(rows, DOCS).repartition(4)).collect()}
    sets = shingle_sets(*C.utf8(pa.array([t for _, t in rows])), 5)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    one = np.zeros((len(sets), len(values)), np.float32)
    one[np.repeat(np.arange(len(sets)), size), column] = 1
    both = one @ one.T
    near = 100 * both >= 80 * (size[:, None] + size[None] - both)
    label = np.arange(len(sets))
    while True:
        new = np.where(near, label[None], len(sets)).min(1)
        if (new == label).all():
            break
        label = new
    assert [got[i] for i in range(len(rows))] == label.tolist()


# --- 3 ------------------------------------------------------------------------------------


def test_the_tree_equals_a_plain_one():
    """Counts, divergence test, smoothing and longest kept suffix in plain dictionaries."""
    from folioflow.llm.pst import SuffixTree, grams, levels_of, symbols

    r = np.random.default_rng(5)
    texts = [" ".join(r.choice(["ab", "abc", "cab", "bca", "aab"], int(r.integers(1, 12)))) for _ in range(60)]
    order, least = 3, 2
    stream, _, _, _ = symbols(*C.utf8(pa.array(texts)))
    keys, n = np.unique(grams(stream, order), return_counts=True)
    tree = SuffixTree(levels_of(keys, n.astype(np.int64), 0, order, least))
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in texts:
        s = "\n" + t + "\n"
        for i in range(1, len(s)):
            for d in range(order + 1):
                counts[d][s[max(0, i - d) : i]][s[i]] += 1 if i - d >= 0 or d == 0 else 0
                if i - d <= 0:  # nothing precedes the start: longer contexts are the same one
                    for e in range(d + 1, order + 1):
                        counts[e][s[0:i]][s[i]] += 1
                    break
    keep = [{c: k for c, k in level.items() if sum(k.values()) >= least} for level in counts]

    def p(d, ctx, x):
        if d < 0:
            return 1 / 256
        k = keep[d].get(ctx if len(ctx) <= d else ctx[-d:] if d else "")
        lower = p(d - 1, ctx[1:] if len(ctx) >= d and d else ctx, x)
        return lower if k is None else (k[x] + len(k) * lower) / (sum(k.values()) + len(k))

    kept = set()
    for d in range(order, 0, -1):
        for ctx, k in keep[d].items():
            if len(ctx) < d:
                continue
            total = sum(k.values())
            kl = sum(v * math.log(v / total / p(d - 1, ctx[1:], x)) for x, v in k.items())
            if kl > len(k) * math.log(max(total, 2)) / 2:
                kept |= {ctx[i:] for i in range(len(ctx))}
    probe = "\nabcab abc aabb"
    for i in range(1, len(probe)):
        ctx = next((probe[i - d : i] for d in range(min(order, i), 0, -1) if probe[i - d : i] in kept and "\n" not in probe[i - d + 1 : i]), "")
        key = 0
        past = probe[max(0, i - order) : i][::-1]
        for j, c in enumerate(past, 1):
            key |= ord(c) << (8 * j)
            if c == "\n":
                break
        key |= ord(probe[i])
        if "\n" not in ctx:
            want = p(len(ctx), ctx, probe[i])
            assert tree.log10(np.array([key], np.uint64))[0] == pytest.approx(math.log10(want), rel=1e-6), (i, ctx)


# --- 7 ------------------------------------------------------------------------------------


def test_the_folded_model_is_the_mean_of_its_vectors():
    """Scoring by one number a bucket equals averaging subword vectors and the softmax, passage by passage."""
    from folioflow.llm.toxicity import SubwordSoftmax, ngrams

    model = SubwordSoftmax(buckets=512, dim=4, window=2)
    r = np.random.default_rng(3)
    E, W = r.normal(size=(512, 4)), r.normal(size=(4, 2))
    model.fold, model.bias, model.scale, model.shift = (E @ (W[:, 1] - W[:, 0])).astype(np.float32), 0.3, 1.0, 0.0
    texts = ["one two three", "", "Zwei", "a bb ccc dddd eeeee"]
    raw, at = C.utf8(pa.array(texts))
    want = []
    for t in texts:
        found, vectors = [], []
        for w in t.split():
            one = C.utf8(pa.array([w]))
            h, _, a, b = C.bag(*one)
            sub, _ = ngrams(one[0], a, b, h, model.sizes, 512)
            vectors.append(E[sub].mean(0))
        for k in range(0, len(vectors), 2):
            z = np.mean(vectors[k : k + 2], 0) @ W
            found.append(z[1] - z[0] + 0.3)
        want.append(max(found, default=0.3))
    assert model.logits(raw, at) == pytest.approx(want, rel=1e-5)
    assert model.scores(raw, at) == pytest.approx(1 / (1 + np.exp(-np.array(want))), rel=1e-5)


def test_conflicting_labels_and_long_texts_have_a_rule(spark):
    from folioflow.llm.toxicity import FIT_TEXT, fit_sample

    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "x" * (FIT_TEXT + 1)), (3, None), (4, "w")], DOCS)
    marks = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 0), (3, 0), (4, None), (None, 1)], "doc_id bigint, toxic int")
    one = [sorted(map(tuple, fit_sample(docs.repartition(k), marks.repartition(k), "toxic", F.lit(True)).collect())) for k in (1, 3, 5)]
    first = min((r["h"], r["text"]) for r in docs.where("doc_id = 1").select(F.xxhash64("text").alias("h"), "text").collect())[1]
    assert one[0] == one[1] == one[2] == sorted([(first, 1), ("", 0)])


# --- 10 ------------------------------------------------------------------------------------


def test_posteriors_leave_the_document_out(spark):
    from folioflow.llm.quality import Logistic, features, site_quality

    good, bad = "The quick fox. It runs far, and it sleeps well.", "BUY!!! $$$ ### NOW!!! $$$"
    model = Logistic().fit(features(*C.utf8(pa.array([good, bad] * 40))), np.array([1.0, 0.0] * 40))
    rows = [(i, good if (i * 7) % 10 < 6 else bad, "abc"[i % 3], "pqr"[(i // 3) % 3 if i % 3 else 0]) for i in range(90)] + [(200, good, "z", "only")]
    got = {r["doc_id"]: r for r in site_quality(spark.createDataFrame(rows, DOCS + ", s string, p string"), model, F.col("s"), F.col("p")).collect()}
    c = {i: 1 / (1 + math.exp(-model.logits(features(*C.utf8(pa.array([t]))))[0])) for i, t, *_ in rows}
    by = lambda f: {k: [i for i, *_ in g] for k, g in ((k, list(g)) for k, g in itertools.groupby(sorted(rows, key=f), key=f))}
    hosts, paths = by(lambda r: r[2]), by(lambda r: r[2:])
    mean = sum(c.values()) / len(c)
    strength = lambda var, noise: min(max(mean * (1 - mean) / max(var - noise, 1e-5) - 1, 2.0), 10_000.0)
    rate = {h: sum(c[i] for i in own) / len(own) for h, own in hosts.items()}
    hs = strength(np.var(list(rate.values())), mean * (1 - mean) * np.mean([1 / len(o) for o in hosts.values()]))
    ps = strength(np.mean([(sum(c[i] for i in o) / len(o) - rate[k[0]]) ** 2 for k, o in paths.items()]), mean * (1 - mean) * np.mean([1 / len(o) for o in paths.values()]))
    for i, _, h, p in rows:
        host = (sum(c[j] for j in hosts[h] if j != i) + hs * mean) / (len(hosts[h]) - 1 + hs)
        path = (sum(c[j] for j in paths[h, p] if j != i) + ps * host) / (len(paths[h, p]) - 1 + ps)
        assert (got[i]["host_rate"], got[i]["path_rate"]) == pytest.approx((host, path), rel=1e-6)
    assert got[200]["host_rate"] == pytest.approx(mean) and got[200]["path_rate"] == pytest.approx(mean)
