"""Operators 11 to 13 against brute force: every edit sequence, every line, every pair of words."""

import functools
import hashlib
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import conversations as V
from folioflow.llm import lines as L
from folioflow.llm import variants as S
from folioflow.llm.common import materialize

sys.setrecursionlimit(20_000)
CONVS = "conv_id bigint, turn bigint, role string, text string"
DOCS = "doc_id bigint, text string"
BLANK = " \t\n\x0b\x0c\r"


# --- 11: conversations -----------------------------------------------------------


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


AFTER = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(codes):
    """(cost, audit) by trying every edit of every turn from its end, with up to three inserts before each."""

    @functools.cache
    def best(i, made, room):  # made: the last initial, or none; room: inserts that may follow here
        found = [(10**6, "")]
        if i == len(codes):
            found += [(0, "")] * (made in ("", "a"))
        else:
            initial, fault = codes[i]
            c, a = best(i + 1, made, 3)
            found.append((c + 3, "D" + a))
            for to in AFTER[made] if fault in ("", "t") else "":
                if to == initial or to != "s":
                    c, a = best(i + 1, to, 3)
                    found.append((c + (0 if to == initial else 2) + (fault == "t"), ("K" if to == initial else "R") + a))
        for to in AFTER[made] if room else "":
            if to != "s":
                c, a = best(i, to, room - 1)
                found.append((c + 2, "I" + a))
        return min(found)

    for i in range(len(codes), -1, -50):  # keep the recursion flat
        best(i, "", 3)
    return best(0, "", 3)


def brute_repair(rows, ids):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn is not None, turn or 0, role, text))
    out = {}
    for conv in ids:
        turns = sorted(own[conv])
        codes, seen, n = [], set(), Counter()
        for _, _, role, text in turns:
            bare = text.strip(BLANK)
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            codes.append((role[:1], fault))
        pairs = [codes[i][0] + codes[i + 1][0] for i in range(len(codes) - 1)]
        known = [t for there, t, _, _ in turns if there]
        cost, audit = cheapest(tuple(codes))
        made, at, state = [], 0, ""
        for letter in audit:
            role, text = ("", "") if letter == "I" else turns[at][2:]
            at += letter != "I"
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if state == "u" else "user"
            state = role[0]
            made.append(f"{role}:{text}")
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, n["b"], n["d"], n["t"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def convs():
    r = np.random.default_rng(5)
    roles, texts = ["system", "user", "assistant", "tool", None, ""], ["yes.", "no!", "cut", " \n", "", None, "why? ", "한글."]
    rows = []
    for conv in range(220):
        for turn in range(int(r.integers(1, 9))):
            role = ["user", "assistant"][turn % 2] if r.random() < 0.6 else roles[int(r.integers(6))]
            text = f"{conv} {turn}." if r.random() < 0.5 else texts[int(r.integers(8))]
            rows.append((conv if conv else None, turn if r.random() < 0.9 else None, role, text))
    rows += [(3, 1, "user", "tie b."), (3, 1, "user", "tie a."), (3, 1, "user", "tie a.")]
    rows += [(1000, t, ["user", "assistant"][t % 2], f"long {t % 90}." if t % 7 else "open") for t in range(300)]
    return rows


def test_damage(spark, convs):
    got = V.damaged(spark.createDataFrame(convs, CONVS)).where("there").select("conv_id", "turn", "role", "text").collect()
    assert Counter(map(tuple, got)) == Counter(brute_damage(convs))


@pytest.mark.parametrize("turns", [5, 2048])
def test_repair_against_every_edit(spark, convs, turns):
    """Short batches carry conversations across; both give what trying everything gives."""
    df = spark.createDataFrame(convs, CONVS).withColumn("audit", F.lit(1)).withColumn("cost", F.lit("x"))
    got = {r[0]: tuple(r)[1:] for r in V.repair(V.damaged(df), turns).collect()}
    assert got == brute_repair(brute_damage(convs), {c[0] for c in convs})


def test_repair_edges(spark):
    empty = spark.createDataFrame([], CONVS)
    assert V.repair(V.damaged(empty)).count() == 0
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    none = V.repair(V.damaged(spark.createDataFrame([(dropped, 1, "user", "a.")], CONVS))).first()
    assert tuple(none) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    giant = "x" * 3_000_000 + "."
    rows = [(7, 0, "user", giant, True), (7, 1, "assistant", giant, True)]
    row = V.repair(spark.createDataFrame(rows, CONVS + ", there boolean")).first()
    assert (row["audit"], row["cost"]) == ("KK", 0) and row["repaired_sha256"] == hashlib.sha256(f"user:{giant}\nassistant:{giant}".encode()).hexdigest()


def test_repaired_turns_hash_to_the_report(spark, convs):
    rows = materialize(V.damaged(spark.createDataFrame(convs, CONVS)), "damaged")
    want = {r["conv_id"]: r["repaired_sha256"] for r in V.repair(rows).collect()}
    made = defaultdict(dict)
    for r in V.repair(rows, turns=7, with_turns=True).collect():
        assert r["position"] not in made[r["conv_id"]]
        made[r["conv_id"]][r["position"]] = f"{r['role']}:{r['text']}"
    assert {c: hashlib.sha256("\n".join(made[c][k] for k in range(len(made[c]))).encode()).hexdigest() for c in want} == want


# --- 12: lines --------------------------------------------------------------------


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(BLANK))


def brute_lines(rows):
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, text in rows:
        for k in map(key, (text or "").split("\n")):
            if len(k) >= 10 and (k not in first or order(d) < order(first[k])):
                first[k] = d
    out = []
    for d, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if len(key(x)) < 10 or first[key(x)] == d]
        out.append((d, len(own), len(own) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.fixture(scope="module")
def paged():
    r = np.random.default_rng(6)
    pool = [f"a line that many pages share {i}" for i in range(40)] + ["short", "", "Été à la PLAGE ÉTÉ", "  été à la plage été\t", "ÉTÉ à la plage été", "exactly 10", "only nine", "Ⅷ roman letters Ⅷ", "ⅷ roman letters ⅷ"]
    rows = [(int(i), "\n".join(str(x) for x in r.choice(pool, int(r.integers(1, 30)))) + ("\n" if i % 3 == 0 else "")) for i in r.permutation(120)]
    common = "the one line that every page holds"
    rows = [(i, common + "\n" + t + "\n" + common if i % 2 else t) for i, t in rows]
    rows += [(5, rows[0][1]), (5, rows[1][1]), (5, None), (None, rows[2][1]), (None, rows[3][1]), (None, None), (300, ""), (301, "\n"), (302, "\n".join(f"line number {i // 2} of a long page" for i in range(9000))), (303, "\n".join(f"line number {i} of a long page" for i in range(4600)))]
    rows += [rows[4], rows[4]]
    return rows


@pytest.mark.parametrize("heavy", [1, 1024])
def test_lines_against_brute_force(spark, paged, heavy):
    docs = spark.createDataFrame(paged, DOCS).repartition(5).withColumn("at", F.lit(1)).withColumn("words", F.lit(2)).withColumn("mark", F.lit(3)).withColumn("first_doc", F.lit(3))
    got = L.with_kept_lines(docs, L.keep_bitmaps(docs, heavy=heavy))
    assert Counter(tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()) == brute_lines(paged)


def test_lines_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert L.with_kept_lines(empty, L.keep_bitmaps(empty)).count() == 0
    blanks = " " * 300_000 + "a line behind blanks" + " " * 300_000
    rows = [(1, blanks), (2, "a line behind blanks\n" + "y" * 2_000_000)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["kept_text"] for r in L.with_kept_lines(docs, L.keep_bitmaps(docs)).collect()}
    assert got == {1: blanks, 2: "y" * 2_000_000}


def test_lowering_touches_only_ascii(spark):
    codes = spark.range(1, 0x110000).where("id < 55296 OR id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    assert codes.where(L.lowered(F.col("c")) != F.translate("c", L.UPPER, L.LOWER)).isEmpty()


def test_bitmaps_leave_full_words_out(spark, paged):
    for r in L.keep_bitmaps(spark.createDataFrame(paged, DOCS)).collect():
        assert r["words"] == sorted(r["words"]) and all(w["bits"] for w in r["words"])
        assert sum((w["bits"] & (2**64 - 1)).bit_count() for w in r["words"]) == r["n_dropped"]


def test_range_partitioning_needs_no_other_exchange(spark, paged):
    rows = materialize(L.line_hashes(spark.createDataFrame(paged, DOCS), "doc_id", "text", 10), "h")
    plan = L.dropped_lines(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan and "Python" not in plan


# --- 13: words --------------------------------------------------------------------


def brute_words(rows):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :]


def brute_variants(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return out


@pytest.fixture(scope="module")
def spelled():
    r = np.random.default_rng(8)
    letters = list("abcdeéÀÿ×")
    words = ["".join(r.choice(letters, int(r.integers(6, 10)))) for _ in range(60)]
    for w in words[:40]:
        for _ in range(3):
            i, c = int(r.integers(len(w))), str(r.choice(letters))
            words += [w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :]]
    weights = 1 / np.arange(1, len(words) + 1) ** 0.8
    rows = [(int(i), " ".join(str(w) if r.random() < 0.9 else str(w).upper() for w in r.choice(words, 120, p=weights / weights.sum()))) for i in range(150)]
    rows += [(None, rows[0][1]), (3, None), (4, ""), (5, "a-b_c1déjàvu"), (6, "déjàvus한글déjàvus") , rows[7], rows[7], (9, "z" * 100_000), (10, "Ā" * 9)]
    rows += [(20 + i, "zzzzzz " + "z" * 100_000) for i in range(6)]
    return rows


def test_words_against_brute_force(spark, spelled):
    docs = spark.createDataFrame(spelled, DOCS).repartition(3).withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    want = brute_words(spelled)
    words = materialize(S.word_counts(docs), "w")
    assert {r["word"]: r["n"] for r in words.collect()} == want
    assert {tuple(r) for r in S.spelling_variants(words).collect()} == brute_variants(want)


def test_variants_chain_and_tie(spark):
    n = {"aaaaaa": 1000, "aaaaab": 200, "aaaabb": 40, "aaabbb": 8, "bbbbbb": 50, "bbbbba": 50, "bbbbab": 10}
    df = spark.createDataFrame(list(n.items()), "word string, n bigint")
    got = {tuple(r) for r in S.spelling_variants(df).collect()}
    assert got == brute_variants(n) and ("aaabbb", "aaaabb", "aaaaaa", 8, 1, 40) in got
    assert S.spelling_variants(df.limit(0)).count() == 0


def test_empty_tables_of_words(spark):
    assert S.spelling_variants(S.word_counts(spark.createDataFrame([], DOCS))).count() == 0


def test_long_runs_share_the_checksum(spark):
    raw = np.frombuffer(("é" * 50 + "abc" + "q" * 300).encode(), np.uint8)
    a, b = np.array([0, 100, 103, 0]), np.array([100, 103, 403, 3])
    state = np.array([zlib.crc32(b"7:")] * 4, np.uint32)
    assert S._crc32(state, raw, a, b).tolist() == [zlib.crc32(b"7:" + raw[x:y].tobytes()) for x, y in zip(a, b)]
