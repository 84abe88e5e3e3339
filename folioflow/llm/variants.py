"""Spelling variants: letter-parity masks in three bands find the pairs, exact edit distance confirms them.

A word's mask holds, for each letter, whether it occurs an odd number of
times.  Inserting or deleting a code point flips one bit, replacing one flips
at most two, so of three bands of bits at least one is equal in both words.
Any single edit also leaves either the first three or the last three code
points of both words as they are; a word is filed under its bands with either,
so common bands fall apart into small ones and no pair is lost.  Pairs of
equal files whose lengths differ by at most one and whose masks by at most two
bits are verified.  A word of length L over an alphabet of A has fewer than
2 * A * (L + 1) near words, so no group grows with the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm import common as C
from folioflow.llm.common import drop_materialized, materialize

_ASCII = np.zeros(256, bool)
_ASCII[0x41:0x5B] = _ASCII[0x61:0x7B] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)
#: Code points and occurrences from which a word counts; how much commoner a form is; one run in so many is damaged.
LENGTH, LEAST, RATIO, DAMAGE = 6, 5, 5, 199
#: Bits of a mask.
BITS = 63
#: Every third bit, so that each band holds common letters.
BANDS = [sum(1 << b for b in range(k, BITS, 3)) for k in range(3)]


def _runs(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and byte after of the maximal runs of letters; U+00C0..00FF are 0xC3 and the byte after it."""
    inside = _ASCII[raw] | (raw == 0xC3)
    inside[1:] |= raw[:-1] == 0xC3
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(at, a, "right") - 1, a, b


def _crc32(state: np.ndarray, raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """crc32 of bytes a..b each, going on from the crc32 ``state`` of what comes before."""
    out = state.astype(np.uint32)
    size = b - a
    for i in np.flatnonzero(size > 64):
        out[i] = zlib.crc32(raw[a[i] : b[i]].tobytes(), int(out[i]))
    short = np.flatnonzero(size <= 64)
    short = short[np.argsort(-size[short], kind="stable")]
    live, start, left = ~out[short], a[short], size[short]
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, "left"))  # those longer than k come first
        live[:n] = _CRC[(live[:n] ^ raw[start[:n] + k]) & 0xFF] ^ (live[:n] >> 8)
    out[short] = ~live
    return out


def _strings(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """The byte ranges as strings."""
    ends = np.concatenate([[0], np.cumsum(b - a)])
    data = raw[np.arange(ends[-1]) + np.repeat(a - ends[:-1], b - a)]
    return pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def _counted(ids: list, raw: np.ndarray, at: np.ndarray, length: int, damage: int | None) -> pa.RecordBatch:
    """word, n of a slice of texts."""
    row, a, b = _runs(raw, at)
    raw = C.LOWER[raw]
    more = np.concatenate([[0], np.cumsum(raw == 0xC3)])
    long = (b - a) - (more[b] - more[a]) >= length
    row, a, b = row[long], a[long], b[long]
    up, down = C.powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(C.BYTE_CODE[raw] * up[: len(raw)], out=total[1:])
    h = C.mix((total[b] - total[a]) * down[a])
    words, counts = [], []
    whole = np.ones(len(h), bool)
    if damage is not None:
        # a run and a document once: all of its occurrences there share one crc
        _, one, back = np.unique(h ^ C.mix(row.astype(np.uint64)), return_index=True, return_inverse=True)
        state = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
        crc = _crc32(state[row[one]], raw, a[one], b[one])
        hit = crc % damage == 0
        whole = ~hit[back]
        times = np.bincount(back, minlength=len(one))
        for i in np.flatnonzero(hit):
            word = raw[a[one[i]] : b[one[i]]].tobytes().decode()
            cut = int(crc[i]) % len(word)
            words.append(word[:cut] + word[cut + 1 :])
            counts.append(int(times[i]))
    _, one, n = np.unique(h[whole], return_index=True, return_counts=True)
    one = np.flatnonzero(whole)[one]
    texts = pa.concat_arrays([_strings(raw, a[one], b[one]), pa.array(words, pa.large_string())]).cast(pa.string())
    return pa.RecordBatch.from_arrays([texts, pa.array(np.concatenate([n, np.array(counts, np.int64)]), pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, least: int = LEAST, damage: int | None = DAMAGE) -> DataFrame:
    """word, n: maximal runs of letters, A-Z lowered, of at least ``length`` code points seen at least ``least`` times.

    Where ``damage`` divides the crc32 h of ``<doc_id>:<run>``, the run loses
    its code point h % length first (a null id reads as nothing).  Null and
    empty texts have no runs; a text counts whole, however long; repeated rows
    count each; other columns are ignored.  Runs are counted a slice of texts
    at a time before the shuffle, so common words travel as sums.
    """

    def run(batches):
        for batch in batches:
            for rows, raw, at in C.slices(batch, "text"):
                made = _counted(rows.column("doc_id").to_pylist(), raw, at, length, damage)
                if len(made):
                    yield made

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    found = rows.mapInArrow(run, "word string, n bigint").where(F.char_length("word") >= length)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def parity_mask(word: Column) -> Column:
    """Bit b is set where letters of bit b occur an odd number of times; a-z have bits of their own, the others share the rest."""
    code = lambda c: F.ascii(c) - 97
    bit = lambda c: F.when(code(c).between(0, 25), code(c)).otherwise(26 + F.pmod(F.ascii(c), F.lit(BITS - 26)))
    one = lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(c)))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), one)


def near_pairs(words: DataFrame, shortest: int = LENGTH) -> DataFrame:
    """a, b, a_n, b_n of the distinct ``words`` (word, n): every unordered pair one edit apart once.

    ``shortest`` is the length of the shortest word; half of it is what one
    end of a word keeps under any edit.
    """
    keep = shortest // 2
    filed = words.select("word", "n", F.char_length("word").alias("len"), parity_mask(F.col("word")).alias("mask"))
    ends = [F.substring("word", 1, keep), F.substring("word", -keep, keep)]
    slots = [F.struct(F.lit(3 * e + k).alias("slot"), F.col("mask").bitwiseAND(F.lit(band)).alias("band"), end.alias("end")) for e, end in enumerate(ends) for k, band in enumerate(BANDS)]
    filed = filed.select("*", F.inline(F.array(*slots)))
    left, right = (filed.select("slot", "band", "end", *[F.col(c).alias(f"{p}_{c}") for c in ("word", "n", "len", "mask")]) for p in "ab")
    met = left.join(right, ["slot", "band", "end"])
    flips = F.col("a_mask").bitwiseXOR(F.col("b_mask"))
    longer = (F.col("b_len") == F.col("a_len") + 1) | ((F.col("a_len") == F.col("b_len")) & (F.col("a_word") < F.col("b_word")))
    # of the files in which a pair meets, the first counts
    head = F.substring("a_word", 1, keep) == F.substring("b_word", 1, keep)
    same = [flips.bitwiseAND(F.lit(band)) == 0 for band in BANDS]
    band = F.when(same[0], 0).when(same[1], 1).otherwise(2)
    first = F.col("slot") == F.when(head, band).otherwise(band + 3)
    close = met.where(longer & (F.bit_count(flips) <= 2) & first)
    return close.where(F.levenshtein("a_word", "b_word", 1) == 1).select(F.col("a_word").alias("a"), F.col("b_word").alias("b"), "a_n", "b_n")


def roots_of(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms (word, form), by doubling pointers; chains have no cycle.

    A form is ``RATIO`` times commoner than its word, so a chain over n
    occurrences has at most log5(n) steps and few rounds reach its end.
    """
    to = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        hop = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialize(to.join(hop, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if new.where("moved").isEmpty():
            drop_materialized(to)
            return new.drop("moved")
        drop_materialized(to)
        to = new.drop("moved")


def spelling_variants(words: DataFrame, ratio: int = RATIO, shortest: int = LENGTH) -> DataFrame:
    """word, form, root, n, n_near, form_n of the distinct ``words`` (word, n).

    Near words differ by exactly one inserted, deleted or replaced code
    point.  A word's form is its near word of largest n (ties: the smallest in
    code-point order) if that n is at least ``ratio`` times its own; root
    follows forms to the last.  No near words: n_near 0 and the word as its own
    root.  No word may be shorter than ``shortest`` code points; an empty
    table gives an empty result, other columns are ignored.
    """
    words = materialize(words.select("word", "n"), "words")
    pairs = near_pairs(words, shortest)
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    found = both.groupBy("word").agg(F.count("*").alias("n_near"), best)
    found = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best")).alias("best"))
    found = materialize(found.select("word", F.col("best.near").alias("form"), "n", "n_near", (-F.col("best.m")).alias("form_n")), "variants")
    roots = roots_of(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle_sql() -> str:
    """The same result in DuckDB's SQL; near words meet in what is left of them without one code point."""
    from folioflow.llm.conversations import crc32_of, crc32_sql

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH RECURSIVE {crc32_sql()},
    r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{upper}', '{lower}') AS w FROM documents),
    u AS (SELECT doc_id, w, count(*) AS n FROM r WHERE length(w) >= {LENGTH} GROUP BY doc_id, w),
    h AS (SELECT w, n, {crc32_of("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)")} AS h FROM u, crc_table),
    g AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
    c AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM g WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(n) >= {LEAST}),
    d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM c)),
    p AS (
        SELECT a.word AS a, b.word AS b, a.n AS an, b.n AS bn FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word < b.word
        UNION SELECT d.word, c.word, d.n, c.n FROM d JOIN c ON d.rest = c.word),
    e AS (SELECT a AS word, b AS near, bn AS m FROM p UNION SELECT b, a, an FROM p),
    o AS (SELECT word, count(*) AS n_near, min({{'m': -m, 'near': near}}) AS best FROM e GROUP BY word),
    f AS (SELECT c.word, c.n, coalesce(o.n_near, 0) AS n_near, CASE WHEN -o.best.m >= {RATIO} * c.n THEN o.best.near END AS form, CASE WHEN -o.best.m >= {RATIO} * c.n THEN -o.best.m END AS form_n FROM c LEFT JOIN o USING (word)),
    s(word, last) AS (SELECT word, word FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON s.last = f.word WHERE f.form IS NOT NULL),
    z AS (SELECT s.word, s.last FROM s JOIN f ON s.last = f.word WHERE f.form IS NULL)
    SELECT f.word, form, z.last AS root, n, n_near, form_n FROM f JOIN z ON f.word = z.word"""
