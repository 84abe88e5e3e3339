"""Benchmark decontamination: BM25 over an index of test items, block-max WAND, exact overlap.

Words are runs of letters, digits and non-ASCII characters in lower case.
Every document is read in passages of twice the longest item's words that
overlap by half, so any run of an item's length lies whole in one passage.
Each passage is a query.  Indexed are the items and, as entries of their own,
their questions (all but the last sentence or line) and answers of at least
``PART_WORDS`` words.  Scores are divided by the entry's score for itself, so
one threshold fits all; it is lower for entries whose rarest words weigh so
much that a passage could lack them and still hold ``overlap`` of the shingles.

1. Passages without a run of words of any entry verify nothing and are left out.
2. The other passages run block-max WAND over the postings and retrieve all
   items above the threshold, not a top few.
3. An item counts when at least ``overlap`` of its five-word shingles, or of
   those of its question or answer of ``PART_WORDS`` words, are in the passage.

The index is small and bounded: items are taken in shards of about
``SHARD_BYTES`` of text, and each shard is one pass over the documents.
Document frequencies, the number of items and their mean length are those of
all items whatever the shards.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import bag, batch_of, materialize, shingles, short_runs, slices, utf8

SHARD_BYTES = 8 << 20
BLOCK = 64
#: Words that a question or an answer has at least to count without the rest of its item.
PART_WORDS = 8
K1, B = 1.2, 0.75


def _split(text: str) -> tuple[str, str]:
    """Question and answer: the last line, or else the last sentence, is the answer."""
    cut = max(text.rstrip().rfind("\n"), *[m.start() for m in re.finditer(r"(?<=[.!?]) ", text.rstrip())], -1)
    return (text[:cut], text[cut + 1 :]) if cut > 0 else (text, "")


class Corpus(NamedTuple):
    """What is known of all items: their number, mean and most words, and for each word (hashes in order) the items that hold it."""

    items: int
    length: float
    longest: int
    terms: np.ndarray
    df: np.ndarray


class ItemIndex:
    def __init__(self, items: list[tuple[int, str]], threshold: float = 0.6, overlap: float = 0.8, width: int = 5, whole: Corpus | None = None):
        """``whole``: the statistics of all items, where these are a shard of them."""
        self.threshold, self.overlap, self.width = threshold, overlap, width
        lower = pc.utf8_lower(pa.array([t for _, t in items], pa.large_string())).to_pylist()  # as the documents' texts
        n_words = np.bincount(bag(*utf8(pa.array(lower, pa.large_string())))[1], minlength=len(items))
        items = [(i, t) for (i, _), t, n in zip(items, lower, n_words) if n]
        self.ids = np.array([i for i, _ in items], np.int64)
        texts = [t for _, t in items]
        self.shingles = self._sets(texts)
        parts = [_split(t) for t in texts]
        sides = [[q for q, _ in parts], [a for _, a in parts]]
        self.question, self.answer = map(self._sets, sides)
        count = lambda ts: np.bincount(bag(*utf8(pa.array(ts, pa.large_string())))[1], minlength=len(ts))
        self.long = [count(side) >= PART_WORDS for side in sides]
        # entries: the items, then their long questions and answers
        own = [np.flatnonzero(long & (np.array(side, object) != np.array(texts, object))) for long, side in zip(self.long, sides)]
        self.of = np.concatenate([np.arange(len(items)), *own])
        sets = [self.shingles[i] for i in range(len(items))] + [kind[i] for kind, o in zip((self.question, self.answer), own) for i in o]
        self.ids = self.ids[self.of]
        self.runs = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]))
        self.short = [n for n in np.unique(count(texts)).tolist() if 0 < n < self.width]
        raw, at = utf8(pa.array(texts + [side[i] for side, o in zip(sides, own) for i in o], pa.large_string()))
        h, row, _, _ = bag(raw, at)
        n, own_items = len(self.of), len(items)
        length = np.bincount(row, minlength=n)
        pair = np.unique(np.stack([h, row.astype(np.uint64)]), axis=1, return_counts=True) if n else (np.zeros((2, 0), np.uint64), np.zeros(0))
        (term, item), tf = pair
        self.terms, start = np.unique(term, return_index=True)
        self.start = np.append(start, len(term))
        df = np.diff(self.start)
        item = item.astype(np.int64)
        seen = np.bincount(np.repeat(np.arange(len(df)), df)[item < own_items], minlength=len(df))  # items, not their parts
        if whole is None:
            whole = Corpus(own_items, float(length[:own_items].mean()) if n else 0.0, int(length.max(initial=0)), self.terms, seen)
        self.passage = 2 * max(16, whole.longest)
        seen = whole.df[np.searchsorted(whole.terms, self.terms)]
        idf = np.log(1 + (whole.items - seen + 0.5) / (seen + 0.5))
        impact = np.repeat(idf, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / max(whole.length, 1e-9))) if n else np.zeros(0)
        impact = impact / np.bincount(item, impact, n)[item] if n else impact
        # a verified passage lacks at most so many words as shingles; entries are scaled to share one threshold
        self.least = np.full(n, threshold)
        by = np.lexsort((-impact, item))
        cut = np.searchsorted(item[by], np.arange(n + 1))
        for i in range(n):
            lost = int((1 - overlap) * len(sets[i]) + 1e-9)
            self.least[i] = max(1e-6, min(threshold, 1 - impact[by[cut[i] : min(cut[i] + lost, cut[i + 1])]].sum() - 1e-9))
        self.item, self.impact = item, impact * (threshold / self.least)[item]
        self.words = [(term[by[cut[i] : cut[i + 1]]], impact[by[cut[i] : cut[i + 1]]]) for i in range(own_items)]
        self.max = np.maximum.reduceat(self.impact, start) if n else np.zeros(0)
        self.block_max = [np.maximum.reduceat(self.impact[a:b], np.arange(0, b - a, BLOCK)).tolist() for a, b in zip(self.start[:-1], self.start[1:])]
        self._items, self._impacts = array("q", self.item.tobytes()), array("d", self.impact.tobytes())
        self._starts, self._most = self.start.tolist(), self.max.tolist()

    def _sets(self, texts: list[str]) -> list[np.ndarray]:
        raw, at = utf8(pa.array(texts, pa.large_string()))
        h, row, _, _ = bag(raw, at)
        s, of = shingles(h, row, len(texts), self.width)
        cut = np.searchsorted(of, np.arange(len(texts) + 1))
        return [np.unique(s[a:b]) for a, b in zip(cut[:-1], cut[1:])]

    def wand(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """All entries whose scaled score for the distinct ``terms`` is above the threshold, by block-max WAND."""
        least, item, impact, start, most = self.threshold - 1e-9, self._items, self._impacts, self._starts, self._most
        # a cursor: [item, position, end, term]
        live = sorted([item[start[t]], start[t], start[t + 1], t] for t in terms.tolist())
        out = []
        while live:
            bound, pivot = 0.0, -1
            for i, c in enumerate(live):
                bound += most[c[3]]
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                break
            at = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == at:
                pivot += 1
            # the blocks that could hold the pivot item
            bound, reach = 0.0, live[pivot + 1][0] if pivot + 1 < len(live) else 1 << 62
            for c in live[: pivot + 1]:
                if c[0] < at:
                    c[1] = bisect_left(item, at, c[1], c[2])
                    if c[1] == c[2]:
                        continue
                    c[0] = item[c[1]]
                block = (c[1] - start[c[3]]) // BLOCK
                bound += self.block_max[c[3]][block]
                end = start[c[3]] + (block + 1) * BLOCK
                if end < c[2]:
                    reach = min(reach, item[end])
            target = at + 1
            if bound >= least:
                score = sum(impact[c[1]] for c in live[: pivot + 1] if c[0] == at and c[1] < c[2])
                if score >= least:
                    out.append((at, score))
            else:
                target = max(target, reach)
            for c in live[: pivot + 1]:
                if c[1] < c[2] and c[0] < target:
                    c[1] = bisect_left(item, target, c[1], c[2])
                    if c[1] < c[2]:
                        c[0] = item[c[1]]
            live = sorted(c for c in live if c[1] < c[2])
        return out

    def matches(self, raw: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, float, float, float, float]]:
        """(row, item, passage, score, overlap, question overlap, answer overlap): the best passage of each row and item."""
        h, row, _, _ = bag(raw, at)
        if not len(h) or not len(self.terms):
            return []
        step = self.passage // 2
        count = np.bincount(row, minlength=len(at) - 1)
        base = np.concatenate([[0], np.cumsum(count)])
        per = np.maximum(1, -(-(count - step) // step)) * (count > 0)
        owner = np.repeat(np.arange(len(count)), per)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        lo = base[owner] + place * step
        hi = np.minimum(lo + self.passage, base[owner + 1])
        best: dict[tuple[int, int], tuple] = {}
        mark = np.flatnonzero(self._marked(h))
        near = self._around(mark, row, base, per, step)
        for w in np.unique(near):
            own = slice(lo[w], hi[w])
            found = self.wand(self._terms(h[own]))
            if not found:
                continue
            seen, _ = shingles(h[own], np.zeros(hi[w] - lo[w], np.int64), 1, self.width)
            for item in sorted({int(self.of[e]) for e, _ in found}):
                part = [np.isin(s, seen).mean() if len(s) else 0.0 for s in (self.shingles[item], self.question[item], self.answer[item])]
                for i, sets in enumerate((self.shingles, self.question, self.answer)):
                    if len(sets[item]) == 1 and len(h[own]) >= self.width and not part[i]:
                        part[i] = self._short(h[own], sets[item])
                if part[0] >= self.overlap or any(long[item] and p >= self.overlap for long, p in zip(self.long, part[1:])):
                    score = float(self.words[item][1][np.isin(self.words[item][0], h[own])].sum())
                    key = (int(owner[w]), item)
                    best[key] = max(best.get(key, (-1.0,)), (part[0], score, -int(place[w]), part[1], part[2]))
        return [(r, i, -v[2], v[1], v[0], v[3], v[4]) for (r, i), v in sorted(best.items())]

    def _terms(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the distinct indexed words among ``h``."""
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.unique(at[self.terms[at] == h])

    def _marked(self, h: np.ndarray) -> np.ndarray:
        """Words at which a run of some entry starts."""
        out = np.zeros(len(h), bool)
        if len(h) >= self.width:
            full, _ = shingles(h, np.zeros(len(h), np.int64), 1, self.width)
            out[: len(full)] = self._known(full)
        for n in self.short:
            part = short_runs(h, n, self.width)
            out[: len(part)] |= self._known(part)
        return out

    def _known(self, run: np.ndarray) -> np.ndarray:
        return self.runs[np.minimum(np.searchsorted(self.runs, run), len(self.runs) - 1)] == run

    def _around(self, at: np.ndarray, row: np.ndarray, base: np.ndarray, per: np.ndarray, step: int) -> np.ndarray:
        """The passages that hold the words ``at``, for each word twice."""
        owner, last = row[at], (at - base[row[at]]) // step
        first = np.cumsum(per) - per
        return np.concatenate([first[owner] + np.minimum(last, per[owner] - 1), first[owner] + np.clip(last - 1, 0, per[owner] - 1)])

    def _short(self, h: np.ndarray, own: np.ndarray) -> float:
        """Texts of fewer words than a shingle are looked for as runs of their own length."""
        for n in range(1, self.width):
            runs = short_runs(h, n, self.width)
            if np.isin(own, runs).any():
                return 1.0
        return 0.0


def lowered(batch: pa.RecordBatch, text: str) -> pa.RecordBatch:
    """The batch with its texts in lower case, in any script."""
    return batch.set_column(batch.schema.get_field_index(text), text, pc.utf8_lower(batch.column(text)))


def item_indexes(benchmark: DataFrame, threshold: float, overlap: float, id_col: str = "item_id", text_col: str = "text", limit: int | None = None) -> Iterator[ItemIndex]:
    """Indexes of shards of about ``limit`` bytes of items, one after the other, under the statistics of all items.

    Null or wordless items and null ids are left out; items that repeat both
    id and text count once, those that repeat only an id count each.
    """
    items = benchmark.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").dropDuplicates(["i", "t"])
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    shards = max(1, -(-size // (limit or SHARD_BYTES)))
    items = items.withColumn("shard", F.pmod(F.xxhash64("i", "t"), F.lit(shards)))
    words = None
    if shards > 1:
        words = materialize(items.select("shard", F.col("t").alias("text")).mapInArrow(_item_words, "shard bigint, n bigint, terms array<bigint>"), "itemwords")
        n, length, longest = words.where("n > 0").agg(F.count("*"), F.avg("n"), F.max("n")).first()
        each = words.select("shard", F.explode("terms").alias("term"))
        df = materialize(each.groupBy("term").agg(F.count("*").alias("df")), "itemterms")
    for s in range(shards):
        rows = [(r["i"], r["t"]) for r in items.where(F.col("shard") == s).orderBy("i", "t").collect()]  # about `limit` bytes
        whole = None
        if words is not None:  # the words of one shard
            own = df.join(each.where(F.col("shard") == s).select("term").distinct(), "term").toArrow()
            term = own.column("term").to_numpy().view(np.uint64)
            order = np.argsort(term)
            whole = Corpus(int(n), float(length), int(longest), term[order], own.column("df").to_numpy()[order])
        yield ItemIndex(rows, threshold, overlap, whole=whole)


def _item_words(batches):
    schema = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int64()))])
    for batch in batches:
        for part, raw, at in slices(lowered(batch, "text"), "text"):
            h, row, _, _ = bag(raw, at)
            cut = np.searchsorted(row, np.arange(len(part) + 1))
            yield batch_of(schema, part.column("shard"), np.diff(cut), [np.unique(h[a:b]).view(np.int64) for a, b in zip(cut[:-1], cut[1:])])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """doc_id, item_id, passage, score, overlap, question_overlap, answer_overlap: one row per document and verified item.

    Null or wordless text matches nothing; null ids stay null; repeated rows
    are reported each; other columns are ignored; an empty documents or
    benchmark table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for index in item_indexes(benchmark, threshold, overlap):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        del index

        def run(batches, shared=shared):
            schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("passage", pa.int64()), *((c, pa.float64()) for c in ("score", "overlap", "question_overlap", "answer_overlap"))])
            index = shared.value
            for batch in batches:
                for part, raw, at in slices(lowered(batch, "text"), "text"):
                    if found := index.matches(raw, at):
                        row, item, *rest = map(np.array, zip(*found))
                        yield batch_of(schema, part.column("doc_id").take(pa.array(row)), index.ids[item], *rest)

        found = docs.mapInArrow(run, "doc_id bigint, item_id bigint, passage bigint, score double, overlap double, question_overlap double, answer_overlap double")
        out = found if out is None else out.union(found)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """``docs`` without the rows in which an item is found; decided where the row is read, without a shuffle."""
    for index in item_indexes(benchmark, threshold, overlap):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        del index

        def run(batches, shared=shared):
            for batch in batches:
                keep = [np.zeros(0, bool)]
                for part, raw, at in slices(lowered(batch, text_col), text_col):
                    keep.append(np.ones(len(part), bool))
                    keep[-1][[m[0] for m in shared.value.matches(raw, at)]] = False
                yield batch.filter(pa.array(np.concatenate(keep)))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
