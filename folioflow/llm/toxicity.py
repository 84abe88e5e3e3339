"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams
(with word ends marked) and of the whole word; a passage's vector is the mean
of its words' vectors; a linear softmax of two classes reads it.  Unseen
misspellings so share n-gram vectors with words seen in training.

A long text is toxic when one passage of it is, so a text's score is that of
its worst passage of ``window`` words (a multiple-instance reading): training
sends each text's gradient through its passage with the highest toxic logit,
embeddings and softmax together.  A last scalar calibration turns that logit
into a probability.

Since averaging and softmax are linear in the embeddings, the trained model
folds into one number per n-gram bucket; scoring needs 4 bytes per bucket.
Labels, language, source and ids never enter a score.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import BYTE_CODE, LOWER, SLICE_BYTES, bag, batch_of, binaries, mix, row_slices, slices, trim, utf8

def ngrams(raw: np.ndarray, a: np.ndarray, b: np.ndarray, h: np.ndarray, sizes: tuple[int, ...], buckets: int, step: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of the words raw[a:b], as (bucket, word index), the whole word first; ``step`` words at once."""
    if len(a) > step:
        parts = [ngrams(raw, a[k : k + step], b[k : k + step], h[k : k + step], sizes, buckets, step) for k in range(0, len(a), step)]
        return np.concatenate([p for p, _ in parts]), np.concatenate([of + k * step for k, (_, of) in enumerate(parts)])
    size = b - a + 2  # with both ends marked
    start = np.concatenate([[0], np.cumsum(size)])
    text = np.full(start[-1], 256, np.int64)
    inner = np.repeat(a - start[:-1] - 1, size) + np.arange(start[-1])
    mid = np.ones(start[-1], bool)
    mid[start[:-1]] = mid[start[1:] - 1] = False
    text[mid] = LOWER[raw[inner[mid]]]
    word = np.repeat(np.arange(len(a)), size)
    code = BYTE_CODE[text]
    out, of = [h % np.uint64(buckets)], [np.arange(len(a))]
    for n in sizes:
        if len(text) < n:
            continue
        m = len(text) - n + 1
        run = np.zeros(m, np.uint64)
        for i in range(n):
            run = run * np.uint64(0x100000001B3) + code[i : i + m]
        whole = word[:m] == word[n - 1 :]
        out.append(mix(run[whole] + np.uint64(n)) % np.uint64(buckets))
        of.append(word[:m][whole])
    out, of = np.concatenate(out).astype(np.int32), np.concatenate(of).astype(np.int32)
    order = np.argsort(of, kind="stable")
    return out[order], of[order]


def vocabulary(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word number, row) of each word of the texts, and for each number its hash, first byte and byte after; slice by slice."""
    numbers, rows, kinds, starts, ends, held = [], [], [], [], [], 0
    for lo, _, part, own in row_slices(raw, at, SLICE_BYTES // 4):
        h, row, a, b = bag(part, own)
        kind, first, number = np.unique(h, return_index=True, return_inverse=True)
        numbers.append((number + held).astype(np.int32))
        rows.append((row + lo).astype(np.int32))
        kinds.append(kind)
        starts.append(a[first] + at[lo])
        ends.append(b[first] + at[lo])
        held += len(kind)
    if not held:
        z = np.zeros(0, np.int64)
        return z, z, z.view(np.uint64), z, z
    vocab, first, number = np.unique(np.concatenate(kinds), return_index=True, return_inverse=True)
    return number.astype(np.int32)[np.concatenate(numbers)], np.concatenate(rows), vocab, np.concatenate(starts)[first], np.concatenate(ends)[first]


def windows_of(row: np.ndarray, rows: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Passage of each word and row of each passage: runs of ``window`` words of one row."""
    count = np.bincount(row, minlength=rows)
    kind = np.int32 if len(row) < 1 << 31 else np.int64
    place = np.arange(len(row), dtype=kind) - np.repeat((np.cumsum(count) - count).astype(kind), count)
    per = -(-count // window)
    place //= window
    place += np.repeat((np.cumsum(per) - per).astype(kind), count)
    return place, np.repeat(np.arange(rows, dtype=kind), per)


class SubwordSoftmax:
    def __init__(self, buckets: int = 1 << 17, dim: int = 8, sizes: tuple[int, ...] = (3, 4, 5), window: int = 3, epochs: int = 4, rate: float = 3.0, prior: float = 30.0, seed: int = 1):
        self.buckets, self.dim, self.sizes, self.window, self.epochs, self.rate, self.prior, self.seed = buckets, dim, sizes, window, epochs, rate, prior, seed

    def fit(self, texts: list[str], labels: list[int]) -> SubwordSoftmax:
        """Every passage of a clean text is clean; a toxic text speaks through its worst passage.

        In the first epoch each passage of a toxic text counts a little.  With
        two classes the gradient of all embeddings of a step is one number
        per bucket times the difference of the softmax's columns, so a step
        is a weighted count.
        """
        rng = np.random.default_rng(self.seed)
        texts, labels = zip(*dict.fromkeys(zip(texts, labels))) if len(texts) else ((), ())  # copies count once
        y = np.asarray(labels, float)
        raw, at = utf8(pa.array(texts, pa.large_string()))
        del texts
        word, row, vocab, a, b = vocabulary(raw, at)
        sub, of = ngrams(raw, a, b, vocab, self.sizes, self.buckets)
        cut = np.searchsorted(of, np.arange(len(vocab) + 1))
        spans = np.diff(cut)
        passage, passage_row = windows_of(row, len(y), self.window)
        pcut = np.searchsorted(passage, np.arange(len(passage_row) + 1))
        del row, a, b, vocab, of, passage
        size = np.diff(pcut)
        start = np.flatnonzero(np.diff(passage_row, prepend=-1))  # first passage of each text that has words
        toxic = y[passage_row] > 0 if len(passage_row) else np.zeros(0, bool)
        E = rng.normal(0, 0.05, (self.buckets, self.dim))
        W = rng.normal(0, 0.3, (self.dim, 2))
        bias = 0.0
        hE, hW, hb = np.full(self.buckets, float(self.prior)), np.full(self.dim, 1.0), 1.0
        balance = (~toxic).sum() / max(y.sum(), 1) / 4
        for epoch in range(self.epochs if len(passage_row) and 0 < y.sum() < len(y) else 0):
            if epoch:
                value = (E @ (W[:, 1] - W[:, 0]))[sub]
                logit = np.add.reduceat((np.add.reduceat(value, cut[:-1]) / spans)[word], pcut[:-1]) / size
                top = np.repeat(np.maximum.reduceat(logit, start), np.diff(np.append(start, len(logit))))
                weight = np.where(toxic, balance * (logit >= top), 1.0)
            else:
                weight = np.where(toxic, balance / np.repeat(np.diff(np.append(start, len(toxic))), np.diff(np.append(start, len(toxic)))), 1.0)
            for part in np.array_split(rng.permutation(np.flatnonzero(weight)), max(1, int((weight > 0).sum()) // 2048)):
                flat = np.concatenate([word[pcut[p] : pcut[p + 1]] for p in part])
                owner = np.repeat(np.arange(len(part)), size[part])
                n = spans[flat]
                subs = sub[np.repeat(cut[flat] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                share = np.repeat(1 / n / size[part][owner], n)
                to = np.repeat(owner, n)
                diff = W[:, 1] - W[:, 0]
                z = np.bincount(to, (E @ diff)[subs] * share, len(part)) + bias
                delta = weight[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[part])
                c = np.bincount(subs, share * delta[to], self.buckets)
                rows = np.unique(subs)
                c_rows = c[rows]
                gW = c_rows @ E[rows]
                hE[rows] += (c_rows**2) * (diff @ diff)
                E[rows] -= self.rate * c_rows[:, None] * diff / np.sqrt(hE[rows])[:, None]
                hW += gW**2
                W += 0.03 * np.outer(gW / np.sqrt(hW), [1, -1])
                hb += delta.sum() ** 2
                bias -= 0.3 * delta.sum() / np.sqrt(hb)
        self.fold = (E @ (W[:, 1] - W[:, 0])).astype(np.float32)
        self.bias = float(bias)
        self.scale, self.shift = 1.0, 0.0
        del E, hE, sub, word
        self._calibrate(np.concatenate([np.zeros(0), *(self.logits(part, own) for _, _, part, own in row_slices(raw, at, SLICE_BYTES // 4))]), y)
        del raw, at
        trim()
        return self

    def _calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """Newton steps for the scalar logistic p = s(scale * z + shift)."""
        scale, shift = 1.0, 0.0
        for _ in range(30 if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-np.clip(scale * z + shift, -30, 30)))
            q = p * (1 - p) + 1e-6
            g = np.array([((p - y) * z).sum() + 1e-3 * scale, (p - y).sum()])
            H = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum()]])
            d = np.linalg.solve(H, g)
            scale, shift = scale - np.clip(d[0], -1, 1), shift - np.clip(d[1], -1, 1)
        self.scale, self.shift = (float(scale), float(shift)) if scale > 0 else (1.0, float(shift))

    def logits(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The highest passage logit of each text; a text without words has that of an empty bag."""
        h, row, a, b = bag(raw, at)
        out = np.full(len(at) - 1, self.bias)
        if len(h):
            vocab, first, word = np.unique(h, return_index=True, return_inverse=True)
            sub, of = ngrams(raw, a[first], b[first], vocab, self.sizes, self.buckets)
            cut = np.searchsorted(of, np.arange(len(vocab) + 1))
            per_word = np.add.reduceat(self.fold[sub], cut[:-1]) / np.diff(cut)
            passage, passage_row = windows_of(row, len(at) - 1, self.window)
            pcut = np.searchsorted(passage, np.arange(len(passage_row) + 1))
            logit = np.add.reduceat(per_word[word], pcut[:-1]) / np.diff(pcut) + self.bias
            start = np.flatnonzero(np.diff(passage_row, prepend=-1))
            out[passage_row[start]] = np.maximum.reduceat(logit, start)
        return out

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(raw, at) + self.shift, -30, 30)))


#: Labelled rows that a fit may see at most, bytes of their texts, and bytes of one text.
FIT_ROWS, FIT_BYTES, FIT_TEXT = 5_000, 8 << 20, 128 << 10


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, keep, rows: int = FIT_ROWS, longest: int = FIT_TEXT) -> DataFrame:
    """(text, label) of a bounded, repeatable sample in one sorted partition: the labelled rows with the smallest hash of their id.

    ``keep`` is a condition on doc_id.  Rows without label are left out, and
    texts of over ``longest`` bytes.  Where labels of one id differ, the
    greatest counts; where its texts do, the one with the smallest hash.
    """
    marked = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.max("label").alias("label"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most `rows` rows of 12 bytes
    text = F.coalesce("text", F.lit(""))
    got = docs.select("doc_id", text.alias("text")).where(F.octet_length("text") <= longest).join(F.broadcast(marked), "doc_id")
    got = got.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("s"))
    return got.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("s.text", "label")


def fitted(sample: DataFrame, fit: Callable[[list[str], list[int]], object], limit: int = FIT_BYTES) -> object:
    """``fit`` on the sample's first ``limit`` bytes of text, in one task of an executor; only the model comes back."""

    def run(batches):
        texts, ys, used = [], [], 0
        for batch in batches:
            for t, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                used += len(t.encode())
                if used <= limit:
                    texts.append(t)
                    ys.append(y)
        yield batch_of(pa.schema([("model", pa.binary())]), binaries([pickle.dumps(fit(texts, ys))]))

    made = sample.mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else fit([], [])


def held_out(id_col: str = "doc_id", fold: int = 0):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == fold


def score_texts(docs: DataFrame, model: SubwordSoftmax, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted: one row per input row.

    Null text counts as empty; texts without words get the score of an empty
    bag; null ids and repeated rows are scored like others; other columns are
    ignored; an empty table gives an empty result.  The folded model (256 KB)
    travels with the task.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
        for batch in batches:
            for part, raw, at in slices(batch, "text"):
                p = held.value.scores(raw, at)
                yield batch_of(schema, part.column("doc_id"), p, (p >= 0.5).astype(np.int32))

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, score double, predicted int")


def train(docs: DataFrame, labels: DataFrame, fold: int | None = 0) -> SubwordSoftmax:
    """Fit on labelled documents outside the held-out fold (all if ``fold`` is None); an empty sample gives a constant score."""
    keep = ~held_out(fold=fold) if fold is not None else F.lit(True)
    return fitted(fit_sample(docs, labels, "toxic", keep), lambda texts, ys: SubwordSoftmax().fit(texts, ys))


def without_toxic(docs: DataFrame, model: SubwordSoftmax, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic; decided where the row is read, without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            keep = [np.ones(0, bool)]
            for _, raw, at in slices(batch, text_col):
                keep.append(held.value.scores(raw, at) < 0.5)
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
