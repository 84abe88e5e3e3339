"""Language-model scores from a probabilistic suffix tree.

Symbols are the bytes of a text's lower-cased words, a blank after every word
but the last and an end symbol after that, so the tree spells out unseen
words.  A text's probability is the product over its symbols, given the text
so far.

Training: every partition counts its (context, next) pairs of the largest
order and sends distinct pairs with counts; shorter contexts' counts are sums
of those.  A context may be kept when it was seen ``least`` times, a fixed
number whatever the corpus, and when its next-symbol distribution diverges
from its suffix's by a test: n * KL > penalty * distinct nexts * ln(n) / 2.
Suffixes of kept contexts are kept.  Distributions are smoothed toward the
suffix's with a weight of as many positions as it has distinct nexts
(Witten-Bell).  Scoring uses the longest kept suffix of what precedes each
symbol.

The texts' symbols are written once, in numbered slices that every later step
reads.  The tree grows with the corpus, so it is a table: contexts of up to
``ROOT`` symbols (at most 256 ** ROOT, by the alphabet) are shared, and all
longer ones lie in the bucket of their last ``ROOT + 1`` symbols, where their
suffixes lie too.  Words' exact training counts, which the base score needs,
lie in buckets of their hash.  A slice asks each bucket for its distinct keys
or words, packed as one array, and is then summed up with the answers; as a
slice asks for a frequent word once, no bucket is hot.  There are at most
``BUCKETS`` of them, so rows and bytes grow in proportion to the input, and a
bucket's table is copied once for ``PER_COPY`` partitions.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import LOWER, batch_of, binaries, drop_materialized, materialize, mix, slices, trim, words, workspace

END, BLANK = 0x0A, 0x20
#: Text bytes of a slice, distinct pairs that a task holds.
STEP, HELD = 6 << 20, 1_500_000
#: Symbols of shared contexts, of the longest ones, most buckets, and input partitions that share a copy of a bucket's table.
ROOT, DEEPEST, BUCKETS, PER_COPY = 2, 7, 4096, 20_000
_END_WORD = np.uint64(0x5E5D00DE0D0E5EED)


def symbols(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol stream of all texts, its offsets, word hashes, row of each word)."""
    h, row, a, b = words(raw, at)
    rows = len(at) - 1
    size = b - a
    count = np.bincount(row, minlength=rows)
    empty = np.concatenate([[0], np.cumsum(count == 0)])[:-1]  # texts without words before a row
    shift = (np.cumsum(size + 1) - size - 1 if len(size) else size) + empty[row]
    out = np.full(int(size.sum() + len(size) + (count == 0).sum()), END, np.uint8)
    if len(size):
        flat = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out[np.repeat(shift - (np.cumsum(size) - size), size) + np.arange(size.sum())] = LOWER[raw[flat]]
        inner = np.flatnonzero(row[1:] == row[:-1]) if len(row) > 1 else np.zeros(0, np.int64)
        out[shift[inner] + size[inner]] = BLANK
    ends = np.bincount(row, weights=size + 1, minlength=rows).astype(np.int64) + (count == 0)
    return out, np.concatenate([[0], np.cumsum(ends)]), h, row


def grams(stream: np.ndarray, order: int) -> np.ndarray:
    """(context, next) of each symbol: next in the low byte, then the context from its last symbol on.

    A text starts after an end symbol; nothing before it is seen (zero).
    """
    n, step = len(stream), 1 << 19
    key = np.empty(n, np.uint64)
    for lo in range(0, n, step):  # a stretch at a time, each with the symbols before it
        back = min(order, lo)
        key[lo : lo + step] = _grams(stream[lo - back : lo + step], order)[back:]
    return key


def _grams(stream: np.ndarray, order: int) -> np.ndarray:
    n = len(stream)
    key = stream.astype(np.uint64)
    alive = np.ones(n, bool)
    for j in range(1, order + 1):
        past = np.full(n, END, np.uint8)
        past[j:] = stream[: max(n - j, 0)]
        if j > 1:  # before the first text there is only its start
            past[: min(j - 1, n)] = 0
        key |= (past * alive).astype(np.uint64) << np.uint64(8 * j)
        alive &= past != END
    return key


def _mask(d: int) -> int:
    return (1 << (8 * (d + 1))) - 1


class SuffixTree:
    """The kept contexts: per order sorted (context, next) entries with log10 p, and contexts with log10 of their rest weight."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], penalty: float = 1.0, above: SuffixTree | None = None, needed: np.ndarray | None = None):
        """``levels``: for each order from 0, or from the one after ``above``'s last, the sorted (context, next) keys and their counts.

        ``needed``: contexts of the last order that stay as suffixes of longer ones elsewhere.
        """
        self.first = above.order + 1 if above else 0
        self.order = self.first + len(levels) - 1
        built, keep, probs = [], [], []
        self.last = above.last if above else None
        for keys, n in levels:
            ctx, first, inverse = np.unique(keys >> np.uint64(8), return_index=True, return_inverse=True)
            total = np.add.reduceat(n, first).astype(float) if len(first) else np.zeros(0)
            kinds = np.diff(np.append(first, len(keys))).astype(float)
            built.append([keys, n.astype(float), ctx, total, kinds, inverse])
        for d, (keys, n, ctx, total, kinds, inverse) in enumerate(built, self.first):
            if d == 0:
                parent = np.full(len(keys), 1 / 256)
            else:  # every entry's suffix entry exists
                parent = self.last[1][np.searchsorted(self.last[0], keys & np.uint64(_mask(d - 1)))]
            p = (n + kinds[inverse] * parent) / (total + kinds)[inverse] if len(keys) else np.zeros(0)
            probs.append(p)
            self.last = keys, p
            kl = np.bincount(inverse, n * np.log(np.maximum(n / total[inverse], 1e-300) / parent), len(ctx)) if len(keys) else np.zeros(0)
            keep.append(np.ones(len(ctx), bool) if d == 0 else kl > penalty * kinds * np.log(np.maximum(total, 2)) / 2)
        if needed is not None and len(needed):
            keep[-1][np.searchsorted(built[-1][2], needed)] = True
        self.needs = np.zeros(0, np.uint64)
        for i in range(len(built) - 1, -1, -1):  # suffixes of kept contexts stay
            d, ctx = self.first + i, built[i][2][keep[i]]
            if d > 1 and len(ctx):
                up = np.unique(ctx & np.uint64(_mask(d - 2)))
                if i:
                    keep[i - 1][np.searchsorted(built[i - 1][2], up)] = True
                else:
                    self.needs = up
        self.entries, self.contexts = [], []
        for i, (keys, n, ctx, total, kinds, inverse) in enumerate(built):
            e = keep[i][inverse] if len(keys) else np.zeros(0, bool)
            self.entries.append((keys[e], np.log10(probs[i][e])))
            self.contexts.append((ctx[keep[i]], np.log10(kinds[keep[i]] / (total + kinds)[keep[i]])))

    def log10(self, key: np.ndarray, above: SuffixTree | None = None) -> np.ndarray:
        out, done = np.zeros(len(key)), np.zeros(len(key), bool)
        for i in range(len(self.entries) - 1, -1, -1):
            own = key & np.uint64(_mask(self.first + i))
            where, rest = _find(self.contexts[i][0], own >> np.uint64(8))
            at, hit = _find(self.entries[i][0], own)
            hit &= ~done
            out[hit] += self.entries[i][1][at[hit]]
            done |= hit
            falls = rest & ~done
            out[falls] += self.contexts[i][1][where[falls]]
        out[~done] += above.log10(key[~done]) if above else np.log10(1 / 256)
        return out

    def score(self, stream: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        key, inverse = np.unique(grams(stream, self.order), return_inverse=True)
        total = np.concatenate([[0.0], np.cumsum(self.log10(key)[inverse])])
        return total[offsets[1:]] - total[offsets[:-1]]


def _find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return at, table[at] == key


def _sum_by_key(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def levels_of(keys: np.ndarray, n: np.ndarray, first: int, order: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the (context, next) keys, and their counts, of contexts seen ``least`` times, from keys of the largest order."""
    levels = []
    for d in range(first, order + 1):
        k, c = _sum_by_key([(keys & np.uint64(_mask(d)), n)])
        ctx, at, inverse = np.unique(k >> np.uint64(8), return_index=True, return_inverse=True)
        ok = (np.add.reduceat(c, at) >= least)[inverse] if len(k) else np.zeros(0, bool)
        levels.append((k[ok], c[ok]))
    return levels


def _spread(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by bucket, where each bucket starts in it) of (context, next) keys: by the last symbols of the context."""
    bucket = (mix((h >> np.uint64(8)) & np.uint64(_mask(ROOT))) % np.uint64(buckets)).astype(np.int16 if buckets < 32768 else np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, in planes of bytes, compressed."""
    return _packed(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(blob: pa.Scalar) -> np.ndarray:
    raw = _unpacked(blob)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, len(raw) // 8).T).view(np.uint64).ravel(), dtype=np.uint64)


class LanguageModelScores:
    """Train on the rows of ``docs`` where ``train`` holds and score every row.

    Rows: one per input row.  Null text counts as empty (its end symbol is
    scored); null ids train nothing and stay null; repeated rows count and
    are scored each; other columns are ignored; an empty table gives an empty
    result.
    """

    def __init__(self, order: int = 5, least: int = 2, penalty: float = 1.0, fold: int = 1):
        if not 0 <= order <= DEEPEST:
            raise ValueError(f"order {order} is not in 0 to {DEEPEST}")
        self.order, self.least, self.penalty, self.fold = order, least, penalty, fold

    def scores(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        held = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == self.fold
        docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(held, F.lit(True)).alias("held_out"), F.col(text_col).alias("text"))
        parts = max(1, docs.rdd.getNumPartitions())
        self.buckets, self.copies = min(32 + parts // 2, BUCKETS), 1 + parts // PER_COPY
        with workspace(docs.sparkSession):
            texts = materialize(docs.mapInArrow(_cut_up, _TEXTS), "symbols")
            root, tables, known = self._learned(texts)
            return materialize(self._scored(texts, root, tables, *known), "scores", keep=True)

    # --- counts and the tree -------------------------------------------------

    def _learned(self, texts: DataFrame) -> tuple[SuffixTree, DataFrame, tuple[int, int]]:
        """The shared short contexts; per kind and bucket the longer ones (a pickled tree) or the words' counts; all tokens and kinds of words."""
        order, buckets, least, penalty, top = self.order, self.buckets, self.least, self.penalty, min(ROOT, self.order)
        spark = texts.sparkSession

        def count(batches):
            schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("h", pa.binary()), ("n", pa.binary())])
            held, size = ([], []), [0, 0]

            def flush(kind):
                keys, n = _sum_by_key(held[kind])
                by, cut = _SPREAD[kind](keys, buckets)
                keys, n = keys[by], n[by].astype(np.int64)
                own = [slice(cut[b], cut[b + 1]) for b in range(buckets)]
                yield batch_of(schema, np.full(buckets, kind), np.arange(buckets), binaries([_pack(keys[o]) for o in own]), binaries([_packed(n[o].tobytes()) for o in own]))

            for s in _rows(batches):
                keep = ~s.held
                stream = s.stream[np.repeat(keep, np.diff(s.ends, prepend=0))]
                if not len(stream):
                    continue
                seen = words(stream, np.array([0, len(stream)]))[0]
                for kind, keys in enumerate((grams(stream, order), np.concatenate([seen, np.full(int(keep.sum()), _END_WORD)]))):
                    held[kind].append(_unique(keys))
                    size[kind] += len(held[kind][-1][0])
                    if size[kind] > 2 * HELD:
                        held[kind][:] = [_sum_by_key(held[kind])]
                        size[kind] = len(held[kind][0][0])
                        if size[kind] > HELD:
                            yield from flush(kind)
                            held[kind].clear()
                            size[kind] = 0
            for kind in KINDS:
                if held[kind]:
                    yield from flush(kind)

        def add(key, group):
            keys, n = _pairs(group)
            return pa.table({"kind": pa.array([key[0].as_py()], pa.int32()), "bucket": pa.array([key[1].as_py()], pa.int32()), "kinds": pa.array([len(keys)], pa.int64()), "total": pa.array([int(n.sum())], pa.int64()), "h": binaries([_pack(keys)]), "n": binaries([_packed(n.tobytes())])})

        counted = texts.mapInArrow(count, "kind int, bucket int, h binary, n binary").groupBy("kind", "bucket").applyInArrow(add, "kind int, bucket int, kinds bigint, total bigint, h binary, n binary")
        counted = materialize(counted, "counts")
        grams_of, words_of = counted.where(F.col("kind") == GRAM), counted.where(F.col("kind") == WORD)

        def short(batches):
            schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])
            for batch in batches:
                keys, n = _pairs(batch)
                keys, n = _sum_by_key([(keys & np.uint64(_mask(top)), n)])
                yield batch_of(schema, keys.view(np.int64), n)

        # keys of ROOT + 1 bytes: at most 256 ** 3 of 16 bytes by the alphabet, in UTF-8 text far fewer
        found = grams_of.mapInArrow(short, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        levels = levels_of(found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy(), 0, top, least)
        above = spark.sparkContext.broadcast(SuffixTree(levels, penalty))

        def build(batches):
            schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
            for batch in batches:
                for r in range(len(batch)):
                    tree = SuffixTree(levels_of(*_pairs(batch.slice(r, 1)), top + 1, order, least), penalty, above.value)
                    tree.last, needs = None, tree.needs
                    yield batch_of(schema, [GRAM], batch.column("bucket")[r : r + 1], binaries([pickle.dumps(tree)]), binaries([needs.tobytes()]))

        trees = grams_of.mapInArrow(build, "kind int, bucket int, a binary, b binary")
        tables = materialize(trees.unionByName(words_of.select("kind", "bucket", F.col("h").alias("a"), F.col("n").alias("b"))), "tables")

        def suffixes(batches):
            for batch in batches:
                for blob in batch.column("b"):
                    yield batch_of(pa.schema([("ctx", pa.int64())]), np.frombuffer(blob.as_buffer(), np.int64))

        needed = tables.where(F.col("kind") == GRAM).select("b").mapInArrow(suffixes, "ctx bigint").distinct().toArrow().column("ctx").to_numpy().view(np.uint64)  # contexts of ROOT symbols
        root = SuffixTree(levels, penalty, needed=needed)
        root.last = None
        known = words_of.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("N"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("V")).first()  # two numbers
        drop_materialized(counted)
        return root, tables, (int(known["N"]), int(known["V"]))

    # --- scores of the texts -------------------------------------------------

    def _scored(self, texts: DataFrame, root: SuffixTree, tables: DataFrame, total: int, kinds: int) -> DataFrame:
        """Slices ask the buckets for their distinct keys and words and are summed up with the answers."""
        shared = texts.sparkSession.sparkContext.broadcast(root)  # bounded by the alphabet
        order, buckets, copies, log_all = self.order, self.buckets, self.copies, float(np.log10(total + 0.5 * (kinds + 1)))

        def ask(batches):
            schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("copy", pa.int32()), ("first", pa.int64()), ("keys", pa.binary())])
            for s in _rows(batches):
                for kind, keys in enumerate((np.unique(grams(s.stream, order)), _own_words(s)[2])):
                    by, cut = _SPREAD[kind](keys, buckets)
                    keys = keys[by]
                    yield batch_of(schema, np.full(buckets, kind), np.arange(buckets), np.full(buckets, (s.first >> 40) % copies), np.full(buckets, s.first), binaries([_pack(keys[cut[b] : cut[b + 1]]) for b in range(buckets)]))

        def look_up(key, left, right):
            schema = pa.schema([("first", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("found", pa.binary())])
            kind, out = key[0].as_py(), []
            if kind == GRAM:
                tree = pickle.loads(right.column("a")[0].as_buffer()) if len(right) else None
                answer = lambda own: tree.log10(own, shared.value) if tree else shared.value.log10(own)
            else:
                table = _pairs(right, "a", "b") if len(right) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

                def answer(own):
                    at, hit = _find(table[0], own)
                    n = np.zeros(len(own), np.int64)
                    n[hit] = table[1][at[hit]]
                    return n

            r = 0
            while r < len(left):
                held, size = [], 0
                while r + len(held) < len(left) and size < HELD // 2:
                    held.append(_unpack(left.column("keys")[r + len(held)]))
                    size += len(held[-1])
                own, inverse = np.unique(np.concatenate(held), return_inverse=True)
                found = answer(own)[inverse]
                ends = np.cumsum([len(h) for h in held])
                pack = _pack_logs if kind == GRAM else lambda n: _packed(n.tobytes())
                out += [pack(found[b - len(h) : b]) for b, h in zip(ends, held)]
                r += len(held)
            trim()
            return pa.Table.from_batches([batch_of(schema, left.column("first").combine_chunks(), np.full(len(left), kind), np.full(len(left), key[1].as_py()), binaries(out))], schema)

        def sum_up(key, left, right):
            s = next(_rows(left.select(["first", "doc_id", "held_out", "ends", "stream"]).combine_chunks().to_batches()))
            kinds_of = _Kinds(grams(s.stream, order))
            row, h, known = _own_words(s)
            own, answers = (kinds_of.own, known), []
            for kind in KINDS:
                by, cut = _SPREAD[kind](own[kind], buckets)
                answers.append((by, cut, np.full(len(own[kind]), np.nan)))
            for kind, b, blob in zip(right.column("kind").to_pylist(), right.column("bucket").to_pylist(), right.column("found")):
                by, cut, got = answers[kind]
                got[by[cut[b] : cut[b + 1]]] = _unpack_logs(blob) if kind == GRAM else _unpacked(blob).view(np.int64)
            logs = kinds_of.spread(answers[GRAM][2])
            del kinds_of, own
            total = np.concatenate([[0.0], np.cumsum(logs, out=logs)])
            n_of, rows = answers[WORD][2], len(s.ends)
            n = n_of[np.searchsorted(known, h)]
            at_end = n_of[np.searchsorted(known, _END_WORD)]  # every text ends once
            tokens = np.bincount(row, minlength=rows) + 1
            seen = np.bincount(row, n > 0, rows).astype(np.int64) + int(at_end > 0)
            base = np.bincount(row, np.log10(n + 0.5), rows) + np.log10(at_end + 0.5)
            score = total[s.ends] - total[np.append(0, s.ends[:-1])]
            trim()
            return pa.Table.from_batches([batch_of(_SCORES, s.doc_id, s.held, tokens, seen, np.full(rows, train), base - tokens * log_all, score)], _SCORES)

        train = total
        asked = texts.mapInArrow(ask, "kind int, bucket int, copy int, first bigint, keys binary")
        spread = tables.select("kind", "bucket", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "a", "b")
        key = ["kind", "bucket", "copy"]
        answers = asked.groupBy(*key).cogroup(spread.groupBy(*key)).applyInArrow(look_up, "first bigint, kind int, bucket int, found binary")
        return texts.groupBy("first").cogroup(answers.groupBy("first")).applyInArrow(sum_up, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


# --- slices of texts -----------------------------------------------------------------

GRAM, WORD = KINDS = (0, 1)
_TEXTS = "first bigint, doc_id array<bigint>, held_out array<boolean>, ends array<bigint>, stream binary"
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


class _Slice:
    """A row of the symbols' table: some texts' symbols, where each ends, and a number of its own."""

    def __init__(self, batch: pa.RecordBatch, r: int):
        self.first = batch.column("first")[r].as_py()
        self.doc_id, held, ends = (batch.column(c)[r].values for c in ("doc_id", "held_out", "ends"))
        self.held, self.ends = held.to_numpy(zero_copy_only=False).astype(bool), ends.to_numpy()
        self.stream = _unpacked(batch.column("stream")[r])


def _rows(batches):
    for batch in batches:
        for r in range(len(batch)):
            yield _Slice(batch, r)
        trim()


def _cut_up(batches):
    """Texts to symbols, a row for each slice; what follows reads the slices written here, each under the number given here."""
    schema = pa.schema([("first", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("ends", pa.list_(pa.int64())), ("stream", pa.binary())])
    number, held, size = _first_row(), [], 0

    def filled():
        streams, ends, ids, kept = zip(*held)
        shift = np.cumsum([0, *(len(x) for x in streams[:-1])])
        ends = np.concatenate([e + k for e, k in zip(ends, shift)])
        whole = pa.array([0, len(ends)], pa.int32())
        lists = [pa.ListArray.from_arrays(whole, x) for x in (pa.concat_arrays(ids), pa.concat_arrays(kept), pa.array(ends, pa.int64()))]
        return batch_of(schema, [number], *lists, binaries([_packed(b"".join(x.tobytes() for x in streams))]))

    for batch in batches:
        for part, raw, at in slices(batch, "text", STEP // 4):
            stream, offsets, _, _ = symbols(raw, at)
            if held and size + len(stream) > STEP:
                yield filled()
                number, held, size = number + 1, [], 0
            held.append((stream, offsets[1:], part.column("doc_id"), part.column("held_out")))
            size += len(stream)
    if held:
        yield filled()


def _own_words(s: _Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row and hash of each word, distinct words and the end in order)."""
    h, row, _, _ = words(s.stream, np.append(0, s.ends))
    return row, h, np.unique(np.append(h, _END_WORD))


class _Kinds:
    """Distinct keys in order, and their values put back in the places of all keys; leaner than an inverse."""

    def __init__(self, keys: np.ndarray):
        self.places = np.argsort(keys)
        keys = keys[self.places]
        self.first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        self.own = keys[self.first]

    def spread(self, values: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.places))
        out[self.places] = np.repeat(values, np.diff(np.append(np.flatnonzero(self.first), len(self.places))))
        return out


def _packed(raw: bytes) -> bytes:
    """Length and compressed bytes: denser than what the shuffle does by itself."""
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unpacked(blob: pa.Scalar) -> np.ndarray:
    raw = blob.as_buffer()
    n = int.from_bytes(raw[:8].to_pybytes(), "little")
    return np.frombuffer(pa.decompress(raw.slice(8), n, codec="zstd"), np.uint8) if n else np.zeros(0, np.uint8)


#: Answers are fixed-point numbers of six bytes, in planes for the shuffle's compression: log10 p above -16 to 2 ** -44.
_POINT = float(1 << 44)


def _pack_logs(values: np.ndarray) -> bytes:
    return _packed(np.round(-values * _POINT).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes())


def _unpack_logs(blob: pa.Scalar) -> np.ndarray:
    raw = _unpacked(blob)
    planes = raw.reshape(6, len(raw) // 6)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return out.view("<u8").ravel() / -_POINT


def _pairs(table, keys: str = "h", n: str = "n") -> tuple[np.ndarray, np.ndarray]:
    return _sum_by_key([(_unpack(a), _unpacked(b).view(np.int64)) for a, b in zip(table.column(keys), table.column(n))])


def _spread_words(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by bucket, where each bucket starts in it) of word hashes."""
    bucket = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


_SPREAD = (_spread, _spread_words)


def _first_row() -> int:
    """Where the numbers of this task's rows start; the same when the task is rerun."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 40
