"""Near-duplicate groups from bottom-k sketches of one hash function.

1. One Arrow pass makes each text's shingle set: its size, a 128-bit
   fingerprint and the ``k`` smallest hashes (the sketch).
2. Equal sets become one class, a node, named by its smallest id.
3. Inverted lists of the ``index`` smallest retained values give overlaps.
   Two sets with Jaccard J share none of those values with probability about
   (1 - J) ** index: 3e-7 at 0.85 and index 8.  Sets of up to ``index``
   shingles are listed whole.
4. Each list first links its members to its smallest one.  Lists whose
   members are then all connected are done, so a group of n copies costs n
   pairs, not n**2.
5. What remains in short lists meets where the list is read, sketch against
   sketch; only pairs that may be links leave the task.  The members of long
   lists (a passage that many texts share) are listed again under all
   retained values, rarest first, and only as many of them as a link can
   avoid (the prefix filter).  Lists that are still long are compared in
   blocks of sketches, split by size; a task emits a forest.  Texts are read
   only where a sketch leaves the answer open (:meth:`NearDuplicates._dense`).
6. A pair is kept when the sketch of the union admits the wanted overlap
   (six standard deviations below it) and sizes allow it, and is a link when
   the exact Jaccard of the two full sets says so.  Components of the links
   are the groups.

Lists that hold more than 1/``HEAVY`` of all entries, fewer than ``HEAVY`` by
that bound, are joined where their entries are read.  No list, block or group
has a cap: all remaining members are compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import common
from folioflow.llm.common import BROADCAST_IDS, batch_of, binaries, drop_materialized, materialize, shingles, slices, trim, words
from folioflow.llm.components import components

#: Members up to which a list is compared where it is read.
SHORT_LIST = 48
#: Members of a block of sketches and of one of full sets.
SKETCHES, BLOCK = 1024, 256
#: See :data:`folioflow.llm.common.HEAVY`.
HEAVY = common.HEAVY
#: Partners that share one copy of a text.
FAN = 64
#: Pairs of a vectorised estimate.
PAIRS = 2048


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    rows = len(at) - 1
    h, row, _, _ = words(raw, at)
    s, of = shingles(h, row, rows, width)
    bounds = np.searchsorted(of, np.arange(rows + 1))
    return [np.unique(s[bounds[i] : bounds[i + 1]]) for i in range(rows)]


def _signatures(batches, width: int, k: int, index: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("low", pa.list_(pa.int64())), ("sketch", pa.binary())])
    for batch in batches:
        for part, raw, at in slices(batch, "text"):
            sets = shingle_sets(raw, at, width)
            f1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            f2 = np.array([np.bitwise_xor.reduce(s * np.uint64(0xA0761D6478BD642F) ^ (s >> np.uint64(29))) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            yield batch_of(
                schema, part.column("doc_id"), part.column("text_hash"), [len(s) for s in sets], f1, f2, [s[:index].view(np.int64) for s in sets], binaries([s[:k].tobytes() for s in sets])
            )


def _least_shared(n: int, k: int, percent: int) -> int:
    """Sketch values that a set of n shingles shares with any set linked to it.

    Exact while the partner's sketch is its whole set; else six standard
    deviations below the mean of the union sketch's overlap.
    """
    j = percent / 100
    if n <= math.floor(k * j):
        return -(-percent * n // 100)
    return math.floor(k * j - 6 * math.sqrt(k * j * (1 - j)))


class Sketches:
    """Sketches of a batch as a matrix, and the estimates of pairs of its rows."""

    def __init__(self, column: pa.Array, n: np.ndarray, k: int, percent: int):
        self.n, self.k, self.percent = n, k, percent
        kept = [np.frombuffer(x.as_buffer(), np.uint64) for x in column]
        self.held = np.array([len(x) for x in kept], np.int64)
        self.values = np.concatenate([np.zeros(0, np.uint64), *kept])
        self.rows = np.repeat(np.arange(len(kept)), self.held)
        self.matrix = np.zeros((len(kept), k), np.uint64)
        self.matrix[np.arange(k)[None, :] < self.held[:, None]] = self.values

    def may_link(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether sizes and the union's sketch leave room for a link, whether that is exact, shared values) of each pair."""
        k, top, place = self.k, np.iinfo(np.uint64).max, np.arange(self.k, dtype=np.uint64)
        ok, shared = np.zeros(len(x), bool), np.zeros(len(x), np.int64)
        sure = (self.n[x] <= k) & (self.n[y] <= k)
        least = _least_shared(1 << 40, k, self.percent)
        for lo in range(0, len(x), PAIRS):
            p, q = x[lo : lo + PAIRS], y[lo : lo + PAIRS]
            a = np.where(place[None, :] < self.held[p][:, None], self.matrix[p], top - 2 * place)
            b = np.where(place[None, :] < self.held[q][:, None], self.matrix[q], top - 2 * place - np.uint64(1))
            both = np.concatenate([a, b], 1)
            both.sort(1)
            twin = both[:, 1:] == both[:, :-1]
            rank = np.arange(twin.shape[1]) - np.cumsum(twin, 1) + twin  # distinct values before the twin's first
            exact = sure[lo : lo + PAIRS]
            got = np.where(exact, twin.sum(1), (twin & (rank < k)).sum(1))
            na, nb = self.n[p], self.n[q]
            ok[lo : lo + PAIRS] = np.where(exact, 100 * got >= self.percent * (na + nb - got), got >= least) & (100 * np.minimum(na, nb) >= self.percent * np.maximum(na, nb))
            shared[lo : lo + PAIRS] = got
        return ok, sure, shared


def passes(a: np.ndarray, b: np.ndarray, na: int, nb: int, k: int, percent: int) -> bool:
    """Whether sizes and the union's sketch leave room for the wanted Jaccard of two sets."""
    sketches = Sketches(pa.array([a.tobytes(), b.tobytes()], pa.binary()), np.array([na, nb]), k, percent)
    return bool(sketches.may_link(np.array([0]), np.array([1]))[0][0])


def joining(ca: np.ndarray, cb: np.ndarray, root: dict | None = None) -> np.ndarray:
    """Of links between parts, in order, those that join two parts not joined yet; ``root`` carries on."""
    root = {} if root is None else root

    def find(x):
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    keep = np.zeros(len(ca), bool)
    for i, (p, q) in enumerate(zip(ca.tolist(), cb.tolist())):
        p, q = find(p), find(q)
        if p != q:
            root[max(p, q)] = min(p, q)
            keep[i] = True
    return keep


def shared_counts(values: np.ndarray, rows: np.ndarray, n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Values that the sets i and the sets j of n sets have in common, for each pair."""
    kinds, column = np.unique(values, return_inverse=True)
    often = np.bincount(column, minlength=len(kinds)) > 1
    number = np.cumsum(often) - 1
    held = often[column]
    row, column = rows[held], number[column[held]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(i), len(j)), np.float32)
    step = 1024
    for lo in range(0, int(often.sum()), step):
        p, q = np.searchsorted(column, [lo, lo + step])
        one = np.zeros((n, min(step, int(often.sum()) - lo)), np.float32)
        one[row[p:q], column[p:q] - lo] = 1
        shared += one[i] @ (one if len(j) == n else one[j]).T
    return shared


def links_between(link: np.ndarray, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links (a matrix over the rows a and the rows b) those that join two parts not joined yet; ``label`` names the parts and is kept up."""
    x, y = [], []
    for r in np.flatnonzero(link.any(1)):
        to = b[link[r]]
        parts, first = np.unique(label[to], return_index=True)
        for part, k in zip(parts.tolist(), first.tolist()):
            own = label[a[r]]
            if part != own:
                x.append(a[r])
                y.append(to[k])
                label[label == max(part, own)] = min(part, own)
    return np.array(x, np.int64), np.array(y, np.int64)


def forest(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, comp: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the sets i and the sets j that join parts not joined yet; ``comp`` names the parts so far."""
    size = np.array([len(s) for s in sets], np.int64)
    shared = shared_counts(np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), size), len(sets), i, j)
    link = (shared > 0) & (100 * shared >= percent * (size[i][:, None] + size[j][None, :] - shared))
    return links_between(link, i, j, np.unique(comp, return_inverse=True)[1])


class Open:
    """Pairs of the rows i and j of a batch in different parts that may be links, as matrices: certain, likely and other ones."""

    def __init__(self, sketches: Sketches, comp: np.ndarray, i: np.ndarray, j: np.ndarray):
        n, k, percent = sketches.n, sketches.k, sketches.percent
        shared = shared_counts(sketches.values, sketches.rows, len(n), i, j)
        na, nb = n[i][:, None], n[j][None, :]
        exact = (na <= k) & (nb <= k)
        self.i, self.j, self.label = i, j, np.unique(comp, return_inverse=True)[1]
        room = (shared > 0) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
        self.certain = room & exact & (100 * shared >= percent * (na + nb - shared))
        self.forest = links_between(self.certain, i, j, self.label)
        # what certain links have joined needs no estimate
        room &= ~exact & (shared >= _least_shared(1 << 40, k, percent)) & (self.label[i][:, None] != self.label[j][None, :])
        self.other, self.likely = np.zeros(room.shape, bool), np.zeros(room.shape, bool)
        p, q = np.nonzero(room)
        for lo in range(0, len(p), 1 << 16):
            own = p[lo : lo + (1 << 16)], q[lo : lo + (1 << 16)]
            ok, _, got = sketches.may_link(i[own[0]], j[own[1]])
            self.other[own], self.likely[own] = ok, ok & (100 * got >= percent * k)

    def trees(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x, y, certain): a forest of certain links, then of likely pairs, then of the others."""
        found = [self.forest, *(links_between(m, self.i, self.j, self.label) for m in (self.likely, self.other))]
        sure = np.repeat([True, False, False], [len(x) for x, _ in found])
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]), sure

    def rows(self) -> np.ndarray:
        """The rows that have a pair without certainty."""
        return np.unique(np.concatenate([self.i[self.other.any(1)], self.j[self.other.any(0)]]))


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])


def _pair_batch(node: np.ndarray, x: np.ndarray, y: np.ndarray, sure: np.ndarray) -> pa.RecordBatch:
    return batch_of(_PAIR, np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), sure)


def _within_lists(batches, k: int, percent: int):
    """Sorted rows of short lists -> pairs that may be links; of the certain ones a forest."""
    rest, root = None, {}
    names = ("value", "node", "comp", "n")

    def compare(rows: pa.Table):
        value, node, comp, n = (rows.column(c).to_numpy() for c in names)
        sketches = Sketches(rows.column("sketch").combine_chunks(), n, k, percent)
        x, y = [], []
        for d in range(1, len(value)):
            at = np.flatnonzero(value[d:] == value[:-d])
            if not len(at):
                break
            at = at[comp[at] != comp[at + d]]
            x.append(at)
            y.append(at + d)
        if not x:
            return
        x, y = np.concatenate(x), np.concatenate(y)
        near = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
        low, high = np.minimum(node[x], node[y])[near], np.maximum(node[x], node[y])[near]
        _, once = np.unique(np.stack([low, high]), axis=1, return_index=True)  # two texts may share several lists
        x, y = x[near][once], y[near][once]
        ok, sure, _ = sketches.may_link(x, y)
        x, y, sure = x[ok], y[ok], sure[ok]
        keep = ~sure
        keep[sure] = joining(comp[x[sure]], comp[y[sure]], root)
        if keep.any():
            yield _pair_batch(node, x[keep], y[keep], sure[keep])

    for batch in batches:
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not len(rows):
            continue
        value = rows.column("value").to_numpy()
        done = int(np.flatnonzero(value == value[-1])[0])  # the last list may go on
        yield from compare(rows.slice(0, done))
        rest = rows.slice(done).combine_chunks()
        if len(root) > 1 << 20:  # a forest per stretch of the input
            root.clear()
        trim()
    if rest is not None and len(rest):
        yield from compare(rest)


def _verify(batches, width: int, percent: int):
    """Rows (a, turn, b, text) sorted, a's own text (b null) first -> the pairs that are links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    hub, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        for part, raw, at in slices(batch, "text"):
            a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
            found = []
            for i, s in enumerate(shingle_sets(raw, at, width)):
                if b[i] is None:
                    hub, own = a[i], s
                elif hub == a[i] and len(s) and len(own) and 100 * min(len(own), len(s)) >= percent * max(len(own), len(s)):
                    both = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum())
                    if both and 100 * both >= percent * (len(own) + len(s) - both):
                        found.append(i)
            if found:
                yield batch_of(schema, [a[i] for i in found], [b[i] for i in found])


def heavy_keys(counted: DataFrame, key: str, least: int) -> DataFrame:
    """The keys of ``counted`` (key, n) with more than one in ``HEAVY`` of all rows, and more than ``least``: fewer than ``HEAVY``."""
    return common.heavy_keys(counted, [key], least, HEAVY)


def on_value(rows: DataFrame, lists: DataFrame, heavy: DataFrame) -> DataFrame:
    """``rows`` with the columns of their list; the heavy lists are joined where the rows are read, the others by a shuffle."""
    return common.on_keys(rows, lists, ["value"], heavy)


class NearDuplicates:
    """Groups of near-duplicate texts of ``docs`` (id, text).

    Words are runs of other characters than blanks and U+0009..000D, with A-Z
    lowered.  Rows: every input row gives one row of the result.  Null or
    wordless text has an empty set and is linked with nothing.  A null id is
    linked with nothing and has a null component.  Repeated rows share their
    component; rows that repeat an id with another text belong each to the
    group of its own text.  Other columns of the input are ignored.  An empty
    table gives an empty result.
    """

    def __init__(self, width: int = 5, percent: int = 80, k: int = 64, index: int = 8):
        self.width, self.percent, self.k, self.index = width, percent, k, index

    def classes(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the text); a table of its own, all others are deleted."""
        with common.workspace(docs.sparkSession):
            return materialize(self._classes(docs, id_col, text_col), "classes", keep=True)

    def _classes(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        width, k, index = self.width, self.k, self.index
        self.docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
        made = self.docs.mapInArrow(lambda it: _signatures(it, width, k, index), "doc_id bigint, text_hash bigint, n_shingles bigint, f1 bigint, f2 bigint, low array<bigint>, sketch binary")
        made = materialize(made, "signatures")
        key = ["n_shingles", "f1", "f2"]
        sets = made.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(key).agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("low").alias("low"), F.first("sketch").alias("sketch"))
        self.nodes = materialize(sets.select(F.monotonically_increasing_id().alias("node"), *key, "rep.*", "low", "sketch"), "nodes")
        self.sketches = self.nodes.select("node", F.col("n_shingles").alias("n"), "sketch")
        labels = self._link(self.nodes.select("node", F.explode("low").alias("value")))
        named = self.nodes.select("node", *key, F.col("doc_id").alias("rep")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = named.join(named.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select(*key, "component_id")
        out = made.select("doc_id", "text_hash", *key).join(named, key, "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash")

    # --- candidate lists ---------------------------------------------------

    def _link(self, entries: DataFrame) -> DataFrame:
        lists = materialize(entries.groupBy("value").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1"), "lists")
        heavy = heavy_keys(lists, "value", SHORT_LIST)
        listed = materialize(on_value(entries, lists, heavy), "listed")
        star = materialize(listed.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "star")
        found = self._links(star)
        labels = components(found)
        # what the stars left apart
        at = materialize(listed.join(labels, "node", "left").select("value", "node", "n", F.coalesce("component", "node").alias("comp")), "labelled")
        apart = at.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("value")
        left = materialize(on_value(at, apart, heavy), "left")
        hot = materialize(left.where(F.col("n") > SHORT_LIST).select("node", "comp").distinct(), "hot")
        pairs, dense = self._within(left.where(F.col("n") <= SHORT_LIST)), None
        if not hot.isEmpty():
            rare, dense, dense_heavy = self._rare_first(hot)
            pairs = pairs.union(rare)
        pairs = materialize(pairs.distinct(), "pairs")
        checked = self._verified(pairs.where("NOT sure").select("a", "b").join(star, ["a", "b"], "left_anti"))
        found = materialize(found.union(pairs.where("sure").select("a", "b")).union(checked), "found")
        labels = components(found)
        drop_materialized(lists, listed, star, at, left, hot, pairs)
        if dense is None or dense.isEmpty():
            return labels
        return self._dense(dense, dense_heavy, found, labels)

    def _within(self, lists: DataFrame) -> DataFrame:
        """Pairs (a, b, sure) of members of short lists (value, node, comp) that may be links."""
        k, percent = self.k, self.percent
        rows = lists.select("value", "node", "comp").join(self.sketches, "node").select("value", "node", "comp", "n", "sketch")
        return rows.repartition("value").sortWithinPartitions("value").mapInArrow(lambda it: _within_lists(it, k, percent), "a bigint, b bigint, sure boolean")

    def _rare_first(self, hot: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The members of long lists, listed by their rarest values: pairs of short lists, the lists still long and the heavy ones."""
        k, percent = self.k, self.percent

        def spread(batches):
            schema = pa.schema([("node", pa.int64()), ("comp", pa.int64()), ("n", pa.int64()), ("value", pa.int64())])
            for batch in batches:
                values = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("sketch")]
                times = np.array([len(v) for v in values], np.int64)
                cols = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), times) for c in ("node", "comp", "n")]
                yield batch_of(schema, *cols, np.concatenate([np.zeros(0, np.int64), *values]))

        rows = hot.join(self.sketches, "node").select("node", "comp", "n", "sketch").mapInArrow(spread, "node bigint, comp bigint, n bigint, value bigint")
        rows = materialize(rows, "spread")
        often = materialize(rows.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "often")
        heavy = heavy_keys(often.withColumnRenamed("df", "n"), "value", SHORT_LIST)
        # per text: the shared values, rarest first, up to the prefix that a link cannot avoid
        per = on_value(rows, often, heavy).groupBy("node", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("vs"))
        kept = F.least(F.col("n"), F.lit(k))
        floor = F.when(F.col("n") <= math.floor(k * percent / 100), F.ceil(F.col("n") * percent / 100)).otherwise(_least_shared(1 << 40, k, percent))
        # values that no other text holds come first in the order and need no list
        length = F.greatest(F.lit(0), (kept - floor + 1) - (kept - F.size("vs")))
        listed = per.select("node", "comp", F.explode(F.slice("vs", F.lit(1), length.cast("int"))).alias("e")).select("node", "comp", F.col("e.value").alias("value"))
        listed = materialize(listed, "prefix")
        stats = listed.groupBy("value").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("n > 1 AND lo <> hi").select("value", "n")
        stats = materialize(stats, "prefixstats")
        heavy = heavy_keys(stats, "value", SHORT_LIST)
        joined = materialize(on_value(listed, stats, heavy), "prefixlists")
        drop_materialized(rows, often, listed, stats)
        return self._within(joined.where(F.col("n") <= SHORT_LIST)), joined.where(F.col("n") > SHORT_LIST), heavy

    # --- long lists ----------------------------------------------------------

    def _dense(self, dense: DataFrame, heavy: DataFrame, found: DataFrame, labels: DataFrame) -> DataFrame:
        """Components after comparing the members of long lists with each other.

        Lists that share members make a family, so no pair is compared once
        per list.  A task holds two blocks of sketches and emits a forest: of
        certain links, and of the likeliest open pairs, which are verified.
        Members that then still have an open pair between two groups are
        compared by their full sets, in smaller blocks.
        """
        k, percent = self.k, self.percent
        hubs = dense.groupBy("value").agg(F.min("node").alias("a"))
        families = components(on_value(dense.select("value", "node"), hubs, heavy).select("a", F.col("node").alias("b")))
        members = dense.select("node").distinct().join(families.withColumnRenamed("component", "family"), "node").join(self.sketches, "node")
        members = materialize(members, "members")

        def named(labels):
            return members.join(labels.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))

        def opened(group: pa.Table) -> tuple[np.ndarray, Open]:
            own, (node, comp, n) = group.column("own").to_numpy(), (group.column(c).to_numpy() for c in ("node", "comp", "n"))
            i, j = (np.flatnonzero(own == group.column(c).to_numpy()) for c in ("i", "j"))
            return node, Open(Sketches(group.column("sketch").combine_chunks(), n, k, percent), comp, i, j)

        def trees(group: pa.Table) -> pa.Table:
            node, pairs = opened(group)
            out = _pair_batch(node, *pairs.trees())
            del pairs
            trim()
            return pa.Table.from_batches([out])

        def still_open(group: pa.Table) -> pa.Table:
            node, pairs = opened(group)
            out = pa.table({"node": pa.array(node[pairs.rows()], pa.int64())})
            del pairs
            trim()
            return out

        columns = ["family", "i", "j", "own", "node", "comp", "n", "sketch"]
        pairs = self._blocks(named(labels), SKETCHES).select(columns).groupBy("family", "i", "j").applyInArrow(trees, "a bigint, b bigint, sure boolean")
        pairs = materialize(pairs.distinct(), "trees")
        found = found.union(pairs.where("sure").select("a", "b"))
        unsure = pairs.where("NOT sure").select("a", "b")
        if unsure.isEmpty():
            return components(found)
        found = found.union(self._verified(unsure))
        labels = components(found)
        rows = self._blocks(named(labels), SKETCHES).select(columns).groupBy("family", "i", "j").applyInArrow(still_open, "node bigint")
        last = materialize(rows.distinct(), "still")
        if last.isEmpty():
            return labels
        return components(found.union(self._by_sets(named(labels).join(last, "node"))))

    def _blocks(self, members: DataFrame, size: int) -> DataFrame:
        """``members`` (family, node, comp, n) once for every pair (i, j) of blocks, of sizes that a link allows, that theirs (``own``) is in."""
        band = F.floor(F.log("n") / F.lit(-math.log(self.percent / 100) * (1 + 1e-9)))  # linked sets lie at most one band apart
        members = members.withColumn("band", band)
        several = members.groupBy("family").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("family")
        cells = members.groupBy("family", "band").agg(F.ceil(F.count("*") / size).alias("blocks")).join(several, "family")
        cells = materialize(cells, "cells")
        near = cells.select("family", F.col("band").alias("beside"), F.col("blocks").alias("parts"))
        cells = cells.withColumn("beside", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).join(near, ["family", "beside"])
        cells = materialize(cells.groupBy("family", "band", "blocks").agg(F.collect_list(F.struct("beside", "parts")).alias("near")), "blocks")
        if cells.count() <= BROADCAST_IDS:
            cells = F.broadcast(cells)
        code = lambda band, block: band * F.lit(1 << 32) + block
        others = F.flatten(F.transform("near", lambda x: F.transform(F.sequence(F.lit(0), x["parts"] - 1), lambda b: code(x["beside"], b))))
        rows = members.join(cells, ["family", "band"]).withColumn("own", code(F.col("band"), F.pmod(F.xxhash64("node"), F.col("blocks")))).withColumn("other", F.explode(others))
        return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def _by_sets(self, members: DataFrame) -> DataFrame:
        """Links within families, full sets against full sets, a forest for each pair of blocks."""
        width, percent = self.width, self.percent
        members = materialize(members.select("family", "node", "comp", "n"), "open")
        texts = self._texts(members.select("node"))

        def compare(group: pa.Table) -> pa.Table:
            node, comp, own = (group.column(c).to_numpy() for c in ("node", "comp", "own"))
            sets = [s for batch in group.select(["text"]).combine_chunks().to_batches() for _, raw, at in slices(batch, "text") for s in shingle_sets(raw, at, width)]
            x, y = forest(sets, np.flatnonzero(own == group.column("i").to_numpy()), np.flatnonzero(own == group.column("j").to_numpy()), comp, percent)
            del sets
            trim()
            return pa.table({"a": pa.array(node[x], pa.int64()), "b": pa.array(node[y], pa.int64())})

        rows = self._blocks(members, BLOCK).select("family", "i", "j", "own", "node", "comp").join(texts, "node")
        return materialize(rows.groupBy("family", "i", "j").applyInArrow(compare, "a bigint, b bigint"), "dense")

    # --- pairs to links ----------------------------------------------------

    def _links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets reach the wanted Jaccard."""
        k, percent = self.k, self.percent
        sa = self.sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        sb = self.sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
        # sizes first: they are small, and most chance overlaps end there
        sized = pairs.join(sa.select("a", "na"), "a").join(sb.select("b", "nb"), "b").where(near).select("a", "b")

        def estimate(batches):
            for batch in batches:
                m = len(batch)
                a, b, na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "na", "nb"))
                sketches = Sketches(pa.concat_arrays([batch.column("sa"), batch.column("sb")]), np.concatenate([na, nb]), k, percent)
                ok, sure, _ = sketches.may_link(np.arange(m), np.arange(m, 2 * m))
                yield batch_of(_PAIR, a[ok], b[ok], sure[ok])
                trim()

        kept = sized.join(sa, "a").join(sb, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(estimate, "a bigint, b bigint, sure boolean")
        kept = materialize(kept, "estimated")
        return kept.where("sure").select("a", "b").union(self._verified(kept.where("NOT sure").select("a", "b")))

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b) those whose full sets reach the wanted Jaccard; a's text is sent once for ``FAN`` partners."""
        width, percent = self.width, self.percent
        pairs = materialize(pairs, "open")
        heavy = heavy_keys(pairs.groupBy("a").agg(F.count("*").alias("n")), "a", FAN)
        turns = F.ceil(F.coalesce("n", F.lit(1)) / FAN)
        pairs = pairs.join(F.broadcast(heavy), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), turns).alias("turn"))
        texts = self._texts(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node"))
        hubs = pairs.select("a", "turn").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "turn", F.lit(None).cast("bigint").alias("b"), "text")
        rows = hubs.union(pairs.join(texts.withColumnRenamed("node", "b"), "b").select("a", "turn", "b", "text"))
        rows = rows.repartition("a", "turn").sortWithinPartitions("a", "turn", F.col("b").asc_nulls_first())
        return materialize(rows.mapInArrow(lambda it: _verify(it, width, percent), "a bigint, b bigint"), "verified")

    def _texts(self, nodes: DataFrame) -> DataFrame:
        """(node, text), one row each; the ids are broadcast only while they are few."""
        ids = materialize(nodes.join(self.nodes.select("node", "doc_id", "text_hash"), "node"), "ids")
        if ids.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        return self.docs.join(ids, ["doc_id", "text_hash"]).select("node", "text").dropDuplicates(["node"])
