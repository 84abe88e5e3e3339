"""Changes out of streams: versions in, differences out by keyed state; and a store's change log as a stream.

``emit_changes`` keeps, for each document, its version, the hash of its source
and a hash for each block, and emits what each next version changes.
``follow`` streams a store's commit markers: each micro-batch is the changes
of a run of commits, and the stream's own checkpoint is the cursor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioflow import schemas as S
from folioflow.errors import ResyncRequired
from folioflow.sources.storage import Store
from folioflow.streaming.feed import run_batches

#: State of many keys and maps lives in RocksDB, not on the heap.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
EMITTED = "document_id {}, version int, previous_version int, added array<string>, updated array<string>, removed array<string>, conflict string"
MARKER = "n bigint, batch string, tables array<string>, first_seq bigint, last_seq bigint"


class _Differ(StatefulProcessor):
    """State of one document: its head (version, source hash) and its blocks (id to order and hash)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "version int, source_hash string")
        self.held = handle.getMapState("held", "block_id string", "ord int, hash bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given = sorted(((int(v), h, b) for part in rows for v, h, b in zip(part["version"], part["source_hash"], part["blocks"])), key=lambda r: r[0])
        out = []
        for version, source, blocks in given:
            last = self.head.get()[0] if self.head.exists() else 0
            if version != last + 1:  # a version that is there already, or one whose predecessor is not
                out.append((key[0], version, last or None, [], [], [], "late" if version <= last else "gap"))
                continue
            old = {k[0]: (v[0], v[1]) for k, v in self.held.iterator()} if last else {}
            new = {b["block_id"]: (b["ord"], b["hash"]) for b in sorted(blocks, key=lambda b: b["ord"])}
            added, updated = [k for k in new if k not in old], [k for k, v in new.items() if k in old and v[1] != old[k][1]]
            removed = sorted((k for k in old if k not in new), key=lambda k: (old[k][0], k))
            for k in removed:
                self.held.removeKey((k,))
            for k in (*added, *updated):
                self.held.updateValue((k,), new[k])
            self.head.update((version, source))
            out.append((key[0], version, last or None, added, updated, removed, None))
        frame = pd.DataFrame(out, columns=["document_id", "version", "previous_version", "added", "updated", "removed", "conflict"])
        yield frame.astype({"version": "int32", "previous_version": "Int32"})

    def close(self) -> None:
        pass


def version_rows(blocks: DataFrame, versions: DataFrame, fields: list[str]) -> DataFrame:
    """document_id, version, source_hash, blocks (block_id, ord, hash of ``fields``): a row a version, as :func:`emit_changes` takes them.

    Versions without blocks have an empty list.
    """
    own = blocks.groupBy("document_id", "version").agg(F.collect_list(F.struct("block_id", F.col("ord").cast("int").alias("ord"), F.xxhash64(*fields).alias("hash"))).alias("blocks"))
    none = F.array().cast("array<struct<block_id: string, ord: int, hash: bigint>>")
    return versions.select("document_id", "version", "source_hash").join(own, ["document_id", "version"], "left").withColumn("blocks", F.coalesce("blocks", none))


def emit_changes(stream: DataFrame) -> DataFrame:
    """A stream of versions (see :func:`version_rows`) as change rows (``EMITTED``), append mode.

    Versions of a document that come in one micro-batch are taken in order; a
    version that does not follow the one before is emitted with its conflict
    (``late`` or ``gap``) and changes nothing.  The session must name the
    RocksDB state store (``STATE_STORE``).
    """
    kind = stream.schema["document_id"].dataType.simpleString()
    rows = stream.select("document_id", F.col("version").cast("int").alias("version"), "source_hash", "blocks")
    return rows.groupBy("document_id").transformWithStateInPandas(statefulProcessor=_Differ(), outputStructType=T.StructType.fromDDL(EMITTED.format(kind)), outputMode="Append", timeMode="None")


def follow(store: Store, apply: Callable[[DataFrame, int], None], checkpoint: str, max_commits: int = 100, timeout: float | None = None) -> None:
    """Hand the store's changes to ``apply`` (rows with seq, number of the micro-batch), from where ``checkpoint`` stands to the last commit.

    A micro-batch holds the changes of at most ``max_commits`` whole commits.
    Markers are created once and never changed, so each change comes in one
    micro-batch; one that failed comes again with the same number and the same
    rows.  A checkpoint of another store raises ResyncRequired: its consumer
    starts anew.
    """
    spark, own = store.spark, f"{checkpoint}/_store.json"
    if store._fs.exists(store._path(own)):
        if (of := store._read(own)["id"]) != store.id:
            raise ResyncRequired(f"the checkpoint follows store {of}, this is {store.id}")
    else:
        store._create(own, {"id": store.id})
    if not store.commits():
        return
    markers = spark.readStream.schema(MARKER).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", max_commits).json(f"{store.root}/_commits")

    def step(df: DataFrame, n: int) -> None:
        commits = [r.asDict() for r in df.orderBy("n").collect()]  # max_commits at most
        apply(store.read("change_log", S.CHANGES, commits), n)

    run_batches(markers, step, f"{checkpoint}/stream", timeout)
