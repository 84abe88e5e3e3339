"""Append-only tables with a commit log, and durable cut points.

A store is a folder of Parquet batches and numbered commit markers.  Data is
written first, under a batch id; creating the next marker publishes it.  The
marker is created exclusively through Hadoop's file system, so of two writers
with the same number one fails; :func:`retried` reads again and tries once
more.  Object stores do not create exclusively: there a store needs a single
writer.  Readers see only batches that markers name.  Every ``MANIFEST``
commits a manifest sums up the markers since the one before, so a reader
opens a hundredth of the markers and the few after the last manifest.

Rows lie sorted by their key (document, or asset hash) in ranges, and each
batch has an index of its files: least and greatest key and a Bloom filter of
the keys.  Point reads open only the files that may hold their key.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.errors import AssetNotFound, DocumentNotFound, StoreConflict, VersionNotFound

FORMAT, MANIFEST = 2, 100
#: A file's Bloom filter: bits, and hashes of a key.
BLOOM_BITS, BLOOM_HASHES = 32768, 2
INDEX = "name string, file string, low string, high string, bloom binary"


def retried(attempt: Callable[[], object]) -> object:
    """``attempt``, once more after a conflict; what it reads it reads again."""
    try:
        return attempt()
    except StoreConflict:
        return attempt()


def shared_path(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is set (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="folio-checkpoint-"))
    return named or sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    sc = df.sparkSession.sparkContext
    where = shared_path(df.sparkSession)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder: for many rows, which take a fraction of a checkpoint's bytes so."""
    where = f"{shared_path(df.sparkSession)}/folio-table-{uuid.uuid4().hex[:12]}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def _bit(key, k: int):
    """Position (from 0) of a key's ``k``-th bit in a file's Bloom filter."""
    return F.pmod(F.xxhash64(F.lit(k), key), F.lit(BLOOM_BITS))


class Store:
    TABLES = ("versions", "pages", "blocks", "regions", "assets", "change_log")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        meta = f"{self.root}/_meta.json"
        if not self._fs.exists(self._path(meta)):
            try:
                self._create(meta, {"format": FORMAT, "id": uuid.uuid4().hex})
            except StoreConflict:
                pass
        about = self._read(meta)
        if (found := about["format"]) != FORMAT:
            raise ValueError(f"store has format {found}, this reads {FORMAT}: delete it and ingest again")
        self.id = about["id"]

    def _create(self, path: str, value: dict) -> None:
        try:
            out = self._fs.create(self._path(path), False)  # fails where the file exists
        except Exception as e:
            raise StoreConflict(path) from e
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def _read(self, path: str) -> dict:
        stream = self._fs.open(self._path(path))
        data = bytes(stream.readAllBytes())
        stream.close()
        return json.loads(data)

    def commits(self) -> list[dict]:
        """Markers in order: n, batch, tables, first_seq, last_seq."""
        folder = self._path(f"{self.root}/_commits")
        if not self._fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder))
        sums = [n for n in names if n.endswith(".sum")]
        known = [c for n in sums for c in self._read(f"{folder}/{n}")["commits"]]
        return known + [self._read(f"{folder}/{n}") for n in names if n.endswith(".json") and int(n[:12]) > len(known)]

    def read(self, name: str, schema: str, commits: list[dict] | None = None) -> DataFrame:
        """All rows of a table; ``commits`` as :meth:`commits` gave them, to read from one state."""
        batches = [c["batch"] for c in (self.commits() if commits is None else commits) if name in c["tables"]]
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/batch={b}" for b in batches])

    # --- write ---------------------------------------------------------------

    @staticmethod
    def _key(df: DataFrame) -> str | None:
        return next((c for c in ("document_id", "asset") if c in df.columns), None)

    def heads(self, schema: str, ids: DataFrame) -> DataFrame:
        """The latest versions rows of the documents ``ids`` (document_id), from the files whose ranges meet theirs."""
        low, high = ids.agg(F.min("document_id"), F.max("document_id")).first()
        if low is None:
            return self.spark.createDataFrame([], schema)
        known = self._files("versions", schema, lambda i: i.where((F.col("high") >= low) & (F.col("low") <= high)))
        rest = [c for c in known.columns if c not in ("document_id", "version")]
        own = known.join(ids.select("document_id").distinct(), "document_id", "left_semi")
        return own.groupBy("document_id").agg(F.max(F.struct("version", *rest)).alias("s")).select("document_id", "s.*").select(*known.columns)

    def commit(self, frames: dict[str, DataFrame], changes: DataFrame, log_schema: str, check: Callable[[], None] | None = None) -> tuple[int, int]:
        """Publish the frames and the change rows (without seq) as one batch; returns its first and last seq.

        A document's changes follow its stored latest version without a gap
        or a repeat, each one's previous version being the one before, and
        ``versions``, where given, names the same ones.  ``check`` raises
        where more is wrong.  What fails before its marker is there leaves
        nothing that readers see; its files are deleted, or swept later where
        the driver is lost.
        """
        from pyspark.sql import Window as W

        commits = self.commits()
        last = commits[-1]["last_seq"] if commits else 0
        changes = checkpointed(changes)
        own = changes.select("document_id", "version", "previous_version")
        log = self._overlapping("change_log", log_schema, own)
        current = log.groupBy("document_id").agg(F.max("version").alias("_latest"))
        w = W.partitionBy("document_id").orderBy("version")
        run = own.join(current, "document_id", "left").withColumn("_before", F.coalesce(F.lag("version").over(w), F.col("_latest")))
        wrong = run.where("version <> coalesce(_before, 0) + 1 OR NOT (previous_version <=> _before)").select("document_id")
        if "versions" in frames:
            given = frames["versions"].groupBy("document_id", "version").agg(F.count("*").alias("_n"))
            both = given.join(own.withColumn("_there", F.lit(True)), ["document_id", "version"], "full_outer")
            wrong = wrong.union(both.where("NOT coalesce(_n = 1 AND _there, false)").select("document_id"))
        if (found := wrong.first()) is not None:
            raise StoreConflict(f"version: {found['document_id']}")
        if check is not None:
            check()
        batch = uuid.uuid4().hex
        # numbers in order of id and version: sorted runs and their sizes, no single task for all rows
        order = ["document_id", "version"]
        ranged = changes.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
        ranged = checkpointed(ranged.withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy(*order))))
        sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size")).collect()  # a row per partition
        offset, offsets = last, []
        for r in sorted(sizes, key=lambda r: r["_part"]):
            offsets.append((r["_part"], offset))
            offset += r["_size"]
        numbered = ranged.join(F.broadcast(self.spark.createDataFrame(offsets or [(-1, 0)], "_part int, _offset bigint")), "_part").withColumn("seq", F.col("_offset") + F.col("_n"))
        frames = {**frames, "change_log": numbered.select(*[c.strip().split(" ")[0] for c in _top_level(log_schema)])}
        try:
            for name, df in frames.items():
                key = self._key(df)
                df = df.repartitionByRange(key).sortWithinPartitions(key) if key else df
                df.write.parquet(f"{self.root}/{name}/batch={batch}")
            self._index(frames, batch)
            made = {"n": len(commits) + 1, "batch": batch, "tables": sorted(frames), "first_seq": last + 1, "last_seq": offset}
            self._create(f"{self.root}/_commits/{made['n']:012d}.json", made)
        except BaseException:
            self._delete(batch)
            raise
        if made["n"] % MANIFEST == 0:
            try:
                self._create(f"{self.root}/_commits/{made['n']:012d}.sum", {"commits": [*commits, made][-MANIFEST:]})
            except StoreConflict:  # someone else has summed up the same markers
                pass
        return last + 1, offset

    def _delete(self, batch: str) -> None:
        for name in (*self.TABLES, "_index"):
            self._fs.delete(self._path(f"{self.root}/{name}/batch={batch}"), True)

    def sweep(self, age: float = 7 * 86_400) -> list[str]:
        """Delete batches that no marker names and that began more than ``age`` seconds ago; returns them.

        They are left by drivers lost in mid-commit.  ``age`` must outlast any
        commit that is still under way.
        """
        known = {c["batch"] for c in self.commits()}
        stale = set()
        for name in (*self.TABLES, "_index"):
            folder = self._path(f"{self.root}/{name}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                batch = s.getPath().getName().removeprefix("batch=")
                if batch not in known and s.getModificationTime() <= (time.time() - age) * 1000:
                    stale.add(batch)
        for batch in stale:
            self._delete(batch)
        return sorted(stale)

    # --- the index of files --------------------------------------------------

    def _index(self, frames: dict[str, DataFrame], batch: str) -> None:
        rows = None
        for name, df in frames.items():
            if (key := self._key(df)) is None:
                continue
            keys = self.spark.read.schema(f"`{key}` string").parquet(f"{self.root}/{name}/batch={batch}")
            keys = keys.select(F.col("_metadata.file_name").alias("file"), F.col(key).alias("key")).distinct()
            bits = keys.select("*", F.explode(F.array(*[_bit(F.col("key"), k) for k in range(BLOOM_HASHES)])).alias("bit"))
            own = bits.groupBy("file").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.bitmap_construct_agg("bit").alias("bloom"))
            own = own.select(F.lit(name).alias("name"), F.concat(F.lit(f"{name}/batch={batch}/"), "file").alias("file"), "low", "high", "bloom")
            rows = own if rows is None else rows.unionByName(own)
        if rows is not None:
            rows.coalesce(1).write.parquet(f"{self.root}/_index/batch={batch}")  # a row a file

    def _files(self, name: str, schema: str, chosen: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A table's rows from the files that ``chosen`` keeps of the index; the driver sees their names alone."""
        batches = [c["batch"] for c in self.commits() if name in c["tables"]]
        if not batches:
            return self.spark.createDataFrame([], schema)
        index = self.spark.read.schema(INDEX).parquet(*[f"{self.root}/_index/batch={b}" for b in batches])
        files = [r["file"] for r in chosen(index.where(F.col("name") == name)).select("file").collect()]
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in sorted(files)])

    def _overlapping(self, name: str, schema: str, ids: DataFrame) -> DataFrame:
        low, high = ids.agg(F.min("document_id").cast("string"), F.max("document_id").cast("string")).first()
        if low is None:
            return self.spark.createDataFrame([], schema)
        return self._files(name, schema, lambda i: i.where((F.col("high") >= low) & (F.col("low") <= high))).join(ids.select("document_id").distinct(), "document_id", "left_semi")

    def keyed(self, name: str, schema: str, key: str, value: str) -> DataFrame:
        """A table's rows whose ``key`` is ``value``, from the files that may hold it."""
        bit = lambda k: F.getbit(F.conv(F.hex(F.substring("bloom", (F.floor(_bit(F.lit(value), k) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint"), F.pmod(_bit(F.lit(value), k), F.lit(8)).cast("int")) == 1
        there = F.lit(True)
        for k in range(BLOOM_HASHES):
            there = there & bit(k)
        return self._files(name, schema, lambda i: i.where((F.lit(value) >= F.col("low")) & (F.lit(value) <= F.col("high")) & there)).where(F.col(key) == value)

    # --- point reads ---------------------------------------------------------

    def _version(self, document_id: str, version: int | None, schema: str) -> int:
        known = self.keyed("versions", schema, "document_id", document_id)
        top, there = known.agg(F.max("version"), F.max((F.col("version") == version if version is not None else F.lit(True)).cast("int"))).first()
        if top is None:
            raise DocumentNotFound(f"document not found: {document_id}")
        if not there:
            raise VersionNotFound(f"version not found: {document_id} {version}")
        return top if version is None else version

    def rows(self, name: str, schema: str, versions: str, document_id: str, version: int | None = None) -> DataFrame:
        """A table's rows of one document's given or latest version; NotFound tells a missing document from a missing version."""
        at = self._version(document_id, version, versions)
        return self.keyed(name, schema, "document_id", document_id).where(F.col("version") == at)

    def asset(self, key: str, schema: str) -> bytes:
        row = self.keyed("assets", schema, "asset", key).first()
        if row is None:
            raise AssetNotFound(f"asset not found: {key}")
        return bytes(row["bytes"])


def _top_level(ddl: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in ddl:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]
