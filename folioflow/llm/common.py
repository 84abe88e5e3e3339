"""Shared pieces of the corpus operators: tables, durable cut points, byte-level text.

Text work is vectorised over the UTF-8 buffers that Arrow hands over, in
slices of a few MB, so a task's memory does not follow its partition's size.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
SLICE_BYTES = 1 << 20
#: Rows up to which a column of ids (8 bytes each) may be broadcast.
BROADCAST_IDS = 200_000


#: Rows of an Arrow batch of whole texts, where the session has no choice of its own.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's.

    Whole texts want small Arrow batches: where the session leaves
    ``maxRecordsPerBatch`` at its default, it is set to ``BATCH_ROWS`` for the
    session.  Operators themselves change no setting.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # the default
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; one of our own only in a local session where none is named (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(sc, "_folio_shared"):
        sc._folio_shared = "file://" + tempfile.mkdtemp(prefix="folio-shared-")
    return sc._folio_shared


_workspace: ContextVar[str | None] = ContextVar("workspace", default=None)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Tables written within are deleted at the end, but for those to ``keep``."""
    path = f"{shared_dir(spark)}/folio/work-{uuid.uuid4().hex[:12]}"
    token = _workspace.set(path)
    try:
        yield
    finally:
        _workspace.reset(token)
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str, codec: str = "snappy", keep: bool = False) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    root = _workspace.get() if not keep else None
    path = f"{root or shared_dir(spark) + '/folio'}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(*frames: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote and that nothing reads any more."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            if "/folio/" in file:
                _delete(df.sparkSession, os.path.dirname(file))


# --- text as bytes ------------------------------------------------------------

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]  # A-Z as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        up, down = np.full(n, _BASE), np.full(n, _INVERSE)
        up[0] = down[0] = 1
        fresh = np.cumprod(up), np.cumprod(down)
        if n > 4 * SLICE_BYTES:  # a giant text: do not keep its tables
            return fresh
        _powers = fresh
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def trim() -> None:
    """Give freed memory back: workers live on between tasks, and executors count what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def row_slices(raw: np.ndarray, at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``limit`` bytes: (first, after, bytes, offsets from 0)."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes of text: (rows, their bytes, offsets from 0)."""
    for lo, hi, raw, at in row_slices(*utf8(batch.column(text)), limit):
        yield batch.slice(lo, hi - lo), raw, at
    trim()


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between separators, A-Z lowered: (64-bit hash, row, first byte, byte after) of each.

    Every text starts at an offset in ``at``; no word crosses one.  A word's
    hash is a random polynomial of its bytes, read off one running sum.
    """
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z, z, z
    inside = ~SEPARATOR[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], out=total[1:])
    h = mix((total[b] - total[a]) * down[a])
    return h, np.searchsorted(at, a, "right") - 1, a, b


#: Byte class of words: ASCII letters and digits and every byte of a multi-byte character.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
BYTE_CODE = np.random.default_rng(7).integers(1, 2**63, 257, np.uint64)


def bag(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts: (hash, row, first byte, byte after) of each, A-Z lowered."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z, z, z
    inside = _WORD[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODE[LOWER[raw]] * up[:n], out=total[1:])
    return mix((total[b] - total[a]) * down[a]), np.searchsorted(at, a, "right") - 1, a, b


def shingles(h: np.ndarray, row: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words with their row; a row with fewer words is one run."""
    if not len(h):
        return h, row
    factor = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    m = max(0, len(h) - width + 1)
    run = np.zeros(m, np.uint64)
    for i in range(width):
        run += h[i : i + m] * factor[i]
    whole = row[:m] == row[width - 1 :] if m else np.zeros(0, bool)
    out, of = mix(run[whole]), row[:m][whole]
    count = np.bincount(row, minlength=rows)
    if len(short := np.flatnonzero((count > 0) & (count < width))):
        start = np.concatenate([[0], np.cumsum(count)])
        extra = []
        for r in short:
            part = h[start[r] : start[r + 1]]
            extra.append((part * factor[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part)))
        out, of = np.concatenate([out, mix(np.array(extra, np.uint64))]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def short_runs(h: np.ndarray, n: int, width: int) -> np.ndarray:
    """Runs of n < ``width`` words, hashed as :func:`shingles` hashes a text of n words."""
    m = max(0, len(h) - n + 1)
    whole = np.full(m, n, np.uint64)
    factor = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    for i in range(n):
        whole += h[i : i + m] * factor[i]
    return mix(whole)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c.cast(t) for c, t in zip(columns, schema.types)], schema=schema)


def binaries(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


#: Keys that hold more than one in so many rows are fewer than that and may be broadcast.
HEAVY = 10_000


def heavy_keys(counted: DataFrame, keys: list[str], least: int, share: int = HEAVY) -> DataFrame:
    """The keys of ``counted`` (keys, n) with more than one in ``share`` of all rows, and more than ``least``: fewer than ``share``."""
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return materialize(counted.where(F.col("n") > max(least, total // share)).select(*keys, "n"), "heavy")


def on_keys(rows: DataFrame, table: DataFrame, keys: list[str], heavy: DataFrame) -> DataFrame:
    """``rows`` joined to ``table`` (one row a key): the heavy keys where the rows are read, the others by a shuffle."""
    few = F.broadcast(heavy.select(*keys))
    return rows.join(F.broadcast(table.join(few, keys)), keys).unionByName(rows.join(few, keys, "left_anti").join(table, keys))


def without(docs: DataFrame, gone: DataFrame, digest: Column, name: str, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows of ``gone`` (doc_id, ``name``): those of one id and of one text, whose digest ``digest`` is.

    Null ids are equal to each other here; broadcast only while the rows are few.
    """
    gone = materialize(gone.select(F.col("doc_id").alias("_gone_id"), F.col(name).alias("_gone_digest")).distinct(), "dropped")
    if gone.count() <= BROADCAST_IDS:
        gone = gone.hint("broadcast")
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("_gone_id")) & (digest == F.col("_gone_digest")), "left_anti")
