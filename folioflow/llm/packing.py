"""Packing by powers of two: no padding and no sequence with two documents.

A document of n ids (its text's, then the end id) is cut into as many full
pieces of ``size`` ids as fit and the binary digits of the rest, largest
first.  Every piece is a sequence of its own whose length is a power of two,
so sequences of one bucket (equal length) batch without padding.  No state
crosses rows: there is no shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import batch_of, slices
from folioflow.llm.tokens import encoder

SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, bucket int, ids binary"


def pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the power-of-two pieces of n ids, longest first."""
    out = [(i * size, size) for i in range(n // size)]
    at, rest = n // size * size, n % size
    while rest:
        take = 1 << (rest.bit_length() - 1)
        out.append((at, take))
        at, rest = at + take, rest - take
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 0, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece; ``ids`` holds its little-endian unsigned 32-bit ids.

    ``bucket`` is log2 of the length.  ``sequence_id`` is unique: the input
    partition and the piece's place in it, the same again when a task is
    rerun.  Null text counts as empty and gives the end id alone; a null
    doc_id stays null; repeated rows are packed each; other columns are
    ignored; an empty table gives an empty result.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")

    def run(batches):
        from pyspark import TaskContext

        schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")), ("bucket", pa.int32()), ("ids", pa.binary())])
        encode, serial = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, raw, at in slices(batch, "text"):
                data, of, start, length, total, ids = raw.tobytes(), [], [], [], [], []
                for r in range(len(part)):
                    own = np.append(encode(data[at[r] : at[r + 1]].decode()), np.uint32(end_id)).astype("<u4")
                    cut = pieces(len(own), size)
                    of += [r] * len(cut)
                    total += [len(own)] * len(cut)
                    start += [a for a, _ in cut]
                    length += [n for _, n in cut]
                    ids += [own[a : a + n].tobytes() for a, n in cut]
                n = len(of)
                yield batch_of(schema, part.column("doc_id").take(pa.array(of, pa.int64())), start, length, total, np.arange(serial, serial + n), np.zeros(n, np.int64), np.log2(np.array(length, float)).astype(np.int32), ids)
                serial += n

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
