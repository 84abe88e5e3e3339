"""Token counts of sections from one encoding of each whole document.

A document is encoded once; the tokens' byte lengths give their spans, and
the sections' spans are joined to them by one binary search per section
boundary.  A token that crosses a boundary goes, by the explicit rule, to the
section that holds its first byte; ``crossing`` counts the tokens that a
section holds although they end in a later one.  Section counts so always add
up to the document's count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import batch_of, slices
from folioflow.llm.tokens import encoder

SCHEMA = "doc_id bigint, section bigint, start_byte bigint, end_byte bigint, n_tokens bigint, crossing bigint, doc_tokens bigint"


def line_sections(raw: np.ndarray) -> np.ndarray:
    """First bytes of the sections: each line with its line feed is one; an empty text has one."""
    cuts = np.flatnonzero(raw == 0x0A) + 1
    return np.concatenate([[0], cuts[cuts < len(raw)]]).astype(np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (byte spans, in order) to sections (first bytes, from 0): counts and crossing tokens."""
    last = np.append(first[1:], total)
    lo = np.searchsorted(starts, first, "left")
    hi = np.searchsorted(starts, last, "left")
    hi[-1] = len(starts)
    crossing = np.zeros(len(first), np.int64)
    some = hi > lo  # only a section's last token can end beyond it
    crossing[some] = ends[hi[some] - 1] > last[some]
    return hi - lo, crossing


def section_token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections=line_sections, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """One row per section of each document, in no particular order.

    ``sections`` maps a text's bytes to the first bytes of its sections.
    Null text counts as empty: one section without tokens.  Null ids stay
    null, repeated rows are counted each, other columns are ignored, an empty
    table gives an empty result.  No shuffle.
    """

    def run(batches):
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "section", "start_byte", "end_byte", "n_tokens", "crossing", "doc_tokens")])
        encode = encoder(tokenizer)
        for batch in batches:
            for part, raw, at in slices(batch, "text"):
                of, cols = [], [[] for _ in range(6)]
                for r in range(len(part)):
                    own = raw[at[r] : at[r + 1]]
                    ends = np.cumsum(encode.lengths[encode(own.tobytes().decode())])
                    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                    first = sections(own)
                    n, crossing = attribute(starts, ends, first, len(own))
                    of.append(np.full(len(first), r))
                    for c, v in zip(cols, (np.arange(len(first)), first, np.append(first[1:], len(own)), n, crossing, np.full(len(first), len(ends)))):
                        c.append(v)
                if of:
                    yield batch_of(schema, part.column("doc_id").take(pa.array(np.concatenate(of))), *(np.concatenate(c) for c in cols))

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
