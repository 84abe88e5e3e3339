"""The byte-level BPE vocabulary, one encoder per worker process."""

from __future__ import annotations

import re

import numpy as np

#: Blanks in a row up to which ``tiktoken`` is given a text; its pattern recurses on them and fails beyond some 100,000.
SAFE_RUN = 50_000
_LONG_RUN = re.compile(r"\s{1000}\s*")
SPECIAL = "<|endoftext|>"
_encoders: dict = {}


class Encoder:
    """Ids of ``tokenizers`` for a byte-level BPE file, without added special tokens.

    The same merges as ranks run several times faster in ``tiktoken``; texts
    that spell the special token, which ``tokenizers`` reads as one id, go to
    ``tokenizers`` itself, and so do texts with very long runs of blanks.
    """

    def __init__(self, name: str = "byte_bpe_50k"):
        import base64

        import public_tokenizers as P
        import tiktoken

        self.json = P.path(f"{name}.json")
        with open(P.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 2, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.lengths[-1] = len(SPECIAL)
        self.slow = None

    def __call__(self, text: str) -> np.ndarray:
        if SPECIAL in text or (len(text) > SAFE_RUN and any(m.end() - m.start() > SAFE_RUN for m in _LONG_RUN.finditer(text))):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.json)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def encoder(name: str = "byte_bpe_50k") -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]
