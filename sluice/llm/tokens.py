"""Encoding with a public byte-level tokenizer by forced-boundary splitting.

A pair of bytes that stands inside no token of the vocabulary can never be merged over, so every
place where such a pair starts a run of white space (where the tokenizer's own splitting begins
anew as well) is a certain cut. Fragments between certain cuts are encoded by themselves and
remembered, and their ids concatenated.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every function here.
TOKENIZERS = os.environ.get("SLUICE_TOKENIZERS", "/opt/tokenizers")
#: How the byte_bpe vocabularies cut a text before merging (fixed by those vocabularies).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_SPACES = (9, 10, 11, 12, 13, 32)


class ForcedBoundaryEncoder:
    """Encoder of one vocabulary; keeps at most ``remember`` fragments of at most 64 bytes."""

    def __init__(self, path: str, remember: int = 300_000):
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        inside = np.zeros(1 << 16, bool)
        for token in self.ranks:
            if len(token) > 1:
                b = np.frombuffer(token, np.uint8).astype(np.int32)
                inside[b[:-1] * 256 + b[1:]] = True
        left, right = np.divmod(np.arange(1 << 16), 256)
        #: Pairs that mark a certain cut between their bytes.
        self.certain = ~inside & np.isin(right, _SPACES) & ~np.isin(left, _SPACES)
        encode, known = self.encoding.encode_ordinary, {}

        class Known(dict):
            def __missing__(_, fragment: bytes) -> list[int]:
                ids = encode(fragment.decode("utf-8"))
                if len(fragment) <= 64:
                    if len(known) >= remember:
                        known.clear()
                    known[fragment] = ids
                return ids

        known = self.known = Known()

    def encode(self, text: str) -> list[int]:
        try:
            data = text.encode("utf-8")
        except UnicodeEncodeError:  # lone surrogates stand for the replacement character
            data = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode("utf-8")
        if not data:
            return []
        b = np.frombuffer(data, np.uint8).astype(np.int32)
        cuts = (np.flatnonzero(self.certain[b[:-1] * 256 + b[1:]]) + 1).tolist()
        fragments = [data[i:j] for i, j in zip([0, *cuts], [*cuts, len(data)])]
        return list(chain.from_iterable(map(self.known.__getitem__, fragments)))


def encode(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, extra: tuple[str, ...] = (), count_only: bool = False) -> DataFrame:
    """``key, ids`` of every row, or with ``count_only`` ``key, n_tokens``; columns in ``extra`` are carried along.

    Null and empty texts have no ids (an empty list, 0 tokens). Rows are neither dropped nor merged.
    """
    path = f"{folder}/{tokenizer}.tiktoken"
    kept = [key, *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ForcedBoundaryEncoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(len(kept)).to_pylist()
                if count_only:
                    made = pa.array([len(encoder.encode(t)) if t else 0 for t in texts], pa.int64())
                else:
                    ids = [encoder.encode(t) if t else [] for t in texts]
                    n = np.fromiter(map(len, ids), np.int32, len(ids))
                    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))
                    made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], made], [*kept, "n_tokens" if count_only else "ids"])

    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.select(*kept, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"{head}, " + ("n_tokens bigint" if count_only else "ids array<int>"))
