"""Encoding a whole corpus with a public byte-level tokenizer.

The rank file is read once in each Python worker. Long texts are cut before a white-space character that
follows another character: no token of the splitting pattern spans such a place and nothing after it changes what comes
before, so the parts' ids joined are the text's ids. Long runs of white space, which would exhaust the pattern's
stack, are encoded as the single pieces that the pattern makes of them. Ids are decoded byte by byte,
so that any slice of them can be decoded.
"""

from __future__ import annotations

import base64
import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT = "byte_bpe_50k"
FOLDER = "/opt/tokenizers"

#: Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_WHITE = re.compile(f"[{_WHITE}]{{512,}}")
_SAFE = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])")
CHUNK = 1 << 16


class Codec:
    """Ids of texts and bytes of ids, by a rank file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def _plain(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=())

    def _white(self, run: str) -> np.ndarray:
        return np.asarray(self.encoding._encode_single_piece(run), dtype=np.uint32)

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a text without special tokens; none for an empty or a null text."""
        if not text:
            return np.zeros(0, dtype=np.uint32)
        if len(text) < 512:
            return self._plain(text)
        parts, at = [], 0
        for run in _LONG_WHITE.finditer(text):
            # before other text, the last character of the run belongs to what follows
            end = run.end() if run.end() == len(text) else run.end() - 1
            parts.extend(self._chunks(text[at : run.start()]))
            parts.append(self._white(text[run.start() : end]))
            at = end
        parts.extend(self._chunks(text[at:]))
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)

    def _chunks(self, text: str) -> Iterator[np.ndarray]:
        at = 0
        while len(text) - at > CHUNK:
            cut = _SAFE.search(text, at + CHUNK)
            if cut is None:
                break
            yield self._plain(text[at : cut.start()])
            at = cut.start()
        if at < len(text):
            yield self._plain(text[at:])

    def bytes(self, ids) -> bytes:
        return b"".join(self.encoding.decode_single_token_bytes(int(i)) for i in ids)


def codec(name: str = DEFAULT, folder: str = FOLDER) -> Codec:
    """The worker's codec for a rank file; kept for the life of the process."""
    kept = sys.__dict__.setdefault("_thermaline_codecs", {})
    path = os.path.join(folder, f"{name}.tiktoken")
    if path not in kept:
        kept[path] = Codec(path)
    return kept[path]


def one_row_each(df: DataFrame, key: str) -> DataFrame:
    """Rows repeated with one key are one row. Only the key column is read to see whether any is."""
    twice = df.groupBy(key).count().filter("count > 1").limit(1).count()
    return df.dropDuplicates([key]) if twice else df


def encode(df: DataFrame, doc_id: str, text: str, name: str = DEFAULT, folder: str = FOLDER) -> DataFrame:
    """Rows ``(doc_id, ids)``, ids ARRAY<INT>: every document's ids, an empty array for empty and null texts.

    Strings of special tokens are ordinary text. Texts of any length are encoded whole; repeated rows of one document
    give one row, and other columns are ignored. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name, folder)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            ids, first, total = [], 0, 0
            for k in range(batch.num_rows):
                ids.append(c.ids(texts[k].as_py()))
                total += len(ids[-1])
                if total > 2_000_000 or k == batch.num_rows - 1:  # a batch of few long texts would be large
                    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                    np.cumsum([len(x) for x in ids], out=offsets[1:])
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([keys.slice(first, len(ids)), lists], names=["doc_id", "ids"])
                    ids, first, total = [], k + 1, 0

    rows = one_row_each(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "doc_id")
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(df: DataFrame, doc_id: str, text: str, carry: list[str] = (), name: str = DEFAULT, folder: str = FOLDER) -> DataFrame:
    """Rows ``(doc_id, *carry, n_tokens)``: the number of ids of each document, 0 for empty and null texts."""
    fields = [f for f in df.schema.fields if f.name in carry]
    schema = ", ".join(["doc_id long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_tokens long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name, folder)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            n = pa.array([len(c.ids(texts[k].as_py())) for k in range(batch.num_rows)], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*batch.schema.names[:-1], "n_tokens"])

    rows = one_row_each(df.select(F.col(doc_id).cast("long").alias("doc_id"), *[f.name for f in fields], F.col(text).cast("string").alias("_text")), "doc_id")
    return rows.mapInArrow(run, schema)
