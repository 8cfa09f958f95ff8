"""Cutting oversized texts at natural boundaries, with an overlap.

Every place where a text may be cut has a strength: the start of a commit or a file's diff, of a hunk, of a paragraph, of a
line, a blank, or only a token's end. A sparse table over the strengths answers which is the strongest cut in the
window of lengths that a piece may have, the rightmost of equals, in two look-ups. The next piece
begins as many tokens before the cut as the overlap asks for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermaline.llm.tokens import DEFAULT, FOLDER, Codec, codec, one_row_each

LIMIT, OVERLAP = 1500, 100

# Lines that begin a commit or a file's part of it, and lines that begin a hunk or a part of a heading.
HEADS = rb"(?m)^(?:diff --git |diff -r |commit [0-9a-f]{7,40}\b|From [0-9a-f]{40} |# HG changeset patch|Index: |r\d+ \| |-{20,}$)"
PARTS = rb"(?m)^(?:@@ |--- |\+\+\+ |From: |Date: |Subject: |---$|={20,}$)"
STRONGEST = {5: HEADS, 4: PARTS, 3: rb"(?<=\n\n)[^\n]", 2: rb"(?<=\n)", 1: rb"(?<=[^\s])(?=[ \t])"}


class SparseTable:
    """Rightmost largest element of a range, in two look-ups; levels are made up to the widest range asked for."""

    def __init__(self, values: np.ndarray, widest: int):
        self.values = values
        self.levels = [np.arange(len(values), dtype=np.int32)]
        while 2 << (len(self.levels) - 1) <= min(widest, len(values)):
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            a, b = last[:-half], last[half:]
            self.levels.append(np.where(values[b] >= values[a], b, a))

    def argmax(self, lo: int, hi: int) -> int:
        """Of ``lo..hi``, both included."""
        k = (hi - lo + 1).bit_length() - 1
        a, b = self.levels[k][lo], self.levels[k][hi - (1 << k) + 1]
        return int(b if self.values[b] >= self.values[a] else a)


def boundaries(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which a text may be cut, ascending, and their strengths. ``starts`` are its tokens' offsets."""
    flat = re.sub(rb"\r(?!\n)", b"\n", data).replace(b"\r\n", b" \n")
    raw = np.frombuffer(data, dtype=np.uint8)
    places = {0: starts[(raw[starts] & 0xC0) != 0x80] if len(starts) else starts}
    for strength, rx in sorted(STRONGEST.items()):
        places[strength] = np.fromiter((m.start() for m in re.finditer(rx, flat)), dtype=np.int64)
    at = np.concatenate(list(places.values()))
    strength = np.concatenate([np.full(len(p), s, dtype=np.int8) for s, p in places.items()])
    order = np.lexsort((strength, at))
    at, strength = at[order], strength[order]
    last = np.append(at[1:] != at[:-1], True) if len(at) else np.zeros(0, dtype=bool)
    keep = last & (at > 0) & (at < len(data))
    return at[keep], strength[keep]


def split(text: str, c: Codec, limit: int = LIMIT, overlap: int = OVERLAP, least: float = 0.5) -> list[tuple[int, int, int]]:
    """(first byte, end byte, tokens) of each piece; one piece if the text has at most ``limit`` tokens.

    Pieces are cut at the strongest place between ``least`` and all of the limit. A piece's tokens are those of its own
    text, which may differ from the whole text's at its ends; a cut that makes too many is moved left. A limit below
    the tokens of a single character raises.
    """
    ids = c.ids(text)
    data = text.encode()
    if len(ids) <= limit:
        return [(0, len(data), len(ids))]
    starts = np.concatenate([[0], np.cumsum(c.lengths[ids])[:-1]])
    at, strength = boundaries(data, starts)
    before = np.searchsorted(starts, at)  # tokens before each place
    widest = int((np.searchsorted(before, before + limit, side="right") - np.arange(len(at))).max())
    table, pieces, a = SparseTable(strength, widest), [], 0
    while True:
        done = int(np.searchsorted(starts, a))
        if len(ids) - done <= limit + 8:
            own = c.ids(data[a:].decode())
            if len(own) <= limit:
                return [*pieces, (a, len(data), len(own))]
        if at[-1] <= a:
            raise ValueError(f"nothing at byte {a} can be cut into pieces of {limit} tokens")
        longest = limit
        while True:
            lo = max(int(np.searchsorted(before, done + max(int(longest * least), overlap + 1))), int(np.searchsorted(at, a + 1)))
            hi = int(np.searchsorted(before, done + longest, side="right")) - 1
            if hi < lo:  # no place in the window: the last before it, or the first after it
                lo = hi = hi if hi >= 0 and at[hi] > a else min(lo, len(at) - 1)
            cut = table.argmax(lo, hi)
            own = c.ids(data[a : at[cut]].decode())
            if len(own) <= limit:
                break
            longest = min(longest - 1, int(before[cut]) - done - 1)
            if longest <= 1:  # not even a window of one token fits: the first place of all, a token's end
                cut = int(np.searchsorted(at, a + 1))
                own = c.ids(data[a : at[cut]].decode()) if cut < len(at) else c.ids(data[a:].decode())
                if len(own) > limit:
                    raise ValueError(f"nothing at byte {a} can be cut into pieces of {limit} tokens")
                break
        b = int(at[cut]) if cut < len(at) else len(data)
        pieces.append((a, b, len(own)))
        back = min(overlap, len(own) - 1)
        nxt = b - int(c.lengths[own[len(own) - back :]].sum()) if back > 0 else b
        while nxt > a and (data[nxt] & 0xC0) == 0x80:  # a character's later byte
            nxt -= 1
        a = nxt if nxt > a else b


def split_documents(df: DataFrame, doc_id: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, name: str = DEFAULT, folder: str = FOLDER, with_text: bool = True, whole: bool = False) -> DataFrame:
    """Rows ``(doc_id, piece_no, first_byte, end_byte, n_tokens[, text])`` of the documents of more than ``limit`` tokens.

    Pieces are numbered from 1 and have at most ``limit`` tokens; each begins with the last ``overlap`` tokens' worth of the one
    before, so the first bytes of a piece up to the former's end are the repetition. With ``whole``, documents
    within the limit give one piece. Null texts give none; an empty text is within any limit. A text of at most ``limit`` bytes can't
    have more tokens than that, and isn't encoded. Repeated rows of one document count once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(name, folder)
        for b in batches:
            rows, held = [], 0
            for i, t in zip(b["doc_id"], b["text"]):
                pieces = split(t, c, limit, overlap)
                if len(pieces) > 1 or whole:
                    data = t.encode() if with_text else b""
                    rows.extend((i, k, s, e, n, *([data[s:e].decode()] if with_text else [])) for k, (s, e, n) in enumerate(pieces, 1))
                    held += len(t)
                if held > 32_000_000:
                    yield pd.DataFrame(rows, columns=cols)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=cols)

    cols = ["doc_id", "piece_no", "first_byte", "end_byte", "n_tokens", *(["text"] if with_text else [])]
    rows = one_row_each(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "doc_id").filter("text IS NOT NULL")
    if not whole:
        rows = rows.filter(F.octet_length("text") > limit)
    return rows.mapInPandas(run, "doc_id long, piece_no long, first_byte long, end_byte long, n_tokens long" + (", text string" if with_text else ""))
