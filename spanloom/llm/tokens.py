"""Encoding of a corpus by a public byte-level BPE vocabulary.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can't be merged across,
so a text may be cut between such bytes and its fragments encoded on their own. The rule that
splits a text before the merges must not notice the cut either: none is made after white space (the
rule looks ahead from it), before an apostrophe (contractions) or inside a character.

All texts are cut, whatever their length, and encoded where they lie: one narrow pass, no shuffle, time
in proportion to the length.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split before the merges, a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text is cut at the first certain cut after so many bytes.
FRAGMENT_BYTES = 256
#: White space beyond ASCII, as bytes.
WIDE_SPACES = tuple(c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    """The vocabulary's encoder and, for each pair of bytes, whether a cut between them is certain; once a process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    inside = np.zeros(65536, dtype=bool)
    for token in ranks:
        if len(token) > 1:
            t = np.frombuffer(token, dtype=np.uint8).astype(np.uint32)
            inside[t[:-1] * 256 + t[1:]] = True
    certain = ~inside
    first, second = np.arange(65536) >> 8, np.arange(65536) & 255
    certain &= (second & 0xC0) != 0x80  # inside a character
    certain &= second != ord("'")
    certain &= ~np.isin(first, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), certain


def fragments(text: str, certain: np.ndarray, least: int = FRAGMENT_BYTES) -> list[str]:
    """``text`` cut at certain cuts, the first after every ``least`` bytes; a text without any stays whole."""
    raw = text.encode()
    if len(raw) <= least:
        return [text]
    b = np.frombuffer(raw, dtype=np.uint8)
    at = np.flatnonzero(certain[(b[:-1].astype(np.uint16) << 8) | b[1:]]) + 1  # cut before this byte
    out, start, wide = [], 0, not text.isascii()
    k = int(np.searchsorted(at, least))
    while k < len(at):
        end = int(at[k])
        if wide and raw.endswith(WIDE_SPACES, max(0, end - 3), end):
            k += 1
            continue
        out.append(raw[start:end].decode())
        start = end
        k = int(np.searchsorted(at, start + least))
    out.append(raw[start:].decode())
    return out


def encode_text(text: str | None, path: str = VOCABULARY, least: int = FRAGMENT_BYTES) -> list[int]:
    """The ids of ``text``; none for null and empty."""
    if not text:
        return []
    enc, certain = encoding(path)
    parts = fragments(text, certain, least)
    if len(parts) == 1:
        return enc.encode_ordinary(text)
    return [i for p in parts for i in enc.encode_ordinary(p)]


def encode_column(df: DataFrame, key: str, text: str, path: str = VOCABULARY, count_only: bool = False) -> DataFrame:
    """``key`` and ``ids`` (or, with ``count_only``, ``tokens``) of each row's text.

    Null and empty texts have the empty list (no tokens). Strings that spell a special token are
    ordinary text. Rows keep their number, repeated ones too; other columns are not read. A null key
    stays null.
    """
    kind = df.schema[key].dataType.simpleString()
    name, out = ("tokens", f"key {kind}, tokens bigint") if count_only else ("ids", f"key {kind}, ids array<int>")
    form = len if count_only else (lambda x: x)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], name: [form(encode_text(t, path)) for t in b["text"]]})

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(encode, out).withColumnRenamed("key", key)
