"""Token counts with offset-mapped attribution.

A document is encoded once, as a whole. Its tokens partition its bytes, so running sums of token lengths
give every token's span; the spans are joined with the sections' spans, and a token that crosses a
boundary is allotted by an explicit rule.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Place of the vocabulary, read by the driver and broadcast (under 1 MB).
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public word pattern of byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("majority", "first", "share")


@lru_cache(maxsize=2)
def _encoder(data: bytes, pattern: str):
    """(encoder, byte length of each token id)."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def lines(text: bytes) -> np.ndarray:
    """Byte ends of the lines of a text; a line break belongs to the line that it ends."""
    breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return breaks if len(breaks) and breaks[-1] == len(text) else np.append(breaks, len(text))


def allot(text: bytes, lengths: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section that ends at `ends`, for tokens of the given byte lengths.

    majority: a crossing token goes to the section with most of its characters, the earlier one on a tie. first: to
    the section of its first character. share: in parts, by characters. Characters are code points; one that several
    tokens split counts for each. The counts of a text add up to its number of tokens under every rule.
    """
    stop = np.cumsum(lengths)
    begin = stop - lengths
    first, last = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, stop - 1, "right")
    whole = first == last
    tokens = np.bincount(first[whole], minlength=len(ends)).astype(float)
    crossing = np.zeros(len(ends), np.int64)
    for i in np.flatnonzero(~whole):
        held = np.arange(first[i], last[i] + 1)
        crossing[held] += 1
        if rule == "first":
            tokens[held[0]] += 1
            continue
        edges = np.concatenate(([begin[i]], ends[held[:-1]], [stop[i]]))
        # a section's characters are its bytes that start one; a token that starts inside a character holds that one too
        chars = np.array([max(1, sum((b & 0xC0) != 0x80 for b in text[a:z])) for a, z in zip(edges[:-1], edges[1:])], float)
        if rule == "share":
            tokens[held] += chars / chars.sum()
        else:
            tokens[held[int(chars.argmax())]] += 1
    return tokens, crossing


def token_counts(docs: DataFrame, rule: str = "majority", vocabulary: str = VOCABULARY, pattern: str = PATTERN, sections: Callable[[bytes], np.ndarray] = lines) -> DataFrame:
    """One row per row of docs and section: doc_id, section, start, end (code points), tokens, crossing, doc_tokens.

    A null or empty text is one empty section without tokens. Rows are judged one by one: repeated rows repeat their
    sections, ids do not matter. tokens is whole unless the rule is share.
    """
    if rule not in RULES:
        raise ValueError(f"Unknown rule '{rule}'; one of {', '.join(RULES)}.")
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sizes = _encoder(shared.value, pattern)
        names = ["doc_id", "section", "start", "end", "tokens", "crossing", "doc_tokens"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data = (text or "").encode()
                ids = np.asarray(encoder.encode_ordinary(text or ""), np.int64)
                ends = sections(data)
                tokens, crossing = allot(data, sizes[ids], ends, rule)
                starts = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))[np.concatenate(([0], ends))]
                for column, values in zip(out, ([doc_id] * len(ends), range(len(ends)), starts[:-1], starts[1:], tokens, crossing, [len(ids)] * len(ends))):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "tokens" else pa.int64()) for n, c in zip(names, out)], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        count, "doc_id bigint, section bigint, start bigint, end bigint, tokens double, crossing bigint, doc_tokens bigint")
