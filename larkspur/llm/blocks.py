"""Blocks of records inside a task, and their words as arrays."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Characters of text a task works on at once; a longer text is a block of its own, never cut.
BLOCK_CHARS = 1_000_000


def text_blocks(batches: Iterator[pa.RecordBatch], ident: str = "id", text: str = "text", chars: int = BLOCK_CHARS) -> Iterator[tuple[list, list[str | None]]]:
    """Identifiers and whole texts of consecutive records, each block up to ``chars`` long."""
    ids: list = []
    texts: list[str | None] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(ident).to_pylist(), batch.column(text).to_pylist(), strict=True):
            n = len(t) if t else 0
            if texts and size + n > chars:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += n
    if texts:
        yield ids, texts


_ASCII_WORD = np.array([chr(c).isalnum() for c in range(128)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def word_mask(points: np.ndarray) -> np.ndarray:
    """Which code points are letters or digits (Unicode L and N)."""
    ascii_only = points < 128
    mask = _ASCII_WORD[np.where(ascii_only, points, 0)] & ascii_only
    if not ascii_only.all():
        where = np.flatnonzero(~ascii_only)
        kinds, inverse = np.unique(points[where], return_inverse=True)
        mask[where] = np.array([unicodedata.category(chr(c))[0] in "LN" for c in kinds])[inverse]
    return mask


@dataclass
class Words:
    """The words of a block: the record each stands in, its code, and the distinct words the codes stand for (sorted)."""

    record: np.ndarray
    code: np.ndarray
    vocabulary: pa.Array


def words_of(texts: list[str | None]) -> Words:
    """Maximal runs of letters and digits of the lower-cased texts; a null text has none."""
    low = [t.lower() if t else "" for t in texts]
    points = code_points("\n".join(low))
    mask = word_mask(points)
    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends_of_records = np.cumsum(np.array([len(t) + 1 for t in low], dtype=np.int64))
    record = np.searchsorted(ends_of_records, starts, side="right")
    kept = points[mask]
    size = 1 + (kept >= 0x80).astype(np.int64) + (kept >= 0x800) + (kept >= 0x10000)
    bytes_before = np.concatenate([[0], np.cumsum(size)])
    chars_before = np.concatenate([[0], np.cumsum(ends - starts)])
    offsets = bytes_before[chars_before].astype(np.int32)
    data = kept.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
    coded = words.dictionary_encode()
    order = pa.compute.sort_indices(coded.dictionary)
    rank = np.empty(len(order), dtype=np.int64)
    rank[np.asarray(order)] = np.arange(len(order))
    code = rank[coded.indices.to_numpy()] if len(starts) else np.zeros(0, dtype=np.int64)
    return Words(record, code, coded.dictionary.take(order))
