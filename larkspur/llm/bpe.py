"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.blocks import text_blocks

#: Where the vocabulary files lie; every operator takes another place as a parameter.
TOKENIZERS = "/opt/tokenizers"

# Fixed value: the pattern that splits text before merging, as the vocabulary's description gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct pieces whose ids a task remembers.
REMEMBERED = 300_000


def load_ranks(name: str, folder: str = TOKENIZERS) -> dict[bytes, int]:
    """The ranks of a vocabulary file: token bytes to id, which is also the order of its merge."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairIndexEncoder:
    """Encodes pieces by an index from each adjacent pair to all its positions among the pieces at hand.

    Pairs are applied in ascending order of rank, each at all its positions at once; a merge retires the two pairs it
    overlaps and enters the two it forms. Pieces never touch, so the order within each piece is the one it has alone.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.first = [ranks[bytes([b])] for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        self.known: dict[str, int] = {}
        self.lists: list[list[int]] = []

    def _merge(self, a: int, b: int) -> int:
        pair = (a, b)
        got = self.merged.get(pair)
        if got is None:
            got = self.merged[pair] = self.ranks.get(self.token[a] + self.token[b], -1)
        return got

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        ids: list[int] = []
        bounds = []
        for piece in pieces:
            bounds.append(len(ids))
            ids.extend(self.first[b] for b in piece)
            ids.append(-1)  # no pair spans two pieces
        size = len(ids)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        where: dict[tuple[int, int], list[int]] = {}
        active: list[tuple[int, tuple[int, int]]] = []

        def enter(a: int, b: int, at: int) -> None:
            places = where.get((a, b))
            if places is not None:
                places.append(at)
            elif (rank := self._merge(a, b)) >= 0:
                where[(a, b)] = [at]
                heapq.heappush(active, (rank, (a, b)))

        for i in range(size - 1):
            if ids[i] >= 0 and ids[i + 1] >= 0:
                enter(ids[i], ids[i + 1], i)
        while active:
            new, pair = heapq.heappop(active)
            places = where.pop(pair)
            places.sort()
            a, b = pair
            for i in places:
                j = after[i]
                if ids[i] != a or j >= size or ids[j] != b:
                    continue  # an earlier merge took one of the two
                k, h = after[j], before[i]
                ids[i], ids[j] = new, -2
                after[i] = k
                if k < size:
                    before[k] = i
                    if ids[k] >= 0:
                        enter(new, ids[k], i)
                if h >= 0 and ids[h] >= 0:
                    enter(ids[h], new, h)
        out = []
        for start, piece in zip(bounds, pieces, strict=True):
            out.append([x for x in ids[start : start + len(piece)] if x >= 0])
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has; null and empty texts have none."""
        find = regex.compile(PATTERN).findall
        words: list[str] = []
        per_text = np.empty(len(texts), dtype=np.int64)
        for n, t in enumerate(texts):
            found = find(t) if t else []
            per_text[n] = len(found)
            words.extend(found)
        if not words:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        coded = pa.array(words, pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known, self.lists = {}, []
        new = [w for w in distinct if w not in self.known]
        for w, got in zip(new, self.encode_pieces([w.encode() for w in new]), strict=True):
            self.known[w] = len(self.lists)
            self.lists.append(got)
        own = [self.lists[self.known[w]] for w in distinct]
        length = np.array([len(x) for x in own], dtype=np.int64)
        flat = np.array([x for one in own for x in one], dtype=np.int32)
        start = np.cumsum(length) - length
        word = coded.indices.to_numpy()
        count = length[word]
        ends = np.cumsum(count)
        at = np.arange(int(ends[-1])) - np.repeat(ends - count, count) + np.repeat(start[word], count)
        bounds = np.concatenate([[0], ends])
        text_end = np.concatenate([[0], np.cumsum(per_text)])
        return flat[at], np.diff(bounds[text_end])


def _ids_runner(ranks, id_type: pa.DataType, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PairIndexEncoder(ranks.value)
        for ids, texts in text_blocks(batches):
            flat, count = encoder.encode(texts)
            key = pa.array(ids, id_type)
            if counts_only:
                yield pa.record_batch({"id": key, "n_tokens": pa.array(count, pa.int64())})
            else:
                offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
                yield pa.record_batch({"id": key, "ids": pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))})

    return run


def _encoded(df: DataFrame, ident: str, text: str, vocabulary: str, folder: str, counts_only: bool) -> DataFrame:
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary, folder))  # fixed size, under 3 MB
    rows = df.select(F.col(ident).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_ids_runner(ranks, pa.int64(), counts_only), "id bigint, " + ("n_tokens bigint" if counts_only else "ids array<int>"))


def token_ids(df: DataFrame, ident: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``ident, ids``: each whole text as the vocabulary's ids, without special tokens, whose strings are ordinary text.

    Null and empty texts have the empty list. Nothing is shuffled; a repeated row is encoded again; other columns are ignored.
    """
    return _encoded(df, ident, text, vocabulary, folder, False).select(F.col("id").alias(ident), "ids")


def token_counts(df: DataFrame, ident: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``ident, n_tokens``: the length of each text in the vocabulary's tokens, 0 for a null or empty text."""
    return _encoded(df, ident, text, vocabulary, folder, True).select(F.col("id").alias(ident), "n_tokens")
