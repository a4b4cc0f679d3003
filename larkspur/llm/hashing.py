"""Seeded 64-bit hashes of arrays, the same in every task and on every machine."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each number's bits, mixed (a finaliser with shifts and multiplications; distinct inputs stay distinct)."""
    x = x.astype(np.uint64, copy=True)
    x += _A
    x ^= x >> np.uint64(30)
    x *= _B
    x ^= x >> np.uint64(27)
    x *= _C
    x ^= x >> np.uint64(31)
    return x


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each ordered pair."""
    return mixed(a * _C + mixed(b))


def string_hashes(strings: pa.Array) -> np.ndarray:
    """A hash of each string; for the distinct words of a block, not for every occurrence."""
    return np.array([xxhash.xxh64_intdigest(s) for s in strings.to_pylist()], dtype=np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def line_print(line: str) -> int:
    """A print of a line that ignores case, spacing and the digits of numbers."""
    return xxhash.xxh64_intdigest(re.sub(r"\d+", "#", " ".join(line.lower().split()))) >> 1
