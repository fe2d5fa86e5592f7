"""Words of many texts at once, as 64-bit hashes, on Arrow buffers with numpy.

A word is a run of bytes other than space and 0x09-0x0D (so `[^\\x20\\x09-\\x0D]+` on code
points). Its hash is a polynomial in its bytes, read off running sums, then mixed; sequences of
words are hashed from the hashes of their words. Equal sequences always get equal hashes;
different ones collide with a probability of about 2^-64 for each pair compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled in one go; longer texts are handled alone, their words in runs of this size.
BLOCK = 1 << 19

_U = np.uint64
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit multipliers derived from a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_BASE = 0x5851F42D4C957F2D
_VALUE = constants(11, 256)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE_FOLDED = _VALUE[_LOWER]
_tables: dict[str, np.ndarray] = {}


def _powers(name: str, base: int) -> np.ndarray:
    if name not in _tables:
        steps = np.full(BLOCK + 1, base % 2**64, _U)
        steps[0] = 1
        _tables[name] = np.multiply.accumulate(steps)
    return _tables[name]


@dataclass
class Words:
    """Words of some texts in order. first[i] is the first word of text i; first[-1] is the count."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8), bounds


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
    power, inverse = _powers("power", _BASE), _powers("inverse", pow(_BASE, -1, 2**64))
    out = np.empty(len(start), _U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, "right")))
        low, high = int(start[i]), int(end[j - 1])
        if high - low > BLOCK:  # one word longer than a block
            digest = hashlib.blake2b(value[data[low:high]].tobytes(), digest_size=8).digest()
            out[i] = int.from_bytes(digest, "little")
        else:
            sums = np.zeros(high - low + 1, _U)
            np.cumsum(value[data[low:high]] * power[: high - low], out=sums[1:])
            out[i:j] = (sums[end[i:j] - low] - sums[start[i:j] - low]) * inverse[start[i:j] - low]
        i = j
    return mix(out + (end - start).astype(_U) * _U(0x9E3779B97F4A7C15))


def words(column: pa.Array, fold: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(low, high, words of the texts low..high-1), in blocks of texts; null counts as empty.

    fold: A-Z counts as a-z in the hashes.
    """
    data, bounds = _buffer(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + BLOCK, "right")) - 1)
        part = data[bounds[low] : bounds[high]]
        begins = bounds[low : high + 1] - bounds[low]
        inside = ~_BREAK[part]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edge = begins[1:-1]
        edge = edge[(edge > 0) & (edge < len(part))]
        opens[edge] = inside[edge]
        closes[edge - 1] = inside[edge - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        hashes = _hashes(part, start, end, _VALUE_FOLDED if fold else _VALUE)
        yield low, high, Words(part, start, end, hashes, np.searchsorted(start, begins))
        low = high


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of `size` words (also across texts: the caller drops those)."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, _U)
    factors = constants(1000 * seed + size, size)
    total = np.full(count, _U(size + 1000 * seed), _U)
    for k in range(size):
        total += hashes[k : k + count] * factors[k]
    return mix(total)


def shingle_sets(found: Words, size: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes, sorted; a shorter text is one shingle, an empty one none."""
    full = windows(found.hash, size)
    for low, high in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        count = high - low
        if count >= size:
            own = np.sort(full[low : high - size + 1])
            fresh = np.empty(len(own), bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            yield own[fresh]
        else:
            yield windows(found.hash[low:high], count) if count else np.empty(0, _U)


#: Rows that are known to meet another one are spread over so many routes.
SPREAD = 1024


def routes(key: np.ndarray, spread_by: np.ndarray) -> np.ndarray:
    """0: no other row of this block has the key; 1: the first of several with it; 2 and up: the others.

    Rows of all blocks with route 0 or 1 have to meet to find equal keys; the others needn't, so
    a key that very many rows have brings one row of each block to the meeting task. The row
    order decides which is first.
    """
    order = np.argsort(key, kind="stable")
    again, leads = np.zeros(len(key), bool), np.zeros(len(key), bool)
    equal = key[order[1:]] == key[order[:-1]]
    again[order[1:]] = equal
    leads[order[:-1]] = equal
    return np.where(again, 2 + (mix(spread_by.view(_U)) % _U(SPREAD)).astype(np.int32), leads).astype(np.int32)


def batches_of(schema: pa.Schema, parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    """One batch from lists of equally long numpy columns."""
    columns = []
    for field, arrays in zip(schema, zip(*parts, strict=True), strict=True):
        whole = np.concatenate(arrays)
        columns.append(pa.array(whole.view(np.int64) if whole.dtype == _U else whole, field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)
