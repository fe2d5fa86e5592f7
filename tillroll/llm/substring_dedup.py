"""Removal of word windows that occurred before, by level-wise doubling.

Lengths double up to that of a window, for 20 words 5, 10, 20. Of the runs of one length that start
in a window, the one with the smallest hash stands for the window (its anchor); equal windows have
equal anchors, so a window whose anchor occurs once cannot repeat. Only windows over anchors that
occur twice are extended to the next length; those that reach the whole one are compared there. No
longer level follows: a repeat longer than a window consists of windows that repeat.

The text is read per document; between documents only hashes, ids and positions are exchanged.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import keyed_texts, map_batches, meeting_route
from tillroll.llm.words import Words, batches_of, mix, routes, windows, words

_ROWS = pa.schema([("hash", pa.int64()), ("doc", pa.int64()), ("copy", pa.int64()), ("at", pa.int32()), ("route", pa.int32())])
_ROWS_SQL = "hash long, doc long, copy long, at int, route int"
_WINDOWS_SQL = "anchor long, doc long, copy long, at int, hashes array<long>"


def levels(size: int) -> list[int]:
    """Lengths of runs, each half of the next (rounded up), the last being size; the first has fewer than 8 words."""
    found = [size]
    while found[0] >= 8:
        found.insert(0, -(-found[0] // 2))
    return found


def _anchors(found: Words, size: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each window that lies in one text, its anchor's start, the hash of every run of length)."""
    runs = windows(found.hash, length)
    if len(found.hash) < size:
        return np.empty(0, np.int64), np.empty(0, np.int64), runs
    least = np.lib.stride_tricks.sliding_window_view(runs, size - length + 1).argmin(axis=1)
    owner = found.owner()
    start = np.flatnonzero(owner[: len(least)] == owner[size - 1 :])
    return start, start + least[start], runs


def _survivors(batch: pa.RecordBatch, low: int, high: int, found: Words, size: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_anchors() of texts low..high-1, of those windows alone whose anchor is listed in the batch's last column."""
    bounds, repeated = batch.column(3).offsets.to_numpy(), batch.column(3).flatten().to_numpy()
    own = np.repeat(np.arange(high - low), np.diff(bounds[low : high + 1]))
    wanted = np.zeros(len(found.hash) + 1, bool)
    wanted[found.first[own] + repeated[bounds[low] - bounds[0] : bounds[high] - bounds[0]]] = True
    start, at, runs = _anchors(found, size, length)
    kept = wanted[at]
    return start[kept], at[kept], runs


def _emit_anchors(size: int, length: int, before: int | None) -> Callable:
    """Anchors of `length` words of all windows, or of those over repeated anchors of `before` words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, copy = (batch.column(k).to_numpy() for k in (0, 1))
            for low, high, found in words(batch.column(2)):
                start, at, runs = _anchors(found, size, length)
                if before:
                    alive = np.zeros(len(found.hash) + 1, bool)
                    alive[_survivors(batch, low, high, found, size, before)[0]] = True
                    at = at[alive[start]]
                at = np.unique(at)
                own = found.owner()[at]
                key = runs[at]
                yield batches_of(_ROWS, [[
                    key, doc[low + own], copy[low + own], (at - found.first[own]).astype(np.int32), routes(key, at)]])

    return emit


def _emit_windows(size: int, length: int) -> Callable:
    """Windows over repeated anchors of `length` words: a row for each place of an anchor, with the first
    window's start and the hashes of its windows, which start one after another. Of windows alike in
    one block of texts all but the earliest are known to be repeats; they have no hash. A row without
    any hash has a number of its own for an anchor, as it need not meet others."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, copy = (batch.column(k).to_numpy() for k in (0, 1))
            for low, high, found in words(batch.column(2)):
                start, at, runs = _survivors(batch, low, high, found, size, length)
                own = found.owner()[start]
                key, of, twin = windows(found.hash, size)[start], doc[low + own], copy[low + own]
                order = np.lexsort((start - found.first[own], twin, of))
                key, of, twin, start, own, at = (x[order] for x in (key, of, twin, start, own, at))
                begin = (start - found.first[own]).astype(np.int32)
                fresh = np.ones(len(key), bool)  # rows alike in doc and copy are one document
                fresh[1:] = (of[1:] != of[:-1]) | (twin[1:] != twin[:-1]) | (begin[1:] != begin[:-1])
                key, of, twin, begin, start, at, own = (x[fresh] for x in (key, of, twin, begin, start, at, own))
                place = at - found.first[own]
                opens = np.ones(len(key), bool)
                opens[1:] = (of[1:] != of[:-1]) | (twin[1:] != twin[:-1]) | (place[1:] != place[:-1])
                first = np.flatnonzero(opens)
                known = routes(key, start) > 1
                anchor = runs[at[first]]
                if len(first):
                    alone = np.logical_and.reduceat(known, first)
                    anchor[alone] = mix(anchor[alone] ^ mix(start[first[alone]].view(np.uint64)))
                hashes = pa.ListArray.from_arrays(
                    pa.array(np.append(first, len(key)), pa.int32()), pa.array(key.view(np.int64), pa.int64(), mask=known))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(of[first], pa.int64()), pa.array(twin[first], pa.int64()),
                     pa.array(begin[first], pa.int32()), hashes], names=["anchor", "doc", "copy", "at", "hashes"])

    return emit


def _emit_kept(size: int) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, starts in zip(batch.column(1), batch.column(2), strict=True):
                found = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                removed = 0
                if starts.is_valid:
                    begins = starts.values.to_numpy()
                    change = np.zeros(len(found) + 1, np.int64)
                    np.add.at(change, begins, 1)
                    np.add.at(change, begins + size, -1)
                    stays = np.cumsum(change[:-1]) == 0
                    removed = len(found) - int(stays.sum())
                    words_left = list(itertools.compress(found, stays.tolist()))
                else:
                    words_left = found
                total.append(len(found))
                gone.append(removed)
                kept.append(b" ".join(words_left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return emit


def _texts(docs: DataFrame) -> DataFrame:
    """keyed_texts(docs), with copy 0 throughout where every row has a doc of its own: it travels with
    every window, and need not tell rows apart then."""
    texts = keyed_texts(docs)
    shared = texts.groupBy("doc").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    return texts.withColumn("copy", F.lit(0).cast("long")) if shared.isEmpty() else texts


def repeated_windows(texts: DataFrame, size: int = 20) -> DataFrame:
    """(doc, copy, at): starts, in words, of windows whose sequence also starts earlier; texts are _texts(docs).

    Earlier is a smaller doc (see keyed_texts), the same doc and a smaller copy, or the same row
    and a smaller start.
    """
    shorter = levels(size)[:-1]
    if not shorter:
        shorter = [size]
    rows, before = texts, None
    for length in shorter:
        anchors = map_batches(rows, _emit_anchors(size, length, before), _ROWS_SQL)
        twice = anchors.withColumn("meeting", meeting_route())
        twice = twice.withColumn("rows", F.count("*").over(Window.partitionBy("hash", "meeting"))).filter("route > 0 OR rows > 1")
        # One list for each document, no longer than its words.
        twice = twice.groupBy("doc", "copy").agg(F.collect_list("at").alias("at"))
        rows, before = texts.join(twice, ["doc", "copy"]).select("doc", "copy", "text", "at"), length
    # Equal windows have equal anchors at equal places, so they meet where rows are dealt by anchor.
    found = map_batches(rows, _emit_windows(size, before), _WINDOWS_SQL).repartition("anchor")
    single = found.select("anchor", "doc", "copy", "at", F.posexplode("hashes").alias("k", "hash"))
    single = single.select("anchor", "hash", "doc", "copy", (F.col("at") + F.col("k")).alias("at"))
    turn = F.rank().over(Window.partitionBy("anchor", "hash").orderBy("doc", "copy", "at"))
    return single.withColumn("turn", turn).filter("hash IS NULL OR turn > 1").select("doc", "copy", "at")


def remove_repeats(docs: DataFrame, size: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row of docs (doc_id, text).

    A word (run of other than space and 0x09-0x0D, unchanged) goes if a window of `size` words
    that covers it also starts earlier, judged on the input; kept words are joined by one space.
    Null text: no words. Shorter texts keep all. Rows alike in doc_id and text are judged as one
    document and each get its result; a null doc_id counts as the largest; rows that share a
    doc_id but not the text count as documents in the order of a hash of the text. Empty input
    gives no rows; other columns are ignored.
    """
    texts = _texts(docs)
    starts = repeated_windows(texts, size).groupBy("doc", "copy").agg(F.collect_set("at").alias("starts"))
    joined = texts.join(starts, ["doc", "copy"], "left")
    doc_id = F.when(F.col("doc") != 2**63 - 1, F.col("doc")).alias("doc_id")
    out = joined.select(doc_id, "text", "starts")
    return map_batches(out, _emit_kept(size), "doc_id long, n_words long, n_removed long, kept_text string")
