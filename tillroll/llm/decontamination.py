"""Documents that contain benchmark items, by MinHash containment search over size partitions.

Items are partitioned by the number n of their distinct five-word shingles. A document contains
an item if at least need = ceil(0.8 n) of them are among its own, so it then has one of any
n - need + 1; the MinHash sketch of an item holds its n - need + 1 smallest hashes, a length
fixed by its partition. So no match is lost, at any document length. (A sketch of equal length
for long documents, as in banded MinHash, would have to find Jaccard similarities near 0.002.)

Two bit maps of fixed size, of the sketches and of all item shingles, go to every task. A
document that hits the first sends its hits of the second to a join with the items, where the
shared shingles are counted exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import keyed_texts, map_batches, small_side, staged
from tillroll.llm.words import shingle_sets, windows, words

#: A match shares at least this percentage of the item's shingles.
PERCENT = 80
#: log2 of the bits of a bit map (2 MB): false hits cost time only, whatever the number of items.
MAP_BITS = 24
SHINGLE = 5

_U = np.uint64


def _need(n: int) -> int:
    return -(-n * PERCENT // 100)


def _emit_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, _, found in words(batch.column(1), fold=True):
            counts = np.diff(found.first)
            for k, own in enumerate(shingle_sets(found, SHINGLE)):
                n = len(own)
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(batch.column(0)[low + k], n).cast(pa.int64()), pa.array(own.view(np.int64)),
                         pa.array(np.full(n, n, np.int64)), pa.array(np.arange(n) <= n - _need(n)),
                         pa.array(np.full(n, min(int(counts[k]), SHINGLE), np.int32))],
                        names=["item_id", "shingle", "n_item", "sketch", "size"])


def _bit_map(shingles: DataFrame) -> np.ndarray:
    """Bit (hash mod 2^MAP_BITS) is set for every hash; comes to the driver with at most 2^MAP_BITS bits."""
    place = F.col("shingle").bitwiseAND(2**MAP_BITS - 1)
    found = shingles.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(shingle & 63 AS int))")).alias("bits")).toPandas()
    out = np.zeros(2**MAP_BITS // 64, np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(_U)


def _hits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & _U(2**MAP_BITS - 1)
    return (bits[(place >> _U(6)).astype(np.int64)] >> (place & _U(63)) & _U(1)).astype(bool)


def _emit_hits(maps, short: list[int]) -> Callable:
    """For documents that hit the sketch map: each distinct shingle in the map of all items."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, every = maps.value
        for batch in batches:
            for low, high, found in words(batch.column(2), fold=True):
                owner = found.owner()
                rows, of = [], []
                for size in (SHINGLE, *short):
                    own = windows(found.hash, size)
                    at = np.flatnonzero(_hits(every, own))
                    at = at[owner[at] == owner[at + size - 1]]
                    rows.append(own[at])
                    of.append(owner[at])
                hashes, of = np.concatenate(rows), np.concatenate(of)
                candidates = np.zeros(high - low, bool)
                candidates[of[_hits(sketch, hashes)]] = True
                hashes, of = hashes[candidates[of]], of[candidates[of]]
                order = np.lexsort((hashes, of))
                hashes, of = hashes[order], of[order]
                fresh = np.ones(len(of), bool)
                fresh[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
                at = pa.array(low + of[fresh])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(hashes[fresh].view(np.int64))],
                    names=["doc", "copy", "shingle"])

    return emit


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc, copy, item_id, n_item, n_shared): every document and item with containment >= 0.8.

    doc and copy as in keyed_texts. A-Z count as a-z. An item of fewer than five words is one
    shingle, its whole sequence, and is found wherever a document has that sequence. Null or
    wordless items and documents match nothing; rows with the same item_id are one item with
    all their shingles; items without an id keep a null item_id. Empty tables give no rows.
    """
    rows = map_batches(
        items.select(F.col("item_id").cast("long"), F.col("text").cast("string")), _emit_items,
        "item_id long, shingle long, n_item long, sketch boolean, size int")
    rows = staged(rows.distinct(), "items")
    short = [r["size"] for r in rows.filter(F.col("size") < SHINGLE).select("size").distinct().collect()]
    maps = docs.sparkSession.sparkContext.broadcast((_bit_map(rows.filter("sketch")), _bit_map(rows)))
    hits = map_batches(keyed_texts(docs), _emit_hits(maps, short), "doc long, copy long, shingle long").distinct()
    lookup = small_side(rows.select("item_id", "shingle", "n_item"))
    counted = hits.join(lookup, "shingle").groupBy("doc", "copy", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    return counted.filter(f"100 * n_shared >= {PERCENT} * n_item")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared), one row for each doc_id and item that match."""
    found = contaminated(docs, items).groupBy("doc", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
    return found.select(F.when(F.col("doc") != 2**63 - 1, F.col("doc")).alias("doc_id"), "item_id", "n_item", "n_shared")


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that contain an item."""
    found = staged(contaminated(docs, items).select(F.col("doc").alias("_doc"), F.col("copy").alias("_copy")).distinct(), "hits")
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1)) == F.col("_doc")) & (
        F.xxhash64(docs["text"].cast("string")) == F.col("_copy"))
    return docs.join(small_side(found), same, "left_anti")
