"""Set similarity join on word shingles as a blocked sparse matrix product.

Think of the incidence matrix of documents by shingles. Two documents link when the overlap of
their rows, an entry of the matrix times its transpose, reaches the bound that their sizes give
for a Jaccard similarity of at least 0.8. The product is never formed whole:

* Rows with the same set are one row (a class).
* Rows are grouped by size so that linked rows lie in one band or two neighbouring ones; pairs
  of other bands are below the bound.
* Within a pair of bands the columns are dealt into m blocks by hash, where m exceeds the most
  shingles H by which linked rows can differ. So linked rows agree on whole blocks, and
  accumulating over equal blocks visits every pair that can reach the bound and few others.
  An empty block counts only for rows with so many of them that all agreeing blocks may be empty.
* Pairs of one block group are not all formed. Each row is first multiplied with a few pivot
  rows of its groups; rows linked by then share a label, and only pairs with different labels are formed
  afterwards, after a bound on their difference from parity sketches. The overlap of each pair
  that is left is counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import map_batches, meeting_route, small_side, staged
from tillroll.llm.components import components
from tillroll.llm.words import batches_of, constants, mix, routes, shingle_sets, words

#: Links need 100 * overlap >= PERCENT * union; the bands and blocks below are derived from it.
PERCENT = 80
#: 64-bit words of a parity sketch; sets of more than 128 shingles a word get twice, four times, ... as many.
SKETCH = 16
#: Pivots that a row is multiplied with before the remaining pairs are formed.
PIVOTS = 3

_U = np.uint64
_PART, _SALT, _KEY = (int(x) for x in constants(77, 3))


def _bands() -> np.ndarray:
    """Lower size bounds of bands: a set links only into its own band and the next ones to it."""
    bounds = [1, 2]
    while bounds[-1] < 2**40:
        bounds.append(max(bounds[-1] + 1, (bounds[-1] - 1) * 100 // PERCENT + 1))
    return np.array(bounds)


_BANDS = _bands()


def _blocks(band: int) -> tuple[int, int]:
    """(m, H) for the pairs of a band with itself and the next one."""
    most = int(_BANDS[band + 1]) - 1
    both = most + min(int(_BANDS[band + 2]) - 1, most * 100 // PERCENT)
    differ = both * (100 - PERCENT) // (100 + PERCENT)
    return differ + 3 + differ // 8, differ


def _node(own: np.ndarray) -> np.ndarray:
    """The 64-bit name of a set."""
    total = int(mix(own).sum(dtype=_U)) + int(mix(own ^ _U(_SALT)).sum(dtype=_U)) * _KEY + len(own)
    return mix(np.array([total % 2**64], _U))[0]


def _sketch(own: np.ndarray) -> np.ndarray:
    """Bit k says whether the number of shingles with hash k is odd, for hashes below a power of two.

    The sketch grows with the set, since one with far fewer bits than shingles is as good as random.
    """
    bits = 64 * SKETCH
    while 2 * bits < len(own):
        bits *= 2
    place = (mix(own ^ _U(_KEY)) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _keys(own: np.ndarray) -> np.ndarray:
    band = int(np.searchsorted(_BANDS, len(own), "right")) - 1
    out = []
    for pair in (band - 1, band):
        if pair < 0:
            continue
        m, differ = _blocks(pair)
        if not differ:  # such sets link only if they are the same
            continue
        at = (own % _U(m)).astype(np.int64)
        total = np.zeros(m, _U)
        np.add.at(total, at, mix(own ^ _U(_SALT)))
        count = np.bincount(at, minlength=m)
        name = mix(total + mix(np.arange(m, dtype=_U) * _U(_PART) + _U(pair * _KEY % 2**64)))
        empty = int((count == 0).sum())
        out.append(name if empty >= m - differ else name[count > 0])
    return np.concatenate(out) if out else np.empty(0, _U)


_NODES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("sketch", pa.list_(pa.int64()))])
_NODES_SQL = "doc_id long, n_shingles long, node long, sketch array<long>"
_KEYS = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("route", pa.int32())])
_KEYS_SQL = "key long, node long, n int, route int"


def _emit_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, nodes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, _U)
        sketches = []
        for low, _, found in words(batch.column(1), fold=True):
            for k, own in enumerate(shingle_sets(found), low):
                sizes[k], nodes[k] = len(own), _node(own)
                sketches.append(_sketch(own))
        node = pa.array(nodes.view(np.int64), mask=sizes == 0)
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in sketches]))).astype(np.int32)
        sketch = pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(sketches) if sketches else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), node, sketch], schema=_NODES)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, n, route), each set once per task."""
    seen: set[int] = set()
    for batch in batches:
        for _, _, found in words(batch.column(0), fold=True):
            rows = []
            for own in shingle_sets(found):
                if len(own) and (node := int(_node(own))) not in seen:
                    seen.add(node)
                    key = _keys(own)
                    rows.append((key, np.full(len(key), node, _U), np.full(len(key), len(own), np.int32)))
            if not rows:
                continue
            key, node, n = (np.concatenate(x) for x in zip(*rows, strict=True))
            yield batches_of(_KEYS, [[key, node, n, routes(key, node)]])


def _emit_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, found in words(batch.column(0), fold=True):
            sets = [own for own in shingle_sets(found) if len(own)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array([_node(own) for own in sets], _U).view(np.int64)),
                 pa.array([own.view(np.int64) for own in sets], pa.list_(pa.int64()))], names=["node", "shingles"])


def shingle_nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node, sketch): the size of each document's set, a 64-bit name of the set
    (equal sets have equal names; null for an empty set), and its parity sketch."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(texts, _emit_nodes, _NODES_SQL)


def shared_keys(docs: DataFrame) -> DataFrame:
    """(key, node, n) for block keys that at least two different sets have, staged.

    Two things keep a key of very many documents from meeting in one task: copies of a set count
    once per task, and routes() spreads what a block of texts already shows to be shared.
    """
    rows = map_batches(docs.select(F.col("text").cast("string")), _emit_keys, _KEYS_SQL)
    rows = rows.withColumn("meeting", meeting_route())
    meet = Window.partitionBy("key", "meeting")
    # Both figures in one projection, and the route as a column: one exchange and one sort.
    kept = rows.select("key", "node", "n", "route", F.min("node").over(meet).alias("low"), F.max("node").over(meet).alias("high"))
    kept = kept.filter("route > 0 OR low < high")
    return staged(kept.select("key", "node", "n").distinct(), "shared")


def _folded(sketch: Column, size: Column | int) -> Column:
    """The sketch over `size` words, a half, a quarter, ... of its own: hashes alike in their last bits fall together."""
    parts = F.sequence(F.lit(0), (F.size(sketch) / size).cast("int") - 1)
    def word(k: Column) -> Column:
        return F.aggregate(parts, F.lit(0).cast("long"), lambda x, part: x.bitwiseXOR(F.get(sketch, part * size + k)))
    return F.transform(F.sequence(F.lit(0), F.lit(size) - 1), word)


def _near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose sketches allow a link.

    Each shingle in which two sets differ flips one bit, so the sketches differ in no more bits.
    Of sketches of different lengths the longer is folded.
    """
    def side(end: str) -> DataFrame:
        return sketches.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("sketch").alias(f"s{end}"))

    size = F.least(F.size("sa"), F.size("sb"))
    alike = [F.when(F.size(s) == size, F.col(s)).otherwise(_folded(F.col(s), size)) for s in ("sa", "sb")]
    flips = F.zip_with(*alike, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    flipped = F.aggregate(flips, F.lit(0), lambda x, y: x + y)
    close = (100 + PERCENT) * flipped <= (100 - PERCENT) * (F.col("na") + F.col("nb"))
    sizes = 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")
    return pairs.join(side("b"), "b").join(side("a"), "a").filter(sizes & close).select("a", "b").distinct()


def _links(pairs: DataFrame, docs: DataFrame, first: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose overlap reaches the bound; counted exactly, on sets made anew
    from one document (first: node, doc_id) of each class that occurs."""
    pairs = staged(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = staged(first.join(ends, "node").select("doc_id").distinct(), "wanted")
    # Null ids cannot be joined on; their texts are read along with the wanted ones.
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chosen = texts.join(small_side(wanted), "doc_id", "left_semi").union(texts.filter("doc_id IS NULL"))
    sets = staged(map_batches(chosen.select("text"), _emit_sets, "node long, shingles array<long>"), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    overlap = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - overlap
    return left.join(pairs, "a").join(right, "b").filter(100 * overlap >= PERCENT * union).select("a", "b").distinct()


def _pivot_pairs(shared: DataFrame) -> DataFrame:
    """Pairs (a, b) of each node with the pivots that it shares most blocks with.

    The pivot of a block group is its node of the highest degree: a text from which many others
    were copied with small changes agrees with more of them than they do with one another.
    """
    pivots = shared.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("pivot"))
    counted = (
        shared.join(pivots, "key").filter("node <> pivot.node")
        .groupBy(F.col("node").alias("a"), F.col("pivot.node").alias("b")).agg(F.count("*").alias("blocks"))
    )
    best = F.slice(F.sort_array(F.collect_list(F.struct("blocks", "b")), asc=False), 1, PIVOTS)
    return counted.groupBy("a").agg(best.alias("best")).select("a", F.explode("best.b").alias("b"))


def _remaining_pairs(shared: DataFrame, sketches: DataFrame) -> DataFrame:
    """All pairs of nodes with different labels that share a block and whose sketches allow a link."""
    open_keys = shared.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    short = sketches.select("node", "n", F.when(F.size("sketch") == SKETCH, F.col("sketch")).otherwise(
        _folded(F.col("sketch"), SKETCH)).alias("sketch"))
    rows = shared.select("key", "node", "comp").join(open_keys.select("key"), "key").join(short, "node")
    words_of = [f"w{k}" for k in range(SKETCH)]
    rows = rows.select("key", "node", "n", "comp", *(F.col("sketch")[k].alias(w) for k, w in enumerate(words_of)))
    a, b = rows.alias("a"), rows.alias("b")
    flipped = sum((F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in words_of), F.lit(0))
    near = (
        (F.col("a.key") == F.col("b.key")) & (F.col("a.comp") < F.col("b.comp"))
        & ((100 + PERCENT) * flipped <= (100 - PERCENT) * (F.col("a.n") + F.col("b.n")))
    )
    pairs = a.join(b, near).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    return _near(pairs, sketches)


def link_nodes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, comp) for every class that has a link to a different class."""
    shared = shared_keys(docs)
    known = nodes.filter("node IS NOT NULL")
    first = known.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    sketches = known.join(shared.select("node").distinct(), "node").groupBy("node").agg(
        F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    sketches = staged(sketches, "sketches")
    groups = shared.groupBy("key").agg(F.count("*").alias("rows"))
    degrees = shared.join(groups, "key").groupBy("node").agg(F.sum("rows").alias("degree"))
    pivots = _pivot_pairs(shared.join(degrees, "node"))
    first_links = staged(_links(_near(pivots, sketches), docs, first), "pivot-links")
    comps = components(first_links)
    labelled = shared.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rest = staged(_links(_remaining_pairs(labelled, sketches), docs, first), "links")
    return components(first_links.union(rest))


def near_duplicate_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text; others are ignored).

    A-Z count as a-z; words are runs of other than space and 0x09-0x0D; the set holds the distinct
    five-word shingles, or the whole sequence of a shorter text. component_id is the smallest
    doc_id that links reach, the own one included. Null or wordless texts: 0 shingles, no links,
    their own id. Rows with the same doc_id each get their result; rows without a doc_id take part
    and get the component's smallest id, null if there is none. Empty input gives no rows.
    """
    nodes = staged(shingle_nodes(docs), "nodes")
    comps = link_nodes(docs, nodes)
    first = nodes.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    named = first.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    ids = staged(named.join(smallest, "comp").select("node", "component_id"), "ids")
    return nodes.join(ids, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is not the smallest of its component.

    Repeated rows of the kept id stay as they are; rows without an id stay unless linked to one.
    """
    drop = near_duplicate_components(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("_drop"))
    drop = small_side(staged(drop.distinct(), "copies"))
    return docs.join(drop, docs["doc_id"] == drop["_drop"], "left_anti")
