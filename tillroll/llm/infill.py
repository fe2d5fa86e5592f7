"""Fill-in-the-middle transformation with memoised content-defined chunks.

A document is cut at two places given in code points, while its text is UTF-8. A rolling hash over
the last 32 bytes ends a chunk wherever its upper bits are zero, so equal passages of different
documents give equal chunks. A cache keeps a summary for each chunk: its code points, and the byte
offset of every 64th. The cache is asked with the content of the chunk itself, so only equal
chunks share a summary. Sums of the counts of a document's chunks tell its length and the chunk
that holds a cut; the summary leads to within 64 code points of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import map_batches

#: The marks of prefix, suffix and middle, and the names of the three forms.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Upper bits of the hash that are zero at the end of a chunk (2**10 bytes on average), and the longest chunk.
ZERO_BITS, LONGEST = 10, 1 << 13
#: Code points between two entries of a summary.
STEP = 64
#: Bytes of texts worked on at once, and of chunks that the cache holds before it is emptied.
PART, CACHE = 1 << 22, 1 << 25

_FACTORS = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)).astype(np.uint32)


def chunk_ends(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ends of the chunks of texts that lie one behind another in data (bytes), each from its start.

    Ends are where the hash says so, at the ends of texts, and every LONGEST bytes without one; never
    within a character.
    """
    hashes = _FACTORS[data]
    for width in (1, 2, 4, 8, 16):
        hashes[width:] += hashes[:-width] << np.uint32(width)
    ends = np.flatnonzero(hashes >> np.uint32(32 - ZERO_BITS) == 0) + 1
    ends = np.union1d(ends, np.append(starts, len(data)))
    gaps = np.diff(np.append(0, ends))
    long = np.flatnonzero(gaps > LONGEST)
    if len(long):
        ends = np.union1d(ends, np.concatenate([np.arange(ends[k] - gaps[k] + LONGEST, ends[k], LONGEST) for k in long]))
    for _ in range(3):
        ends = ends + ((ends < len(data)) & (data[np.minimum(ends, len(data) - 1)] & 0xC0 == 0x80))
    ends = np.unique(ends)
    return ends[ends > 0]


class Chunks:
    """Summaries of chunks by their content."""

    def __init__(self):
        self.summaries: dict[bytes, tuple[int, np.ndarray]] = {}
        self.held = 0

    def summary(self, chunk: bytes) -> tuple[int, np.ndarray]:
        """(code points, byte offset of every STEPth) of a chunk."""
        found = self.summaries.get(chunk)
        if found is None:
            if self.held > CACHE:
                self.summaries.clear()
                self.held = 0
            places = np.flatnonzero(np.frombuffer(chunk, np.uint8) & 0xC0 != 0x80)
            found = self.summaries[chunk] = len(places), places[::STEP].astype(np.uint16)
            self.held += len(chunk)
        return found

    def cut(self, texts: list[bytes], places) -> list[tuple[int, list[int]]]:
        """(code points, byte offsets of the cuts) of each text; places(k, n) are the cuts of text k in code points."""
        data = b"".join(texts)
        starts = np.cumsum([0, *map(len, texts)])
        array = np.frombuffer(data, np.uint8)
        ends = chunk_ends(array, starts[:-1]) if data else np.empty(0, np.int64)
        begins = np.append(0, ends[:-1])
        summaries = [self.summary(data[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
        through = np.cumsum([0, *(count for count, _ in summaries)])
        first = np.searchsorted(begins, starts)
        out = []
        for k, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist())):
            n = int(through[b] - through[a])
            cuts = []
            for place in places(k, n):
                if place >= n:
                    cuts.append(len(texts[k]))
                    continue
                wanted = place + through[a]
                chunk = int(np.searchsorted(through, wanted, "right")) - 1
                rest = int(wanted - through[chunk])
                near = int(begins[chunk]) + int(summaries[chunk][1][rest // STEP])
                # A character has at most four bytes.
                stretch = array[near : near + 4 * STEP]
                cuts.append(near + int(np.flatnonzero(stretch & 0xC0 != 0x80)[rest % STEP]) - int(starts[k]))
            out.append((n, cuts))
        return out


def _draws(digest: str) -> list[int]:
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def _parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches with their texts (null: empty), about PART bytes at a time."""
    for batch in batches:
        texts, at, size = [], 0, 0
        for k, text in enumerate(batch.column(0)):
            texts.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
            size += len(texts[-1])
            if size >= PART or k + 1 == batch.num_rows:
                yield batch.slice(at, k + 1 - at), texts
                texts, at, size = [], k + 1, 0


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output: each text with its middle moved to the end.

    The text (null counts as empty) is cut at two places that a hash of seed and doc_id draws among
    its n + 1 places between code points. form tells the order of the parts behind their marks: psm
    is prefix, suffix, middle; spm is suffix, prefix, middle; plain is the text as it is, for texts
    that are empty or hold a mark, and for plain_percent of the others (spm for spm_percent of the rest).
    prefix_chars and middle_chars are null for plain. A null doc_id is drawn as an empty number. Rows
    are changed one by one: repeated rows give repeated results, an empty table gives none; columns
    of these five names are replaced, all others kept.
    """
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()]
    text = F.col("text").cast("string")
    marked = F.coalesce(text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE), F.lit(False))
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rest = docs.drop(*names)
    chosen = rest.select(
        text.alias("_text"), F.sha2(F.concat(F.lit(f"{seed}:"), number).cast("binary"), 256).alias("_digest"),
        marked.alias("_marked"), *rest.columns)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks()
        for batch, texts in _parts_of(batches):
            draws = [_draws(x) for x in batch.column(1).to_pylist()]
            holds = batch.column(2).to_pylist()

            def places(k: int, n: int) -> list[int]:
                return sorted(h % (n + 1) for h in draws[k][:2])

            rows = []
            for k, (n, cuts) in enumerate(chunks.cut(texts, places)):
                whole, (h3, h4) = texts[k], draws[k][2:]
                if not n or holds[k] or h3 % 100 >= 100 - plain_percent:
                    rows.append((n, PLAIN, None, None, whole))
                    continue
                low, high = places(k, n)
                parts = whole[: cuts[0]], whole[cuts[1] :], whole[cuts[0] : cuts[1]]
                form = SPM if h4 % 100 < spm_percent else PSM
                order = (1, 0, 2) if form == SPM else (0, 1, 2)
                rows.append((n, form, low, high - low, b"".join(chain.from_iterable((marks[i], parts[i]) for i in order))))
            columns = list(zip(*rows))
            new = [pa.array(columns[i], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))]
            new[4] = new[4].view(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], *new], names=[*batch.schema.names[3:], *names])
            pa.default_memory_pool().release_unused()

    schema = T.StructType([*rest.schema.fields, *map(T.StructField, names, kinds)])
    return map_batches(chosen, emit, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that `transform` gave as output in this form; null if either is null.

    A text in form psm or spm holds no mark, and no mark can begin in one part and end in the next,
    so the marks of output are the three that were put there.
    """
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = (F.element_at(parts, k) for k in (2, 3, 4))
    return (
        F.when(form == PSM, F.concat(first, middle, second)).when(form == SPM, F.concat(second, middle, first))
        .when(form == PLAIN, output))
