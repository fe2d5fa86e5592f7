"""Byte-level BPE that gives the merges' exact result in one scan with backtracking.

A piece of text is covered by the longest token at its start, then the longest at its end, and
so on, as an Aho-Corasick automaton over all tokens reports them. Two neighbours are compatible
if merging their bytes anew would keep the border between them; a table holds what was found for
each pair. Where no shorter token fits either, the last token is taken back. A place that was
left once isn't tried again, so the work is linear in the piece. Decoding copies the bytes of
each token from one array by a table of offsets.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tillroll.llm.common import map_batches

#: Fixed value: the split of text before merging that byte-level vocabularies of this kind use.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: The same split of a text in ASCII, for the quicker engine.
ASCII_PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+"
    r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
#: Entries that the cache of pairs holds before it is emptied.
CACHE = 150_000
#: Pieces, and characters of them, that are found or asked for again before those not asked for since are let go.
RECENT, CACHE_CHARS = 150_000, 2_000_000
#: Rows whose tokens are held at once; a batch is answered in parts of so many.
ROWS = 256
#: Characters of a text that are split into pieces at once.
PART = 1 << 20

_NEVER = 1 << 60


def _byte_symbols() -> dict[str, int]:
    """The symbol that stands for each byte: itself if it is printable, else one above U+00FF in turn."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Pieces(dict):
    """Ids of pieces, found when first asked for. The frequent ones stay when the rest is let go."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.older: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece.encode().decode("latin-1"))
        self[piece] = ids
        self.held += len(piece)
        return ids

    def bound(self) -> None:
        if len(self) > RECENT or self.held > CACHE_CHARS:
            self.older = dict(self)
            self.clear()
            self.held = 0


class Vocabulary:
    """Tables of a tokenizers JSON file with a byte-level BPE model; texts of its bytes as Latin-1.

    Without `encodes` it holds only the bytes and offsets that decoding reads.
    """

    def __init__(self, content: str, encodes: bool = True):
        parsed = json.loads(content)
        model, symbols = parsed["model"], _byte_symbols()
        special = {t["content"]: t["id"] for t in parsed.get("added_tokens", [])}
        ids: dict[str, int] = {}
        texts: dict[int, bytes] = {}
        for token, number in model["vocab"].items():
            texts[number] = bytes(symbols[c] for c in token) if all(c in symbols for c in token) else token.encode()
            if token not in special:
                ids[texts[number].decode("latin-1")] = number
        texts |= {number: token.encode() for token, number in special.items()}
        self.size = max(texts) + 1
        self.length = [len(texts.get(k, b"")) for k in range(self.size)]
        self.bytes = np.frombuffer(b"".join(texts.get(k, b"") for k in range(self.size)), np.uint8)
        self.offset = np.concatenate(([0], np.cumsum(self.length)))
        self.encodes = encodes
        if not encodes:
            return

        self.rank, self.left, self.right = [-1] * self.size, [-1] * self.size, [-1] * self.size
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = (bytes(symbols[c] for c in x).decode("latin-1") for x in (a, b))
            made, pair = ids[a + b], (ids[a], ids[b])
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, *pair
            self.merge.setdefault(pair, rank)

        self.automaton = ahocorasick.Automaton()
        for text, number in ids.items():
            if len(text) == 1 or self.rank[number] >= 0:
                self.automaton.add_word(text, number)
        self.automaton.make_automaton()
        self.shorter = [-1] * self.size
        for text, number in ids.items():
            if number in self:
                cuts = (ids.get(text[:k], -1) for k in range(len(text) - 1, 0, -1))
                self.shorter[number] = next((x for x in cuts if x in self), -1)

        self.special = special
        self.special_split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.pieces, self.ascii_pieces = regex.compile(PIECES), re.compile(ASCII_PIECES)
        self.safe_cut = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})")
        self.known = _Pieces(self.encode_piece)
        self.fits: dict[int, bool] = {}

    def __contains__(self, number: int) -> bool:
        return number >= 0 and (self.rank[number] >= 0 or self.length[number] == 1)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b in order of rank leaves the border between them.

        Walks back through the last part of a and the first part of b that existed at the same
        time, latest first. They would have joined if their merge ranks below the ones that took
        them up; of equal ranks the left pair merges first.
        """
        rank, until_a, until_b = self.rank, _NEVER, _NEVER
        while True:
            joined = self.merge.get((a, b))
            if joined is not None and joined < until_a and joined <= until_b:
                return False
            if rank[a] > rank[b]:
                until_a, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                until_b, b = rank[b], self.left[b]
            else:
                return True

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        size, length, fits = len(piece), self.length, self.fits
        longest = [-1] * (size + 1)
        for end, number in self.automaton.iter(piece):
            longest[end - length[number] + 1] = number
        left_open = [True] * (size + 1)
        out: list[int] = []
        at, number = 0, longest[0]
        while at < size:
            to = at + length[number]
            fit = left_open[to]
            if fit and out:
                pair = out[-1] << 32 | number
                fit = fits.get(pair)
                if fit is None:
                    if len(fits) >= CACHE:
                        fits.clear()
                    fit = fits[pair] = self.compatible(out[-1], number)
            if fit:
                out.append(number)
                at, number = to, longest[to]
            elif self.shorter[number] >= 0:
                number = self.shorter[number]
            else:
                left_open[at] = False
                number = out.pop()
                at -= length[number]
        return tuple(out)

    def _parts(self, text: str) -> Iterator[str]:
        """Text in parts that no piece crosses: before a space between two words."""
        at = 0
        while len(text) - at > PART:
            cut = self.safe_cut.search(text, at + PART)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> list[int]:
        known = self.known
        out: list[int] = []
        for k, part in enumerate(self.special_split.split(text) if self.special_split else [text]):
            if k % 2:
                out.append(self.special[part])
            else:
                for some in self._parts(part):
                    known.bound()
                    pieces = self.ascii_pieces if some.isascii() else self.pieces
                    out.extend(chain.from_iterable(map(known.__getitem__, pieces.findall(some))))
        return out

    def decode(self, ids: np.ndarray) -> str:
        ids = ids[(ids >= 0) & (ids < self.size)]
        out = []
        for k in range(0, len(ids), PART):
            some = ids[k : k + PART]
            sizes = self.offset[some + 1] - self.offset[some]
            ends = np.cumsum(sizes)
            out.append(self.bytes[np.arange(ends[-1]) + np.repeat(self.offset[some] - ends + sizes, sizes)].tobytes())
        return b"".join(out).decode("utf-8", "replace")


_built: dict[str, Vocabulary] = {}


def _vocabulary(content: str, encodes: bool) -> Vocabulary:
    """The vocabulary this worker has; one that encodes decodes as well, so tasks of both kinds that
    take turns in a worker build it once and keep what it has found."""
    known = _built.get(content)
    if known is None or encodes and not known.encodes:
        _built.clear()
        known = _built[content] = Vocabulary(content, encodes)
    return known


def _parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def encode(docs: DataFrame, path: str, column: str = "text", decoded: bool = False) -> DataFrame:
    """docs with a column ids (array of int): the tokens of `column` under the vocabulary file at path.

    decoded adds a column decoded, what decode() gives for the ids, in the same pass.

    The same ids as the tokenizers library gives without special tokens added; strings of added
    tokens in a text become those tokens. Null counts as empty and gives an empty array. The file
    is read on the driver and sent to the tasks. Existing columns of these names are replaced.
    """
    with open(path, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(content.value, True)
        for batch in _parts_of(batches):
            encoded = [np.array(vocabulary.encode(x.as_py() or ""), np.int32) for x in batch.column(0)]
            ids = pa.ListArray.from_arrays(
                np.concatenate(([0], np.cumsum([len(x) for x in encoded]))).astype(np.int32),
                pa.array(np.concatenate(encoded) if encoded else np.empty(0, np.int32)))
            new = [ids]
            if decoded:
                new.append(pa.array([vocabulary.decode(x) for x in encoded], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], names=[*batch.schema.names[1:], *names])

    names = ["ids", "decoded"] if decoded else ["ids"]
    rest = docs.drop(*names)
    types = [T.ArrayType(T.IntegerType()), T.StringType()]
    schema = T.StructType([*rest.schema.fields, *map(T.StructField, names, types)])
    chosen = rest.select(docs[column].cast("string").alias("_text"), *rest.columns)
    return map_batches(chosen, emit, schema)


def decode(encoded: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """encoded with a column decoded (string) for the ids in `column`.

    Ids that the vocabulary lacks are left out; bytes that aren't UTF-8 become U+FFFD; null ids
    give null. An existing column decoded is replaced.
    """
    with open(path, encoding="utf-8") as file:
        content = encoded.sparkSession.sparkContext.broadcast(file.read())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(content.value, False)
        for batch in _parts_of(batches):
            texts = [vocabulary.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string())], names=[*batch.schema.names[1:], "decoded"])

    rest = encoded.drop("decoded")
    schema = T.StructType([*rest.schema.fields, T.StructField("decoded", T.StringType())])
    chosen = rest.select(encoded[column].cast("array<int>").alias("_ids"), *rest.columns)
    return map_batches(chosen, emit, schema)
