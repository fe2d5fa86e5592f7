"""SentencePiece BPE by vectorised merge rounds over flat symbol arrays.

A text is cut into words that no merge can cross; words seen before are answered from a cache.
The symbols of all other words of a batch lie in one numpy array. Every round takes the best
rank among the neighbouring pairs of each word (a segmented minimum), merges all places of that
rank from left to right at once, computes anew only the pairs next to a merge, and takes words
without a pair out of the arrays, until none is left. Merging one rank at a time and all its
places at once gives the sequential result as long as no merge makes a pair of the same or a
better rank; a word where one does (runs of spaces, whose pieces tie) is merged one place at a
time from an agenda.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tillroll.llm.common import map_batches

#: Fixed values of the model format: the mark of a space, the kinds of pieces, the text of an unknown id.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNKNOWN_TEXT = " ⁇ "
#: Characters of texts, and of unknown words, that are worked on at once.
PART, FLAT = 1 << 20, 1 << 19
#: Characters of words the cache holds before it is emptied.
CACHE = 4_000_000

_NONE = np.int64(1 << 40)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a serialised message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("tillroll-each-byte", _each_byte)


class _Numbers(dict):
    """Words numbered in the order in which they are first asked for; `new` lists the latest."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class PieceModel:
    """Tables of a SentencePiece model file of type BPE with byte fallback and no normalisation rules."""

    def __init__(self, content: bytes):
        pieces: list[tuple[str, float, int]] = []
        settings, rules = {}, {}
        for number, value in _fields(content):
            if number == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
            elif number in (2, 3):
                (settings if number == 2 else rules).update(_fields(value))
        if settings.get(3) != 2 or not settings.get(35) or rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
            raise ValueError("only BPE models with byte fallback that keep text and white space as they are")
        if any(kind not in (NORMAL, UNKNOWN, CONTROL, BYTE) for _, _, kind in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = bool(rules.get(3, 1))
        self.size = len(pieces)
        self._decoding(pieces)
        self._merging(pieces)

    def _decoding(self, pieces: list[tuple[str, float, int]]) -> None:
        def shown(text: str, kind: int) -> bytes:
            if kind == BYTE:
                return bytes([int(text[1:-1], 16)])
            return {CONTROL: "", UNKNOWN: UNKNOWN_TEXT}.get(kind, text.replace(SPACE, " ")).encode()

        texts = [shown(text, kind) for text, _, kind in pieces]
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.offset = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        self.spaced = np.array([kind == NORMAL and text.startswith(SPACE) for text, _, kind in pieces])
        self.hidden = np.array([kind == CONTROL for _, _, kind in pieces])

    def _merging(self, pieces: list[tuple[str, float, int]]) -> None:
        ids = {text: k for k, (text, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.of_byte = [0] * 256
        for k, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.of_byte[int(text[1:-1], 16)] = k
        # Characters that are no piece but part of one get symbols behind the pieces; one more stands for all others.
        symbols = dict(ids)
        for c in sorted({c for text in ids for c in text} - ids.keys()):
            symbols[c] = self.size + len(symbols) - len(ids)
        self.other = self.size + len(symbols) - len(ids)
        self.symbol = np.full(0x110000, self.other, np.int64)
        for text, number in symbols.items():
            if len(text) == 1:
                self.symbol[ord(text)] = number
        self.symbol[ord(" ")] = self.symbol[ord(SPACE)]

        order = {score: rank for rank, score in enumerate(sorted({pieces[k][1] for k in ids.values()}, reverse=True))}
        pairs = [
            (symbols[text[:cut]] * (self.other + 1) + symbols[text[cut:]], order[pieces[k][1]], k)
            for text, k in ids.items() for cut in range(1, len(text)) if text[:cut] in symbols and text[cut:] in symbols]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        # A last row that no pair has stands for pairs that do not merge.
        self.pair = np.append(table[:, 0], np.iinfo(np.int64).max)
        self.rank = np.append(table[:, 1], _NONE)
        self.made = np.append(table[:, 2], -1)
        self.words = self._word_pattern(ids)
        self.of_byte = np.array(self.of_byte, np.int32)
        self._forget()

    @staticmethod
    def _word_pattern(ids: dict[str, int]) -> re.Pattern:
        """Words that no merge crosses. A space begins a word, letters and other characters stand in
        different words, and characters of no longer piece stand alone, where the pieces allow it."""
        longer = [text for text in ids if len(text) > 1]
        if any(re.search(f"[^{SPACE}]{SPACE}", text) for text in longer):
            return re.compile(".+", re.DOTALL)
        joined = {c for text in longer for c in text}
        single = "".join(map(re.escape, sorted({c for c in ids if len(c) == 1} - joined - {SPACE})))
        letters = {c for c in joined if c.isalpha()}
        mixed = any(len({c in letters for c in text.lstrip(SPACE)}) > 1 for text in longer)
        kinds = "" if mixed else "".join(map(re.escape, sorted(letters)))
        return re.compile("|".join(
            [f"[{single}]"] * bool(single) + [f" *[{kinds}]+"] * bool(kinds) + [f" *[^ {single}{kinds}]+", " +"]))

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rows of the pair table for pairs of symbols; the last row where there is none."""
        wanted = left * (self.other + 1) + right
        at = np.searchsorted(self.pair, wanted)
        return np.where(self.pair[at] == wanted, at, len(self.pair) - 1)

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and their number per word; all words are in one array of symbols."""
        none = len(self.pair) - 1
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        symbol = self.symbol[points]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        place = np.arange(len(symbol))
        word_of = word
        pair = np.full(len(symbol), none)
        inside = np.flatnonzero(word[1:] == word[:-1])
        pair[inside] = self._find(symbol[inside], symbol[inside + 1])
        done, by_agenda = np.full(len(symbol), -1), np.zeros(len(words), bool)
        while len(symbol):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            rank = self.rank[pair]
            size = np.diff(np.append(first, len(symbol)))
            best = np.repeat(np.minimum.reduceat(rank, first), size)
            over = (best == _NONE) | by_agenda[word]
            if over.any():
                done[place[over]] = symbol[over]
                symbol, word, place, pair, rank, best = (x[~over] for x in (symbol, word, place, pair, rank, best))
                if not len(symbol):
                    break
            hit = rank == best
            count = np.arange(len(symbol))
            begin = hit & ~np.concatenate(([False], hit[:-1]))
            at = np.flatnonzero(hit & ((count - np.maximum.accumulate(np.where(begin, count, 0))) % 2 == 0))
            made = self.made[pair[at]]
            # Neighbours as a merge from left to right finds them: the left one merged, the right one not yet.
            merged = symbol.copy()
            merged[at + 1] = made
            left, right = np.maximum(at - 1, 0), np.minimum(at + 2, len(symbol) - 1)
            has_left, has_right = (at > 0) & (word[left] == word[at]), (at + 2 < len(symbol)) & (word[right] == word[at])
            before = np.where(has_left, self._find(merged[left], made), none)
            after = np.where(has_right, self._find(made, symbol[right]), none)
            early = np.minimum(self.rank[before], self.rank[after]) <= best[at]
            if early.any():
                by_agenda[word[at[early]]] = True
                stays = ~by_agenda[word[at]]
                at, made = at[stays], made[stays]
            symbol[at], kept = made, np.ones(len(symbol), bool)
            kept[at + 1] = False
            stale = np.zeros(len(symbol), bool)
            stale[at] = stale[np.maximum(at - 1, 0)] = True
            stale[np.maximum(at - 2, 0)] = True
            pair[at] = none
            symbol, word, place, pair, stale = (x[kept] for x in (symbol, word, place, pair, stale))
            at = np.flatnonzero(stale)
            right = np.minimum(at + 1, len(symbol) - 1)
            pair[at] = np.where((at + 1 < len(symbol)) & (word[at] == word[right]), self._find(symbol[at], symbol[right]), none)
        for k in np.flatnonzero(by_agenda).tolist():
            begin = np.searchsorted(word_of, k)
            done[begin : begin + len(words[k])] = self._by_agenda(words[k])
        return self._ids_of(points, word_of, done, len(words))

    def _ids_of(self, points: np.ndarray, word: np.ndarray, symbol: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number per word for symbols at the places of their first characters, -1 elsewhere."""
        at = np.flatnonzero(symbol >= 0)
        word, symbol = word[at], symbol[at].astype(np.int32)
        unknown = symbol >= self.size
        if unknown.any():
            lost = points[at[unknown]]
            width = np.ones(len(symbol), np.int64)
            width[unknown] = 1 + (lost > 0x7F) + (lost > 0x7FF) + (lost > 0xFFFF)
            text = lost.astype("<u4").tobytes().decode("utf-32-le").encode()
            symbol, word = np.repeat(symbol, width), np.repeat(word, width)
            symbol[np.repeat(unknown, width)] = self.of_byte[np.frombuffer(text, np.uint8)]
        return symbol, np.bincount(word, minlength=words)

    def _by_agenda(self, word: str) -> list[int]:
        """Symbols of a word merged one pair at a time: the best rank, of equal ones the leftmost; -1 where
        a character was merged into one before."""
        symbol = self.symbol[np.frombuffer(word.encode("utf-32-le"), np.uint32)].tolist()
        size = len(symbol)
        following, previous = list(range(1, size + 1)), list(range(-1, size - 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(lefts: list[int]) -> None:
            rows = self._find(np.array([symbol[i] for i in lefts]), np.array([symbol[following[i]] for i in lefts]))
            for i, rank, made in zip(lefts, self.rank[rows].tolist(), self.made[rows].tolist()):
                if made >= 0:
                    heapq.heappush(agenda, (rank, i, symbol[i], symbol[following[i]], made))

        offer(list(range(size - 1)))
        while agenda:
            _, i, left, right, made = heapq.heappop(agenda)
            j = following[i]
            if symbol[i] != left or j >= size or symbol[j] != right:
                continue
            symbol[i], symbol[j], following[i] = made, -1, following[j]
            if following[i] < size:
                previous[following[i]] = i
            offer([k for k in (previous[i], i) if k >= 0 and following[k] < size])
        return symbol

    def _forget(self) -> None:
        self.known, self.flat, self.start, self.held = _Numbers(), np.empty(0, np.int32), np.zeros(1, np.int64), 0

    def _learn(self) -> None:
        """Merges the words numbered since the last call, FLAT characters at a time."""
        new, flats, counts = self.known.new, [self.flat], []
        ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        bounds = [0, *(np.flatnonzero(np.diff(ends // FLAT)) + 1).tolist(), len(new)]
        for a, b in zip(bounds, bounds[1:]):
            if b > a:
                flat, count = self.merge_words(new[a:b])
                flats.append(flat)
                counts.append(count)
        if new:
            self.flat = np.concatenate(flats)
            self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(np.concatenate(counts))))
            self.held += int(ends[-1])
            self.known.new = []

    def _parts(self, text: str) -> Iterator[str]:
        """Text in parts that end where a word does."""
        at = 0
        while len(text) - at > PART:
            cut = re.compile("(?<=[^ ]) ").search(text, at + PART)
            if not cut or not self.words.match(" "):
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. New words of all texts, PART characters at a time, are merged together."""
        parts = (
            (k, part) for k, text in enumerate(texts)
            for part in self._parts((" " + text if self.prefix else text).replace(SPACE, " ") if text else ""))
        found: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, np.ndarray]] = []
        size = 0
        for k, part in parts:
            words = self.words.findall(part)
            waiting.append((k, np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))))
            size += len(part)
            if size >= PART:
                self._answer(waiting, found)
                waiting, size = [], 0
        if waiting:
            self._answer(waiting, found)
        return [np.concatenate(x) if len(x) > 1 else x[0] for x in found]

    def _answer(self, waiting: list[tuple[int, np.ndarray]], found: list[list[np.ndarray]]) -> None:
        self._learn()
        numbers = np.concatenate([x for _, x in waiting])
        begin, size = self.start[numbers], self.start[numbers + 1] - self.start[numbers]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)]
        ends = np.append(0, ends)
        at = 0
        for k, some in waiting:
            found[k].append(ids[ends[at] : ends[at + len(some)]])
            at += len(some)
        if self.held > CACHE:
            self._forget()

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; ids outside the model are left out, bytes that are no UTF-8 become U+FFFD each."""
        ids = ids[(ids >= 0) & (ids < self.size)]
        ids = ids[~self.hidden[ids]]
        if not len(ids):
            return ""
        out = []
        for k in range(0, len(ids), PART):
            some = ids[k : k + PART]
            sizes = self.offset[some + 1] - self.offset[some]
            ends = np.cumsum(sizes)
            out.append(self.bytes[np.arange(ends[-1]) + np.repeat(self.offset[some] - ends + sizes, sizes)].tobytes())
        text = b"".join(out).decode("utf-8", "tillroll-each-byte")
        return text[1:] if self.prefix and self.spaced[ids[0]] else text


_built: dict[bytes, PieceModel] = {}


def _model(content: bytes) -> PieceModel:
    if content not in _built:
        _built.clear()
        _built[content] = PieceModel(content)
    return _built[content]


def _rows_of(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches whose first column, texts or lists, holds about limit elements at most, or one row."""
    for batch in batches:
        column = batch.column(0)
        sizes = np.array([len(x) if x.is_valid else 0 for x in column] if pa.types.is_list(column.type)
                         else [x.as_buffer().size if x.is_valid else 0 for x in column])
        group = np.cumsum(sizes) // limit
        starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def encode(docs: DataFrame, path: str, column: str = "text", decoded: bool = False) -> DataFrame:
    """docs with a column ids (array of int): the tokens of `column` under the model file at path.

    The ids are those the sentencepiece library gives without begin, end and sampling; a character
    that is in no piece becomes its bytes. decoded adds a column decoded, what decode() gives for
    the ids, in the same pass. Null counts as empty and gives an empty array (decoded: the empty
    text). Rows are answered one by one, so repeated rows and an empty table need no care; existing
    columns of these names are replaced, all others kept. The file, some hundred kB, is read on the
    driver and sent to the tasks.
    """
    with open(path, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(content.value)
        for batch in _rows_of(batches, 4 * PART):
            encoded = model.encode([x or "" for x in batch.column(0).to_pylist()])
            new = [pa.ListArray.from_arrays(
                np.concatenate(([0], np.cumsum([len(x) for x in encoded]))).astype(np.int32), pa.array(np.concatenate(encoded)))]
            if decoded:
                new.append(pa.array([model.decode(x) for x in encoded], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], names=[*batch.schema.names[1:], *names])
            pa.default_memory_pool().release_unused()

    names = ["ids", "decoded"] if decoded else ["ids"]
    rest = docs.drop(*names)
    types = [T.ArrayType(T.IntegerType()), T.StringType()]
    schema = T.StructType([*rest.schema.fields, *map(T.StructField, names, types)])
    return map_batches(rest.select(docs[column].cast("string").alias("_text"), *rest.columns), emit, schema)


def decode(encoded: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """encoded with a column decoded (string) for the ids in `column`, as the library's decode gives it.

    One space at the front, which encoding adds, is taken off. Null ids give null; ids the model
    lacks are left out; bytes that form no character become U+FFFD. An existing column decoded is
    replaced, all others kept.
    """
    with open(path, "rb") as file:
        content = encoded.sparkSession.sparkContext.broadcast(file.read())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(content.value)
        for batch in _rows_of(batches, PART):
            texts = [model.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string())], names=[*batch.schema.names[1:], "decoded"])

    rest = encoded.drop("decoded")
    schema = T.StructType([*rest.schema.fields, T.StructField("decoded", T.StringType())])
    return map_batches(rest.select(encoded[column].cast("array<int>").alias("_ids"), *rest.columns), emit, schema)
