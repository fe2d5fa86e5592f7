"""Language of words and texts by a linear-chain conditional random field.

Words (runs of letters with their marks, lower-cased) get a score for each language from the sum of the weights of
their n-grams of two to four characters, those at a border being affixes, and of their entries in
one lexicon per language. Learned transitions say how likely a neighbour has the same language,
and forward-backward turns both into a probability for each word and language, so that a text
may switch. Weights, transitions and lexicons are learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import map_batches
from tillroll.llm.words import constants, mix

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"
#: The sample: so many rows of each language, and of each a stretch of so many characters.
SAMPLE_ROWS = 400
SAMPLE_CHARS = 1500
#: Most frequent words of a language's sample in its lexicon.
LEXICON = 1000
#: log2 of the n-gram weights per language.
BITS = 16
STEPS = 40
#: Words in a training sequence, which joins stretches of several texts.
SEQUENCE = 48
#: Words for which a task keeps scores, and words that it handles at once.
CACHE = 120_000
AT_ONCE = 1 << 17
#: Words that one step of forward-backward passes over in each stretch of a text.
STRETCH = 32

_U = np.uint64
_FACTORS = constants(5, 4)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of ^word$ with two to four characters."""
    text = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    word = np.cumsum(text == 2) - 1
    of, bucket = [], []
    for n in (2, 3, 4):
        count = len(text) - n + 1
        if count <= 0:
            continue
        total = np.full(count, _U(n), _U)
        for k in range(n):
            total += text[k : k + count] * _FACTORS[k]
        inside = word[:count] == word[n - 1 :]
        of.append(word[:count][inside])
        bucket.append((mix(total[inside]) >> _U(64 - BITS)).astype(np.int64))
    return np.concatenate(of), np.concatenate(bucket)


@dataclass
class Crf:
    """A learned model of any number of languages. step[i, j] weighs language j after i; lexicon lists
    the languages of a word by number."""

    languages: list[str]
    grams: np.ndarray
    entries: np.ndarray
    step: np.ndarray
    lexicon: dict[str, tuple[int, ...]]

    def member(self, words: list[str]) -> np.ndarray:
        found = np.zeros((len(words), len(self.languages)), np.float32)
        for at, word in enumerate(words):
            for k in self.lexicon.get(word, ()):
                found[at, k] = 1
        return found

    def scores(self, words: list[str]) -> np.ndarray:
        """One row per word: its score for each language."""
        of, bucket = _grams(words)
        found = [np.bincount(of, self.grams[bucket, k], len(words)) for k in range(len(self.languages))]
        return np.stack(found, 1).astype(np.float32) + self.member(words) @ self.entries


def _chances(score: np.ndarray, step: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over padded sequences: probability of each language for each word, and the
    expected number of each transition. The word before the first is of any language alike."""
    rows, length, kinds = score.shape
    weight = np.exp(score - score.max(-1, keepdims=True)) * inside[..., None] + ~inside[..., None]
    move = np.exp(step)
    alpha, beta = np.empty_like(weight), np.ones_like(weight)
    now = np.full((rows, kinds), 1 / kinds, np.float32)
    for t in range(length):
        new = (now @ move) * weight[:, t]
        now = np.where(inside[:, t, None], new / new.sum(-1, keepdims=True), now)
        alpha[:, t] = now
    for t in range(length - 1, 0, -1):
        old = (weight[:, t] * beta[:, t]) @ move.T
        beta[:, t - 1] = np.where(inside[:, t, None], old / old.sum(-1, keepdims=True), beta[:, t])
    both = alpha * beta
    chance = both / both.sum(-1, keepdims=True)
    moved = np.zeros((kinds, kinds))
    for t in range(1, length):
        pair = alpha[:, t - 1, :, None] * move * (weight[:, t] * beta[:, t])[:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        moved += pair[inside[:, t]].sum(0)
    return chance, moved


def train(rows: list[tuple[str, str]]) -> Crf:
    """A model from (language, text) rows; the same rows in the same order give the same model."""
    languages = sorted({lang for lang, _ in rows})
    number = {lang: k for k, lang in enumerate(languages)}
    texts = [(number[lang], WORD.findall(text.lower())) for lang, text in rows]
    counts = [Counter() for _ in languages]
    for k, found in texts:
        counts[k].update(found)
    lexicon: dict[str, tuple[int, ...]] = {}
    for k, count in enumerate(counts):
        for word, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon[word] = (*lexicon.get(word, ()), k)
    kinds = len(languages)
    model = Crf(languages, np.zeros((2**BITS, kinds), np.float32), np.zeros((kinds, kinds), np.float32),
                np.zeros((kinds, kinds), np.float32), lexicon)

    # Sequences that switch: stretches of 6 to 30 words of the texts, dealt at random and joined.
    random = np.random.default_rng(17)
    stretches = []
    for k, found in texts:
        at = 0
        while at < len(found):
            n = int(random.integers(6, 31))
            stretches.append((k, found[at : at + n]))
            at += n
    order = random.permutation(len(stretches))
    words = [w for i in order for w in stretches[i][1]]
    labels = np.array([stretches[i][0] for i in order for _ in stretches[i][1]], np.int64)
    if not words:
        return model
    types = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter((types[w] for w in words), np.int64, len(words))
    rows_ = -(-len(ids) // SEQUENCE)
    pad = rows_ * SEQUENCE - len(ids)
    inside = (np.arange(rows_ * SEQUENCE) < len(ids)).reshape(rows_, SEQUENCE)
    ids = np.concatenate([ids, np.zeros(pad, np.int64)]).reshape(rows_, SEQUENCE)
    labels = np.concatenate([labels, np.zeros(pad, np.int64)]).reshape(rows_, SEQUENCE)
    of, bucket = _grams(list(types))
    member = model.member(list(types))
    gold = np.eye(kinds, dtype=np.float32)[labels] * inside[..., None]
    gold_moves = np.zeros((kinds, kinds))
    np.add.at(gold_moves, (labels[:, :-1][inside[:, 1:]], labels[:, 1:][inside[:, 1:]]), 1)

    weights = [model.grams, model.entries, model.step]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    total = inside.sum()
    for turn in range(1, STEPS + 1):  # Adam on the log-likelihood with a small ridge
        score = np.stack([np.bincount(of, model.grams[bucket, k], len(types)) for k in range(kinds)], 1)
        score = (score + member @ model.entries).astype(np.float32)
        chance, moved = _chances(score[ids], model.step, inside)
        miss = ((gold - chance * inside[..., None]) / total).reshape(-1, kinds)
        by_type = np.stack([np.bincount(ids.ravel(), miss[:, k], len(types)) for k in range(kinds)], 1)
        slopes = [
            np.stack([np.bincount(bucket, by_type[of, k], 2**BITS) for k in range(kinds)], 1) - 1e-6 * model.grams,
            member.T @ by_type - 1e-6 * model.entries,
            (gold_moves - moved) / total - 1e-6 * model.step,
        ]
        for w, m, v, g in zip(weights, first, second, slopes, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-9)
    return model


class _Scores(dict):
    """Rows of a growing matrix of scores for the words met so far."""

    def __init__(self, model: Crf):
        super().__init__()
        self.model, self.new, self.rows = model, [], np.empty((1024, len(model.languages)), np.float32)

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = at = len(self)
        return at

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            while len(self) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            for k in range(0, len(self.new), 1 << 15):
                some = self.new[k : k + (1 << 15)]
                begin = len(self) - len(self.new) + k
                self.rows[begin : begin + len(some)] = self.model.scores(some)
            self.new = []
        return self.rows[ids]


def label(model: Crf, score: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probability of each language for each word of texts with so many words, one after another.

    Each text is cut into stretches. Their products of transitions and scores are formed side by
    side, carried from stretch to stretch of a text both ways, and then filled in side by side:
    the same result as going word by word, in steps as many as a stretch is long.
    """
    kinds = len(model.languages)
    parts = -(-counts // STRETCH)
    rows = int(parts.sum())
    if not rows:
        return np.empty((0, kinds), np.float32)
    first_part = np.concatenate(([0], np.cumsum(parts)))
    text = np.repeat(np.arange(len(counts)), parts)
    turn = np.arange(rows) - first_part[text]
    begin = np.concatenate(([0], np.cumsum(counts)))[text] + turn * STRETCH
    size = np.minimum(STRETCH, counts[text] - turn * STRETCH)
    inside = np.arange(STRETCH) < size[:, None]
    at = np.where(inside, begin[:, None] + np.arange(STRETCH), 0)
    weight = np.exp(score - score.max(-1, keepdims=True))[at]
    move = np.exp(model.step - model.step.max()).astype(np.float32)

    product = np.broadcast_to(np.eye(kinds, dtype=np.float32), (rows, kinds, kinds)).copy()
    for t in range(STRETCH):
        new = (product @ move) * weight[:, t, None, :]
        new /= new.max((1, 2), keepdims=True)
        product = np.where(inside[:, t, None, None], new, product)
    before, after = np.ones((rows, kinds), np.float32), np.ones((rows, kinds), np.float32)
    order = np.argsort(turn, kind="stable")
    ends = np.cumsum(np.bincount(turn))
    for low, high in zip(ends[:-1], ends[1:], strict=True):
        now = order[low:high]
        come = (before[now - 1][:, None, :] @ product[now - 1])[:, 0]
        before[now] = come / come.sum(-1, keepdims=True)
    for low, high in zip(ends[-2::-1], ends[:0:-1], strict=True):
        now = order[low:high]
        go = (product[now] @ after[now][..., None])[..., 0]
        after[now - 1] = go / go.sum(-1, keepdims=True)

    alpha, beta = np.empty_like(weight), np.empty_like(weight)
    now = before
    for t in range(STRETCH):
        new = (now @ move) * weight[:, t]
        now = np.where(inside[:, t, None], new / new.sum(-1, keepdims=True), now)
        alpha[:, t] = now
    now = after
    for t in range(STRETCH - 1, -1, -1):
        beta[:, t] = now
        old = (weight[:, t] * now) @ move.T
        now = np.where(inside[:, t, None], old / old.sum(-1, keepdims=True), now)
    both = alpha * beta
    return (both / both.sum(-1, keepdims=True))[inside]


_RUNS = pa.list_(pa.struct([("lang", pa.string()), ("n_words", pa.int64())]))


def _emit(model_sent) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Crf = model_sent.value
        names, cache = model.languages, _Scores(model)
        for batch in batches:
            best, sure, n_words, runs = [], [], [], []
            low = 0
            while low < batch.num_rows:
                found, counts = [], []
                while low < batch.num_rows and len(found) < AT_ONCE:
                    own = WORD.findall((batch.column(0)[low].as_py() or "").lower()) if names else []
                    found += own
                    counts.append(len(own))
                    low += 1
                counts = np.array(counts)
                chance = label(model, cache.of(found), counts) if names else np.empty((0, 0))
                ends = np.cumsum(counts)
                for begin, end in zip((ends - counts).tolist(), ends.tolist(), strict=True):
                    n_words.append(end - begin)
                    if end == begin:
                        best.append(UNKNOWN)
                        sure.append(0.0)
                        runs.append([])
                        continue
                    own = chance[begin:end]
                    mean = own.mean(0, dtype=np.float64)
                    k = int(mean.argmax())
                    best.append(names[k])
                    sure.append(min(1.0, float(mean[k])))
                    tags = own.argmax(1)
                    cuts = np.concatenate(([0], np.flatnonzero(np.diff(tags)) + 1, [end - begin]))
                    runs.append([{"lang": names[tags[a]], "n_words": int(b - a)} for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(best, pa.string()), pa.array(sure, pa.float64()),
                 pa.array(n_words, pa.int64()), pa.array(runs, _RUNS)],
                names=[*batch.schema.names[1:], "lang_pred", "score", "n_words", "runs"])

    return emit


def held_out(doc_id) -> F.Column:
    """Documents kept from learning: crc32 of the id as text leaves 2 when divided by 4. Null: no."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> Crf:
    """A model from docs (doc_id, text, lang): of each language SAMPLE_ROWS rows or all, chosen by
    a hash of the id, that are not held out and have a language, an id and a text. Of a long text
    a stretch is taken, which begins where a hash of the text says. A row per language passes through
    the driver."""
    usable = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    usable = usable.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("draw"), F.col("text").cast("string").alias("text"))
    rate = F.lit(0)
    for row in usable.groupBy("lang").count().collect():
        share = int(2**20 * min(1, 1.3 * SAMPLE_ROWS / row["count"]))
        rate = F.when(F.col("lang") == row["lang"], max(share, 1)).otherwise(rate)
    begin = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    stretch = F.substring("text", begin, F.lit(SAMPLE_CHARS))
    drawn = usable.filter(F.pmod("draw", F.lit(2**20)) < rate).select("lang", "draw", stretch.alias("text"))
    rows = sorted(tuple(r) for r in drawn.collect())
    taken, kept = Counter(), []
    for lang, _, text in rows:
        if taken[lang] < SAMPLE_ROWS:
            taken[lang] += 1
            kept.append((lang, text))
    return train(kept)


def identify(docs: DataFrame, model: Crf, column: str = "text") -> DataFrame:
    """docs with lang_pred, score, n_words and runs, replacing columns of these names.

    lang_pred has the highest mean probability over the words of the whole text, which is score;
    runs are stretches of words (lang, n_words) with the same most likely language. A null text,
    one without letters, or a model that learned from no rows: und, 0.0, no runs. Only `column`
    is read for the prediction.
    """
    rest = docs.drop("lang_pred", "score", "n_words", "runs")
    run = T.StructType([T.StructField("lang", T.StringType()), T.StructField("n_words", T.LongType())])
    schema = T.StructType([
        *rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run))])
    chosen = rest.select(docs[column].cast("string").alias("_text"), *rest.columns)
    return map_batches(chosen, _emit(docs.sparkSession.sparkContext.broadcast(model)), schema)
