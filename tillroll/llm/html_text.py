"""Main text of web pages as the maximum-scoring run of tokens.

A page is a sequence of words and tags. Words score positive and tags negative, with weights
learned from labelled pages: those with one article or main element that holds words. A tag
weighs the more the rarer it is inside them, and a word the less the more often words that stand
directly in such an element (a link, a list item, a paragraph) lie outside. Words of elements whose
name or class is on a list (menus, adverts, comments) have a learned weight of their own.
Where these miss the marked element on some page, how much a word weighs against the tags is
searched for: the best run of as many labelled pages as possible is then the marked element, with
words outside it counted twice to leave a margin.
One linear scan finds the run with the largest sum; it looks at the same weights on every page,
and article elements are a tag like others. Only a main element bounds the scan, as a page has one
and says by it what is its content. Scripts and the like give no text, nor do listed elements
unless the labels show that such elements hold the article's text.
"""

from __future__ import annotations

import html
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import map_batches

#: Pages that the weights are learned from, chosen by a hash of the page.
SAMPLE_PAGES = 1000

# Elements of HTML by their role.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
    "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
NEVER = RAW | {
    "aside", "audio", "button", "canvas", "datalist", "dialog", "fieldset", "footer", "form", "head", "menu", "nav", "noscript",
    "object", "search", "select", "svg", "template", "video",
}
#: Words in class, id or role that name something other than the article.
ASIDE_WORDS = {
    "ad", "ads", "adsense", "adv", "advert", "advertisement", "advertising", "alert", "alertdialog", "banner", "breadcrumb",
    "breadcrumbs", "byline", "comment", "commentlist", "comments", "complementary", "consent", "contentinfo", "cookie",
    "cookies", "copyright", "dialog", "discussion", "disqus", "footer", "form", "gdpr", "header", "masthead", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "notification", "overlay", "pager", "pagination", "popup",
    "promo", "promoted", "promotion", "recommended", "related", "replies", "reply", "respond", "responses", "search", "share",
    "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget",
}
#: Elements whose class says something about the whole page, not about a part to leave out.
WHOLE = {"html", "body", "main", "article"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)?|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements by which words are told apart.
PLACES = BLOCKS | {"a"}
_CLOSES_P = BLOCKS - {"html", "body", "head"}
_ALONE = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}


def _leaves_out(name: str, rest: str, in_article: bool) -> bool:
    if name in NEVER or (name == "header" and not in_article):
        return True
    if not rest or "=" not in rest and "hidden" not in rest:
        return False
    for key, *values in _ATTRIBUTE.findall(rest):
        value, key = "".join(values), key.lower()
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key in ("class", "id", "role"):
            for part in value.split():
                named = [w.lower() for w in _NAME_WORD.findall(part)]
                if name in WHOLE and not {"comment", "comments", "reply", "related"} & set(named):
                    continue
                if named and named[0] not in ("has", "with", "no", "without") and ASIDE_WORDS & set(named):
                    return True
    return False


def _mark(name: str, rest: str) -> str:
    """`article` or `main`, by the name of an element or its role, else nothing."""
    roles = ["".join(v).lower() for key, *v in _ATTRIBUTE.findall(rest) if key.lower() == "role"] if "role" in rest.lower() else []
    return next((x for x in [*roles, name] if x in ("article", "main")), "")


@dataclass
class Page:
    """Tokens of a page: (`word` and the element it stands in, `listed`, or /name of a tag; words, text, block, element that marks
    them); tags have no text. `marks` counts the outermost article and main elements that hold words, `left` the
    tags within what is left out."""

    tokens: list[tuple[str, int, str | None, int, str]] = field(default_factory=list)
    marks: int = 0
    left: Counter = field(default_factory=Counter)


def read(page: str) -> Page:
    """The tokens of a page. A listed element shows as its first tag and its words. Tokens are marked `main`
    inside a main element, else `article` inside an article element, else not."""
    out = Page()
    stack: list[tuple[str, bool, str]] = []  # name, left out, mark
    hidden = block = 0
    inside, filled = {"": 0, "article": 0, "main": 0}, False

    def mark() -> str:
        return "main" if inside["main"] else "article" if inside["article"] else ""

    end = 0
    match = _TOKEN.match(page, end)
    while match:
        end = match.end()
        name = match["name"]
        if name is None:
            text = match.group()
            if not text.startswith(("<!", "<?")):
                text = html.unescape(text)
                count = len(text.split())
                if not hidden:
                    out.marks += bool(count and mark() and not filled)
                    filled = bool(mark()) and (filled or count > 0)
                    out.tokens.append((f"word {next((x[0] for x in reversed(stack) if x[0] in PLACES), '')}", count, text, block, mark()))
                elif count:
                    out.tokens.append(("listed", count, text, block, mark()))
        else:
            name, rest = name.lower(), match["rest"] or ""
            if match["close"]:
                block += name in BLOCKS
                left = False
                if any(x[0] == name for x in reversed(stack)):
                    while True:
                        was, left, marks = stack.pop()
                        hidden -= left
                        inside[marks] -= 1
                        if was == name:
                            break
                    filled = filled and bool(mark())
                if hidden or left:
                    out.left["/" + name] += 1
                else:
                    out.tokens.append(("/" + name, 0, None, block, mark()))
            else:
                block += name in BLOCKS
                if name == "body" or name in _CLOSES_P:
                    while stack and (stack[-1][0] == "p" or name == "body" and stack[-1][0] == "head"
                                     or name in _ALONE and stack[-1][0] == name):
                        _, left, marks = stack.pop()
                        hidden -= left
                        inside[marks] -= 1
                if hidden:
                    out.left["/" + name] += 1
                else:
                    out.tokens.append(("/" + name, 0, " " if name == "br" else None, block, mark()))
                if name in RAW:
                    close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)|\Z", re.I).search(page, end)
                    end = close.end()
                elif name not in VOID and not rest.rstrip().endswith("/"):
                    left = _leaves_out(name, rest, mark() != "")
                    stack.append((name, left, "" if left or hidden else _mark(name, rest)))
                    hidden += left
                    inside[stack[-1][2]] += 1
        match = _TOKEN.match(page, end) if end < len(page) else None
    return out


@dataclass
class Weights:
    """What a word and a tag of each name add to the sum of a run. by_place holds the part of a word's
    weight for words in some elements, `listed` is for those of listed elements, which give no text if
    they weigh nothing."""

    by_tag: dict[str, float]
    tag: float = -0.5
    word: float = 1.0
    by_place: dict[str, float] = field(default_factory=dict)
    listed: float = 0.0

    def of(self, kind: str, words: int) -> float:
        if kind[0] == "/":
            return self.by_tag.get(kind, self.tag)
        return words * (self.listed if kind == "listed" else self.word * self.by_place.get(kind, 1.0))

    def shows(self, kind: str) -> bool:
        return kind != "listed" or self.listed > 0


def best_run(scores: list[float]) -> tuple[int, int]:
    """(begin, end) of the run with the largest positive sum, the first one to reach it; (0, 0) if there is none."""
    best = total = 0.0
    begin, span = 0, (0, 0)
    for k, score in enumerate(scores):
        total += score
        if total <= 0:
            total, begin = 0.0, k + 1
        elif total > best:
            best, span = total, (begin, k + 1)
    return span


#: The least part of a word's weight: where nothing else scores, words in an unlikely place are still found.
LEAST_PLACE = 0.02
#: What the search tries: parts of the first word weight, the most and the least that a known tag weighs. Counts
#: alone come with the first part, the last most and the first least.
WORD_PARTS = [2.0 ** -k for k in range(9)]
MOST_TAG, LEAST_TAG = [-0.001, -0.01, -0.1], [-3.0, -math.inf]


def learn(pages: list[str]) -> Weights:
    """Weights from labelled pages: logarithms of how often a word or tag occurs inside the marked
    element against outside, positive for words and negative for tags. If the best run is then not the
    marked element on every page, the weight of words and the bounds of the tags' are those that miss
    it on the fewest pages, words outside counted twice; of equally good ones with the first such
    bounds the middle."""
    inside, outside = Counter(), Counter()
    labelled = []
    for page in pages:
        found = read(page)
        if found.marks != 1:
            continue
        labelled.append(found.tokens)
        for kind, words, _, _, mark in found.tokens:
            (inside if mark else outside)[kind] += 1 if kind[0] == "/" else words
        outside.update(found.left)
    places = [k for k in {*inside, *outside} if k.startswith("word ")]
    words_in, words_out = (sum(side[k] for k in places) for side in (inside, outside))
    if not words_in:
        return Weights({})
    first = min(3.0, max(0.5, math.log((words_in + 1) / (words_out + 1))))
    ratio = {k: math.log((inside[k] + 1) / (outside[k] + 1)) for k in {*inside, *outside, "listed"} if k not in places}
    listed = ratio.pop("listed")
    by_place = {k: max(LEAST_PLACE, min(1.0, (inside[k] + 1) / (outside[k] + 1))) for k in places}

    def weights(part: float, most: float, least: float) -> Weights:
        word = first * part
        return Weights(
            {k: max(least, min(most, v)) for k, v in ratio.items()}, word=word, tag=-word / 2,
            by_place=by_place, listed=max(0.0, min(word, listed)))

    def misses(tried: Weights, margin: int) -> int:
        wrong = 0
        for tokens in labelled:
            begin, end = best_run([
                tried.of(kind, words if mark or kind[0] == "/" else margin * words) for kind, words, _, _, mark in tokens])
            wrong += any((begin <= k < end) != bool(mark) for k, (kind, words, _, _, mark) in enumerate(tokens)
                         if words and tried.shows(kind))
        return wrong

    chosen = weights(WORD_PARTS[0], MOST_TAG[-1], LEAST_TAG[0])
    if not misses(chosen, 1):
        return chosen
    best: list[Weights] = []
    fewest = len(labelled) + 1
    for least, most in itertools.product(LEAST_TAG, MOST_TAG):
        wrong = [misses(weights(part, most, least), 2) for part in WORD_PARTS]
        if min(wrong) < fewest:
            fewest = min(wrong)
            best = [weights(part, most, least) for part, n in zip(WORD_PARTS, wrong, strict=True) if n == fewest]
    return best[len(best) // 2]


def main_text(page: str | None, weights: Weights) -> str:
    """The text of the best run: blocks in page order joined by an empty line."""
    if not page:
        return ""
    tokens = read(page).tokens
    if any(words and kind != "listed" and mark == "main" for kind, words, _, _, mark in tokens):
        tokens = [t for t in tokens if t[4] == "main"]
    begin, end = best_run([weights.of(kind, words) for kind, words, *_ in tokens])
    blocks: dict[int, list[str]] = {}
    for kind, _, text, block, _ in tokens[begin:end]:
        if text is not None and weights.shows(kind):
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(line for line in lines if line)


def learn_from(pages: DataFrame) -> Weights:
    """Weights from at most SAMPLE_PAGES different pages that may mark their article, those with the
    smallest hashes."""
    marked = pages.select(F.col("html").cast("string").alias("html")).filter(
        F.col("html").rlike(r"(?i)<(?:article|main)\b|\brole\s*=\s*[\"']?(?:main|article)\b"))
    drawn = marked.withColumn("draw", F.xxhash64("html"))
    draws = [r["draw"] for r in drawn.select("draw").distinct().orderBy("draw").limit(SAMPLE_PAGES).collect()]
    if not draws:
        return learn([])
    rows = drawn.filter(F.col("draw") <= draws[-1]).groupBy("draw").agg(F.min("html").alias("html")).collect()
    return learn([page for _, page in sorted((r["draw"], r["html"]) for r in rows)])


def extract(pages: DataFrame, weights: Weights, column: str = "html") -> DataFrame:
    """pages with text, the main text of `column`, and n_chars, its code points.

    A null or empty page, and one without words, gives the empty text and 0. Existing columns of
    these names are replaced; repeated rows each get their result; no rows give no rows.
    """
    sent = pages.sparkSession.sparkContext.broadcast(weights)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), sent.value) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=[*batch.schema.names[1:], "text", "n_chars"])

    rest = pages.drop("text", "n_chars")
    schema = T.StructType([*rest.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return map_batches(rest.select(pages[column].cast("string").alias("_page"), *rest.columns), emit, schema)
