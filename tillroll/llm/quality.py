"""Quality rules as a short-circuit cascade of Spark expressions.

Each rule rejects a text by one figure. A sample shows what share of texts a rule rejects and how
much work it takes, counted in characters read rather than timed, so that equal data give equal
orders; rules run in the order of rejections per work, and a text that one rejects is not measured
for the next ones. Figures that are returned anyway are columns by then and cost next to nothing. The order changes the work and which rule is named first, never
whether a text is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import let

#: Different texts that order the rules, those with the smallest hashes.
SAMPLE_ROWS = 2000

_SPACES = " \t\n\x0b\x0c\r"
_WORD = "[^\\x20\\x09-\\x0D]"


def words(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, _SPACES, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_WORD))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(found: Column) -> Column:
    """Words inside 5-word windows that occur at least twice in the array.

    Windows are compared by a 64-bit hash. Most texts have no window twice, which counting the
    distinct hashes shows; only the others sort theirs to find the places.
    """
    count = F.size(found) - 4
    hashes = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(*(F.element_at(found, i + k) for k in range(5))))

    def twice(ordered: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def covered(places: Column) -> Column:
        last = F.lit(2**30)
        steps = F.transform(places, lambda p, k: F.least(F.lit(5), F.coalesce(F.get(places, k + 1), last) - p))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def counted(own: Column) -> Column:
        ordered = F.array_sort(F.transform(own, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(let(ordered, twice), covered)

    found_twice = let(hashes, lambda own: F.when(F.size(F.array_distinct(own)) == F.size(own), 0).otherwise(counted(own)))
    return F.when(count >= 2, found_twice).otherwise(0).cast("long")


#: Work besides reading characters, in characters: to start a pattern on a word, to hash a word into a set.
PATTERN_WORK, SET_WORK = 20, 10


@dataclass(frozen=True)
class Rule:
    """A name, an expression that is true for a bad text, and the work of finding that out, in characters
    read. Both are over the columns text, words, n_words, word_chars, n_symbols, n_dup_lines."""

    name: str
    fails: Column
    work: Column


def _chars(pattern: str) -> Column:
    return F.length("text") - F.length(F.regexp_replace("text", pattern, ""))


def rules() -> list[Rule]:
    """The rules of the registered query. All are false for a text without words."""
    n, chars, one = F.col("n_words"), F.length("text"), F.lit(1)
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n, one),
        Rule("mean_word", (F.col("word_chars") > 15 * n) | (F.col("word_chars") < 2 * n), one),
        Rule("dup_lines", (F.col("n_dup_lines") > 0) & (2 * F.col("n_dup_lines") > F.size(F.split("text", "\n", -1))),
             F.when(F.col("n_dup_lines") > 0, chars).otherwise(one)),
        Rule("shouting", 2 * _chars("[A-Z]") > _chars("[A-Za-z]"), 2 * chars),
        Rule("no_letters", 10 * F.size(F.filter("words", lambda w: ~w.rlike("\\p{L}"))) > 6 * n, chars + PATTERN_WORK * n),
        Rule("few_forms", (n >= 50) & (10 * F.size(F.array_distinct("words")) < n),
             F.when(n >= 50, chars + SET_WORK * n).otherwise(one)),
    ]


def order_rules(docs: DataFrame, found: list[Rule]) -> list[Rule]:
    """The rules by rejections per work on a sample of docs, a table with the columns that they need.

    The sample has at most SAMPLE_ROWS different texts in the order of their hashes, so neither the
    order of rows nor copies of a text decide. One pass counts for all rules. Ties go by name.
    """
    if not found:
        return []
    total = docs.count()
    share = int(2**20 * min(1, 2 * SAMPLE_ROWS / max(total, 1))) + 1
    drawn = docs.withColumn("draw", F.xxhash64("text")).filter(F.pmod(F.hash("text"), F.lit(2**20)) < share)
    sample = drawn.dropDuplicates(["draw"]).orderBy("draw").limit(SAMPLE_ROWS)
    row = sample.agg(F.count(F.lit(1)), *(x for r in found for x in (F.count_if(r.fails), F.avg(r.work)))).first()

    def worth(k: int) -> float:
        return (row[2 * k + 1] + 0.5) / (row[0] + 1) / max(row[2 * k + 2] or 0, 1)

    return [found[k] for k in sorted(range(len(found)), key=lambda k: (-worth(k), found[k].name))]


def cascade(ordered: list[Rule]) -> Column:
    """The name of the first rule that rejects, null if none does; later rules aren't evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(ordered):
        verdict = F.when(rule.fails, F.lit(rule.name)).otherwise(verdict)
    return verdict


def measure(docs: DataFrame, ordered: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule).

    base_failed: fewer than 10 words, or more than a fifth of them in repeated 5-word windows.
    kept: neither that nor rejected by a rule; rule names the first that rejects, `base` if that
    came first. Null text counts as empty. Every row gets its result; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text")).withColumn("words", words(F.col("text")))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    rows = rows.select(
        "doc_id", "n_words", "text", "words", word_chars(F.col("text")).alias("word_chars"), n_symbols(F.col("text")).alias("n_symbols"),
        n_dup_lines(F.col("text")).alias("n_dup_lines"))
    ordered = order_rules(rows, rules()) if ordered is None else ordered
    rows = rows.withColumn("n_repeat_words", n_repeat_words(F.col("words")))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    rows = rows.withColumn("rule", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(ordered)))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("rule").isNull().alias("kept"), "rule")
