import random
import re
from collections import defaultdict

import numpy as np

from tillroll.llm import decontamination, ngram_join, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    found = WORD.findall((text or "").lower())
    return {tuple(found[k:k + size]) for k in range(max(1, len(found) - size + 1))} if found else set()


def components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    smallest = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            smallest[root(k)].append(i)
    return sorted(((i, len(s), min(smallest[root(k)], default=None)) for k, (i, s) in enumerate(sets)), key=str)


def mutated(seed, count, size, changes):
    """Chains and stars of near copies, with sizes around the bounds of bands."""
    pick = random.Random(seed)
    base = [f"w{pick.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(count):
        text = list(base)
        for _ in range(pick.randrange(changes)):
            text[pick.randrange(len(text))] = f"w{pick.randrange(10**6)}"
        text = text[: len(text) - pick.randrange(1 + size // 6)]
        out.append(" ".join(text))
    return out


def test_join_matches_brute_force(docs):
    texts = [t for seed, size in enumerate((5, 6, 7, 8, 9, 11, 15, 30, 60, 200)) for t in mutated(seed, 14, size, 2 + size // 14)]
    texts += ["Same Text here", "same text HERE", "", None, "one"] + ["a b c d e f"] * 3
    rows = list(enumerate(texts))
    random.Random(3).shuffle(rows)
    got = ngram_join.near_duplicate_components(docs(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == components(rows)


def test_join_of_long_sets_with_sketches_of_several_sizes(docs):
    texts = [t for seed, size in enumerate((2200, 4600, 4600)) for t in mutated(seed + 50, 12, size, 2 + size // 40)]
    rows = list(enumerate(texts))
    random.Random(4).shuffle(rows)
    assert {len(ngram_join._sketch(np.arange(n, dtype=np.uint64))) for n in (0, 2048, 2049, 4097)} == {16, 32, 64}
    got = ngram_join.near_duplicate_components(docs(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == components(rows)


def test_sketches_tell_long_unlike_sets_apart(docs, spark):
    near, other = mutated(60, 2, 4300, 20), mutated(61, 1, 4000, 2)
    nodes = {r.doc_id: r for r in ngram_join.shingle_nodes(docs(list(enumerate(near + other)))).collect()}
    sketches = spark.createDataFrame([(r.node, r.n_shingles, r.sketch) for r in nodes.values()], "node long, n long, sketch array<long>")
    a, b, c = (nodes[k].node for k in range(3))
    pairs = spark.createDataFrame([(a, b), (a, c), (b, c)], "a long, b long")
    assert [tuple(r) for r in ngram_join._near(pairs, sketches).collect()] == [(a, b)]


def test_join_of_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = ngram_join.near_duplicate_components(odd).collect()
    assert sorted((tuple(r) for r in got), key=str) == components(rows)
    kept = ngram_join.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "1", "2", "3", "4", "5", "7", "7", "9", "None"])


def test_empty_tables(docs, spark):
    none = docs([])
    items = spark.createDataFrame([], "item_id long, text string")
    assert ngram_join.near_duplicate_components(none).collect() == []
    assert substring_dedup.remove_repeats(none).collect() == []
    assert decontamination.contamination(none, items).collect() == []


def removal(rows, size):
    seen = set()
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0]))
    result = {}
    for row in order:
        found = WORD.findall(row[1] or "")
        stays = [True] * len(found)
        for k in range(len(found) - size + 1):
            window = tuple(found[k:k + size])
            if window in seen:
                stays[k:k + size] = [False] * size
            seen.add(window)
        kept = [w for w, s in zip(found, stays, strict=True) if s]
        result[row] = (row[0], len(found), len(found) - len(kept), " ".join(kept))
    return sorted((result[r] for r in rows), key=str)


def test_repeats_match_brute_force(docs):
    pick = random.Random(1)
    passage = [[f"p{k}_{j}" for j in range(45)] for k in range(3)]
    rows = []
    for i in range(60):
        text = [f"u{pick.randrange(40)}" for _ in range(pick.randrange(60))]
        for k in range(3):
            if pick.random() < 0.5:
                text += passage[k][pick.randrange(20):]
        rows.append((i, pick.choice([" ", "\n", " \t"]).join(text)))
    rows += [(100, " ".join(["x"] * 70)), (101, " ".join(["x"] * 25)), (102, rows[0][1]), (103, None), (104, "")]
    pick.shuffle(rows)
    got = substring_dedup.remove_repeats(docs(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == removal(rows, 20)


def test_repeats_of_odd_rows(odd):
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(odd).collect()]
    # Six words in turn: the windows that start at the first six are new, all words after are covered.
    assert len(got) == 11 and {(1, 11, 0), (2, 0, 0), (7, 18000, 18000 - 6), (7, 6, 0), (None, 9, 0)} <= set(got)


def test_containment_matches_brute_force(docs, spark, odd):
    pick = random.Random(4)
    items = [(k, " ".join(f"i{k}_{j}" for j in range(n))) for k, n in enumerate((1, 2, 4, 5, 6, 9, 14, 30, 41))]
    items += [(50, None), (51, ""), (52, "I0_0 i0_0")]
    rows = []
    for i in range(80):
        body = [f"u{pick.randrange(10**6)}" for _ in range(pick.randrange(200))]
        item = WORD.findall(pick.choice(items)[1] or "")
        for _ in range(pick.randrange(3)):
            if item:
                item[pick.randrange(len(item))] = "changed"
        at = pick.randrange(len(body) + 1)
        rows.append((i, " ".join(body[:at] + [w.upper() for w in item] + body[at:])))
    table = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, text in rows:
        for k, item in items:
            size = min(5, len(WORD.findall(item or "")))
            if size:
                x, y = shingles(item, size), shingles(text, size)
                if 100 * len(x & y) >= 80 * len(x):
                    want.add((i, k, len(x), len(x & y)))
    assert {tuple(r) for r in decontamination.contamination(docs(rows), table).collect()} == want
    clean = decontamination.remove_contaminated(docs(rows), table)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {x[0] for x in want}
    assert decontamination.remove_contaminated(odd, table).count() == 11
