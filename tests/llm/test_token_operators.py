import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillroll.llm import infill, piece_bpe, turn_repair
from tillroll.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
ANY_TEXT = st.text(alphabet=st.one_of(st.sampled_from("abcdefth  \n\t'.=0127▁é漢🎉"), st.characters(exclude_categories=["Cs"])))


# ---- pieces -----------------------------------------------------------------


@pytest.fixture(scope="module")
def models():
    with open(PATH, "rb") as file:
        return piece_bpe.PieceModel(file.read()), sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(models, texts):
    own, library = models
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text), text[:100]
        assert own.decode(ids) == library.decode(ids.tolist()), text[:100]


@settings(max_examples=200, deadline=None)
@given(st.lists(ANY_TEXT, max_size=6))
def test_same_pieces_as_the_library(models, texts):
    same(models, texts)


def test_pieces_in_any_order_and_odd_texts(models):
    rng = random.Random(5)
    pieces = [models[1].id_to_piece(k).replace("▁", " ") for k in range(259, 32000)]
    same(models, ["".join(rng.choice(pieces) for _ in range(60)) for _ in range(400)])
    same(models, ["", " ", "  a  b ", "a\0b", "▁x▁▁ y", "\r\n\t", "\ufeffx", "<s></s><unk><0x41>", " " * 1000 + "x" + " " * 37,
                  "a" * 3000, "漢字" * 500, "—" * 333, "abc" * 20000, "🎉é" * 99])


def test_parts_blocks_and_a_small_cache(models, monkeypatch):
    for name, value in (("PART", 40), ("FLAT", 16), ("CACHE", 60)):
        monkeypatch.setattr(piece_bpe, name, value)
    same(models, ["some words and  more of them\nwith lines " * 20, "", "x" * 200, "again the same words " * 9, "▁" * 50])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(3, 31999), max_size=12))
def test_pieces_of_any_ids_decode_alike(models, ids):
    if not any(3 <= k <= 258 for k in ids):
        assert models[0].decode(np.array(ids, np.int32)) == models[1].decode(ids)


def test_a_long_word_without_a_border(models):
    rng = random.Random(2)
    same(models, ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(50_000))])


def test_piece_columns(odd, models):
    rows = piece_bpe.encode(odd.withColumn("ids", F.lit("old")), PATH, decoded=True).collect()
    assert len(rows) == 11 and all(r.ids == models[1].encode(r.text or "") for r in rows)
    assert all(r.decoded == (r.text or "") and r.score == 1.0 for r in rows)
    again = piece_bpe.decode(piece_bpe.encode(odd, PATH).withColumn("ids", F.when(F.col("doc_id") != 7, F.col("ids"))), PATH)
    assert all(r.decoded == (None if r.ids is None else r.text or "") for r in again.collect())
    assert piece_bpe.encode(odd.limit(0), PATH).count() == 0


# ---- fill in the middle -----------------------------------------------------


def brute_infill(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    low, high = sorted(x % (len(text) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(text), "plain", None, None, text
    p, m, s = text[:low], text[low:high], text[high:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return len(text), form, low, high - low, out


def test_infill_against_brute_force(spark, odd):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "é", "漢", "🎉", "<", "P", ">", "<M", "\n", "word "]) for _ in range(rng.choice([1, 3, 64, 700]))) for _ in range(200)]
    made = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(900, "has a <S> in it")], "doc_id long, text string")
    for docs in (odd.withColumn("output", F.lit(3)), made, made.union(made), made.limit(0)):
        rows = infill.transform(docs)
        rows = rows.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_infill(r.doc_id, r.text)
            assert r.back == (r.text or "")
    assert {r.form for r in rows} <= {"plain"} and {r.score for r in infill.transform(odd).collect()} == {1.0}


def test_cuts_at_any_place(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(infill, "CACHE", 5000)
    chunks = infill.Chunks()
    passage = "".join(rng.choice(["a", "é", "漢", "🎉", " "]) for _ in range(9000))
    for _ in range(100):
        texts = [rng.choice(["", "x", passage, passage[rng.randint(0, 8000):], "z" * 20000, "漢" * rng.randint(1, 9000)]) for _ in range(5)]
        cuts = [[0, len(t), *(rng.randint(0, len(t)) for _ in range(3))] for t in texts]
        for t, (n, found), wanted in zip(texts, chunks.cut([t.encode() for t in texts], lambda k, n: cuts[k]), cuts):
            assert n == len(t) and found == [len(t[:k].encode()) for k in wanted]


def test_shared_passages_share_chunks():
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(100_000)).encode()
    data = b"one beginning" + passage + b"other" + passage
    ends = infill.chunk_ends(np.frombuffer(data, np.uint8), np.array([0, 13 + len(passage)]))
    chunks = [data[a:b] for a, b in zip([0, *ends], ends)]
    assert b"".join(chunks) == data and len(set(chunks)) <= len(chunks) / 2 + 4


# ---- conversations ----------------------------------------------------------


def brute_damage(rows):
    """conv_id -> rows (turn, role, text) after damage, in order."""
    out = defaultdict(list)
    shown = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        out[conv]
        draw = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if draw == 0:
            continue
        if draw == 1:
            text = ""
        if draw == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        out[conv] += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def brute_repair(rows):
    """The contract's row for one conversation: all edits in order of cost and then audit."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, state, lines = heapq.heappop(queue)
        if at == len(rows) and state in ("", "a"):
            break
        if (at, state) in done:
            continue
        done.add((at, state))
        for role in ("user", "assistant"):
            if (state, role[0]) in legal:
                after = legal[state, role[0]]
                heapq.heappush(queue, (cost + 3, audit + "I", at, after, (*lines, role + ":")))
                if at < len(rows) and faults[at] not in ("blank", "duplicate"):
                    cut = 3 * (faults[at] == "truncated")
                    heapq.heappush(queue, (cost + 3 + cut, audit + "R", at + 1, after, (*lines, f"{role}:{rows[at][2]}")))
        if at < len(rows):
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, state, lines))
            if faults[at] not in ("blank", "duplicate") and (state, initials[at]) in legal:
                cut = 3 * (faults[at] == "truncated")
                heapq.heappush(queue, (
                    cost + cut, audit + "K", at + 1, legal[state, initials[at]], (*lines, f"{rows[at][1]}:{rows[at][2]}")))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def compare(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, block long")
    found = turn_repair.report(frame).collect()
    wanted = brute_damage(rows)
    assert len(found) == len(wanted)
    for r in found:
        assert tuple(r[c] for c in COLUMNS) == brute_repair(wanted[r.conv_id]), r.conv_id


def conversations(seed, count, longest):
    rng = random.Random(seed)
    out = []
    for conv in range(count):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \t", None, f"text {turn}.", f"open {turn}", "Ends. \n", "é?"])
            out.append((rng.choice([conv, conv, conv, None]), rng.choice([turn, turn, turn, None, 2 * turn]), role, text))
    return out


def test_repair_against_brute_force(spark):
    compare(spark, conversations(1, 150, 9))


def test_lines_of_the_repaired_conversations(spark):
    rows = conversations(3, 40, 9)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lines = defaultdict(list)
    for r in turn_repair.repair(turn_repair.damage(frame)).orderBy("key", "seq").collect():
        lines[r.key] += r.lines
    wanted = {r.conv_id: r.repaired_sha256 for r in turn_repair.report(frame).collect()}
    for conv, digest in wanted.items():
        own = lines["" if conv is None else f"={conv}"]
        assert hashlib.sha256("\n".join(own).encode()).hexdigest() == digest


def test_conversations_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "BLOCK_BITS", 2)
    monkeypatch.setattr(turn_repair, "FAN_BITS", 1)
    rows = conversations(2, 12, 60)
    rows += [(77, None, "user", "the same.")] * 90 + [(77, k, "user", "the same.") for k in range(40)]
    compare(spark, rows)


def test_long_runs_of_one_symbol(spark):
    rows = [(1, k, "user", f"no end {k}") for k in range(500)] + [(2, k, "assistant", f"End {k}.") for k in range(300)]
    compare(spark, rows + [(3, 1, "user", "same.")] * 1000 + [(4, k, ["user", "assistant"][k % 2], f"Fine {k}.") for k in range(300)])


def test_empty_and_dropped_conversations(spark):
    assert turn_repair.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    compare(spark, [(dropped, 0, "user", "x"), (dropped, 0, "user", "x")])


def test_powers_are_repeated_steps():
    one = turn_repair._power(3, 0)
    many = one
    for _ in range(12):
        many = turn_repair._product(many, one)
    assert (turn_repair.block_matrix([3], [1]) == one).all() and (turn_repair.block_matrix([3] * 13, [1] * 13) == many).all()


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_conversation_repair", "op13_sentencepiece_round_trip"])
def test_registered(name):
    assert name in QUERIES
