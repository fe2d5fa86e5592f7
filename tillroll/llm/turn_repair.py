"""Repair of conversations by the cheapest edits, as a run-length dynamic programme.

Each row of a conversation is a symbol: its role's initial and its fault. Equal rows side by side
are one run; a run moves the costs of the four states of a well-formed conversation by a power of
its symbol's min-plus transition, put together from cached binary powers. Conversations are sorted
over all tasks and cut into blocks of bounded size, whatever their length. What a block does to
the costs is a 4 x 4 matrix; scans over the matrices of a conversation give each block the costs
behind it and the state before it, and with them it unrolls its own choices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import map_batches, staged

#: White space, ends of sentences, costs of the edits and of a truncated row that stays.
BLANKS, ENDS = " \t\n\x0b\f\r", ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a block are 2**BLOCK_BITS, blocks that a scan reads at once 2**FAN_BITS.
BLOCK_BITS, FAN_BITS = 12, 10

# States: nothing yet, after the system's row, after a user's, after an assistant's.
_EMPTY, _SYSTEM, _USER, _ASSISTANT = range(4)
_LETTERS = "sua"
_AFTER = {(_EMPTY, "s"): _SYSTEM, (_EMPTY, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
_TURN = [("user", _USER), ("user", _USER), ("assistant", _ASSISTANT), ("user", _USER)]
_NEVER = 1 << 60
#: Costs from each state to the end of the conversation, and the symbol of rows that must go.
END = (0, 2 * INSERT, INSERT, 0)
DOOMED = 0


def symbol_of(initial: Column, fault: Column) -> Column:
    """DOOMED for blank and duplicate rows, else a number for the initial (s, u, a, other) and whether it is truncated."""
    place = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, c in enumerate(_LETTERS) for x in (c, k))), initial), F.lit(3))
    return F.when(fault.isin("blank", "duplicate"), DOOMED).otherwise(1 + 2 * place + F.when(fault == "truncated", 1).otherwise(0))


def _keep(symbol: int, state: int) -> tuple[int, int]:
    """(cost, state after) of keeping a row."""
    place, cut = divmod(symbol - 1, 2)
    after = _AFTER.get((state, _LETTERS[place])) if symbol != DOOMED and place < 3 else None
    return (_NEVER, state) if after is None else (TRUNCATED * cut, after)


def _rerole(symbol: int) -> int:
    return _NEVER if symbol == DOOMED else REROLE + TRUNCATED * ((symbol - 1) % 2)


def _product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.minimum((left[:, :, None] + right[None, :, :]).min(axis=1), _NEVER)


@lru_cache(None)
def _power(symbol: int, bit: int) -> np.ndarray:
    """Transition of 2**bit rows of a symbol: insertions before a row, then its edit."""
    if bit:
        half = _power(symbol, bit - 1)
        return _product(half, half)
    inserted = np.full((4, 4), _NEVER)
    edited = np.full((4, 4), _NEVER)
    for state in range(4):
        inserted[state, state] = 0
        at = state
        for steps in (1, 2):
            at = _TURN[at][1]
            inserted[state, at] = min(inserted[state, at], steps * INSERT)
        edited[state, state] = DELETE
        cost, after = _keep(symbol, state)
        edited[state, after] = min(edited[state, after], cost)
        after = _TURN[state][1]
        edited[state, after] = min(edited[state, after], _rerole(symbol))
    return _product(inserted, edited)


def _bits(n: int) -> Iterator[int]:
    return (k for k in range(n.bit_length()) if n >> k & 1)


def _runs(symbols: list[int], counts: list[int]) -> list[list[int]]:
    """[symbol, rows] of equal neighbours; the copies behind the first of a row are duplicates."""
    runs: list[list[int]] = []
    for symbol, count in zip(symbols, counts):
        for part, n in ((symbol, 1), (DOOMED, count - 1)):
            if n and runs and runs[-1][0] == part:
                runs[-1][1] += n
            elif n:
                runs.append([part, n])
    return runs


def block_matrix(symbols: list[int], counts: list[int]) -> np.ndarray:
    """Least costs from each state before the rows to each state behind them."""
    matrix = np.full((4, 4), _NEVER)
    np.fill_diagonal(matrix, 0)
    for symbol, n in _runs(symbols, counts):
        for bit in _bits(n):
            matrix = _product(matrix, _power(symbol, bit))
    return matrix


def _costs_behind(symbols: list[int], counts: list[int], end: tuple[int, ...]) -> list[tuple]:
    """(symbol, rows, costs behind the run) of each run."""
    out = []
    costs = np.array(end, np.int64)
    for symbol, n in reversed(_runs(symbols, counts)):
        out.append((symbol, n, costs.tolist()))
        for bit in _bits(n):
            costs = np.minimum((_power(symbol, bit) + costs).min(axis=1), _NEVER)
    return out[::-1]


@lru_cache(1 << 16)
def _choices(symbol: int, state: int, behind: tuple[int, ...]) -> tuple[str, int, tuple[str, ...], str, int]:
    """(edits, cost, roles inserted, the row's role, state behind) for one row: the ASCII-least of the
    cheapest edits, given the costs behind it. The role is "" if kept and "-" if the row is deleted."""
    before = np.minimum((_power(symbol, 0) + np.array(behind)).min(axis=1), _NEVER).tolist()
    inserted: tuple[str, ...] = ()
    while True:
        edits, cost = "I" * len(inserted), INSERT * len(inserted)
        kept, after = _keep(symbol, state)
        role, turned = _TURN[state]
        if DELETE + behind[state] == before[state]:
            return edits + "D", cost + DELETE, inserted, "-", state
        if INSERT + before[turned] == before[state]:
            inserted, state = (*inserted, role), turned
        elif kept + behind[after] == before[state]:
            return edits + "K", cost + kept, inserted, "", after
        else:
            return edits + "R", cost + _rerole(symbol), inserted, role, turned


def unroll(symbols: list[int], counts: list[int], state: int, end: tuple[int, ...], last: bool) -> tuple[list[dict], int]:
    """Edits of each row with its copies, and the state behind them, from a state before the rows and the
    costs behind them; the last rows of a conversation end with what is inserted behind them.

    A row has edits, cost, before and after (roles inserted around it) and own (its role, "" or "-").
    """
    copies = (c for count in counts for c in range(count))
    rows: list[dict] = []
    for symbol, n, costs in _costs_behind(symbols, counts, end):
        steps = [tuple(costs)]
        for _ in range(n - 1):
            steps.append(tuple(np.minimum((_power(symbol, 0) + np.array(steps[-1])).min(axis=1), _NEVER).tolist()))
        for behind in reversed(steps):
            # Costs relative to the least one: distant rows of a run share their choices.
            least = min(behind)
            edits, cost, inserted, own, state = _choices(symbol, state, tuple(c - least for c in behind))
            if next(copies) == 0:
                rows.append({"edits": edits, "cost": cost, "before": list(inserted), "own": own, "after": []})
            else:
                rows[-1]["edits"] += edits
                rows[-1]["cost"] += cost
                rows[-1]["after"] += inserted
    while last and END[state]:
        role, state = _TURN[state]
        rows[-1]["edits"] += "I"
        rows[-1]["cost"] += INSERT
        rows[-1]["after"].append(role)
    return rows, state


# ---- on Spark -------------------------------------------------------------------


def key_of(conv_id: str) -> Column:
    """conv_id as text that tells null from every value."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("")).alias("key")


def damage(conversations: DataFrame) -> DataFrame:
    """(key, turn, role, text, copies): rows damaged by crc32(`conv_id:turn`) % 20.

    0 drops a row, 1 empties its text, 2 takes the ends of sentences out, 3 repeats it, 4 makes it the
    user's. A null conv_id, turn, role or text counts as one space in that text and in the rows; a
    null turn stays null as a place. key tells conversations apart.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = conversations.select(
        key_of("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"),
        (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("draw"))
    return drawn.filter("draw != 0").select(
        "key", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("draw") == 3, 2).otherwise(1).cast("long").alias("copies"))


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Staged (key, seq, turn, role, text, copies, fault, initial, symbol): different rows in the order of
    their conversation: by turn (nulls first), role and text.

    `rows` are (key, turn, role, text, copies); equal ones become one with the sum of copies. fault is
    the first row's: blank, duplicate (role and text are in an earlier row), truncated or null. seq
    grows along the order over all tasks, so a conversation of any size is spread over many.
    """
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    content = F.sha2(F.concat_ws("\0", F.length("role").cast("string"), "role", "text").cast("binary"), 256)
    marked = rows.withColumn("content", content)
    firsts = marked.groupBy("key", "content").agg(F.min(place).alias("place")).select(
        "key", F.col("place.turn").alias("turn"), "content", F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), F.lit(True).alias("first"))
    one_each = (
        marked.select("key", "turn", "content", "role", "text", "copies", F.lit(False).alias("first")).unionByName(firsts)
        .groupBy("key", "turn", "content")
        .agg(F.max("role").alias("role"), F.max("text").alias("text"), F.sum("copies").alias("copies"), F.max("first").alias("first"))
    )
    order = ["key", F.asc_nulls_first("turn"), "role"]
    sorted_rows = one_each.repartitionByRange(*order, F.substring("text", 1, 16)).sortWithinPartitions(*order, "text")
    ending = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (
        F.when(ending == "", "blank").when(~F.col("first"), "duplicate")
        .when(~F.right(ending, F.lit(1)).isin(*ENDS), "truncated"))
    initial = F.substring("role", 1, 1)
    return staged(sorted_rows.select(
        "key", F.monotonically_increasing_id().alias("seq"), "turn", "role", "text", "copies", fault.alias("fault"),
        initial.alias("initial"), symbol_of(initial, fault).alias("symbol")), "conversation-rows")


def _before(parts: DataFrame, merge: Callable, unit: list[int], backward: bool) -> DataFrame:
    """(key, block, value): the values of all blocks before each one of its key, merged in order; of all
    behind it if backward. merge(left, right) must be associative.

    Where a key has more than 2**FAN_BITS blocks, groups of blocks are merged first and scanned in
    the same way, so that no task reads more than that for a key.
    """
    most = parts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0

    def through(values: list) -> Iterator:
        merged = unit
        for value in reversed(values) if backward else values:
            yield merged
            merged = merge(value, merged) if backward else merge(merged, value)

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        outer = group["outer"].iloc[0].tolist()
        found = [merge(v, outer) if backward else merge(outer, v) for v in through([v.tolist() for v in group["value"]])]
        return pd.DataFrame({"key": group["key"], "block": group["block"], "value": found[::-1] if backward else found})

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        values = [v.tolist() for v in group.sort_values("block")["value"]]
        merged = unit
        for value in values:
            merged = merge(merged, value)
        return pd.DataFrame({"key": group["key"].iloc[:1], "block": group["group"].iloc[:1], "value": [merged]})

    schema = "key string, block bigint, value array<bigint>"
    if most <= 1 << FAN_BITS:
        grouped = parts.withColumn("group", F.lit(0).cast("long")).withColumn("outer", F.array(*map(F.lit, unit)).cast("array<bigint>"))
    else:
        groups = parts.withColumn("group", F.shiftright("block", FAN_BITS))
        merged = staged(groups.groupBy("key", "group").applyInPandas(whole, schema), "block-groups")
        outer = _before(merged, merge, unit, backward).select("key", F.col("block").alias("group"), F.col("value").alias("outer"))
        grouped = groups.join(outer, ["key", "group"])
    return staged(grouped.groupBy("key", "group").applyInPandas(scan, schema), "block-scan")


def _merge_costs(left: list[int], right: list[int]) -> list[int]:
    return _product(np.reshape(left, (4, 4)), np.reshape(right, (4, 4))).ravel().tolist()


def _merge_states(left: list[int], right: list[int]) -> list[int]:
    return [right[x] for x in left]


def _each_block(blocks: DataFrame, function: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """Rows that function gives for each block, itself (symbol and copies of its rows in order, and other columns)."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = [out for block in batch.slice(k, 64).to_pylist() for out in function(block)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    kinds = pa.schema([pa.field(n, t) for n, t in (
        (field.split()[0], {"string": pa.string(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()),
                            "array<string>": pa.list_(pa.string())}[field.split()[1]]) for field in schema.split(", "))])
    return map_batches(blocks, emit, schema)


def _matrix_row(block: dict) -> list[dict]:
    return [{"key": block["key"], "block": block["block"], "value": block_matrix(block["symbols"], block["copies"]).ravel().tolist()}]


def _exit_row(block: dict) -> list[dict]:
    ends = [unroll(block["symbols"], block["copies"], state, tuple(block["end"]), False)[1] for state in range(4)]
    return [{"key": block["key"], "block": block["block"], "value": ends}]


def _edit_rows(block: dict) -> list[dict]:
    rows, _ = unroll(block["symbols"], block["copies"], block["state"], tuple(block["end"]), block["block"] == block["last_block"])
    return [{"key": block["key"], "seq": seq} | row for seq, row in zip(block["seqs"], rows)]


def cheapest_edits(rows: DataFrame) -> DataFrame:
    """(key, seq, edits, cost, before, own, after) for each of the ordered rows.

    edits are the initials of Delete, Insert, Keep and Rerole for the row and its copies, with
    insertions before it (and behind the last row of a conversation); before and after are the roles
    inserted, own is the row's new role, "" if it keeps its own, "-" if it is deleted.
    """
    blocks = rows.groupBy("key", F.shiftright("seq", BLOCK_BITS).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "symbol", "copies"))).alias("rows"))
    spans = rows.groupBy("key").agg(
        F.min(F.shiftright("seq", BLOCK_BITS)).alias("first_block"), F.max(F.shiftright("seq", BLOCK_BITS)).alias("last_block"))
    blocks = staged(blocks.join(spans, "key").select(
        "key", "block", "first_block", "last_block", F.col("rows.seq").alias("seqs"),
        F.col("rows.symbol").cast("array<bigint>").alias("symbols"), F.col("rows.copies").alias("copies")), "conversation-blocks")

    end = F.array(*map(F.lit, END)).cast("array<bigint>")
    alone = blocks.filter("first_block = last_block").withColumn("state", F.lit(_EMPTY).cast("long")).withColumn("end", end)
    cut = blocks.filter("first_block < last_block")
    kind = "key string, block bigint, value array<bigint>"
    unit = [0 if a == b else _NEVER for a in range(4) for b in range(4)]
    behind = _before(staged(_each_block(cut, _matrix_row, kind), "block-costs"), _merge_costs, unit, True)
    to_end = [F.array_min(F.array(*[F.col("value")[4 * s + t] + END[t] for t in range(4)])) for s in range(4)]
    cut = cut.join(behind.select("key", "block", F.array(*to_end).alias("end")), ["key", "block"])
    exits = staged(_each_block(cut, _exit_row, kind), "block-exits")
    states = _before(exits, _merge_states, list(range(4)), False).select("key", "block", F.col("value")[_EMPTY].alias("state"))
    ready = alone.unionByName(cut.join(states, ["key", "block"]))
    return _each_block(
        ready, _edit_rows,
        "key string, seq bigint, edits string, cost bigint, before array<string>, own string, after array<string>")


def repair(rows: DataFrame) -> DataFrame:
    """The ordered rows (key, seq, turn, role, text, copies, fault, initial) with edits, cost and lines.

    lines are the row's lines `role:text` of the repaired conversation: what is inserted before it,
    itself, what is inserted behind it. The repaired roles of a conversation match (s?(ua)+)? by their
    initials at the least cost; of equal costs, the edits that come first in ASCII are taken. Initials
    other than s, u, a, and an empty role, cannot be kept. Nulls and equal rows are as `ordered_rows` has
    them; an empty table gives no rows; columns other than the four are not read.
    """
    found = ordered_rows(rows)
    inserted = lambda c: F.transform(c, lambda role: F.concat(role, F.lit(":")))
    own = F.when(F.col("own") == "-", F.array().cast("array<string>")).otherwise(F.array(F.concat(
        F.when(F.col("own") == "", F.col("role")).otherwise(F.col("own")), F.lit(":"), F.col("text"))))
    return found.drop("symbol").join(cheapest_edits(found).drop("key"), "seq").withColumn(
        "lines", F.concat(inserted("before"), own, inserted("after"))).drop("before", "own", "after")


_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(key, illegal, cost, audit, repaired_sha256) of each conversation, from its ordered rows and their edits.

    A hash of all lines in order is sequential by its nature: the rows of a conversation pass in
    their order through one task, each behind its edits; the task keeps the hash's state and the
    audit, not the rows. So texts move once.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([
                {"key": key, "illegal": illegal, "cost": cost, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], kinds)

        key, begun, edit = None, False, {}
        done: list[pa.RecordBatch] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["copies"] is None:
                    edit = row
                    continue
                if not begun or row["key"] != key:
                    if begun:
                        done.append(result())
                    key, begun, previous, written = row["key"], True, None, False
                    illegal, cost, audit, digest = 0, 0, [], hashlib.sha256()
                illegal += row["copies"] - 1 + (previous is not None and (previous, row["initial"]) not in _LEGAL)
                previous = row["initial"]
                cost += edit["cost"]
                audit.append(edit["edits"])
                own = [] if edit["own"] == "-" else [f"{edit['own'] or row['role']}:{row['text']}"]
                for line in [*(f"{r}:" for r in edit["before"]), *own, *(f"{r}:" for r in edit["after"])]:
                    digest.update(("\n" + line if written else line).encode())
                    written = True
            yield from done
            done = []
        if begun:
            yield result()

    kinds = pa.schema([("key", pa.string()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    both = edits.unionByName(rows.select("key", "seq", "role", "text", "initial", "copies"), allowMissingColumns=True)
    return map_batches(
        both.repartition("key").sortWithinPartitions("key", "seq", F.asc_nulls_first("copies")), emit,
        "key string, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def report(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of the given table: faults after `damage`, the cheapest repair, and its digest.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256). A conversation
    that damage leaves without rows gets zeros, an empty audit and the hash of the empty text. Null
    is a conv_id of its own.
    """
    rows = ordered_rows(damage(conversations))
    everyone = conversations.groupBy("conv_id").agg(F.first(key_of("conv_id")).alias("key"))
    extra = F.col("copies") - 1
    faults = rows.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("fault") == "blank", F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "blank", 0).otherwise(extra + F.when(F.col("fault") == "duplicate", 1).otherwise(0))).alias("duplicate"),
        F.count_if(F.col("fault") == "truncated").alias("truncated"))
    counts = ["gaps", "blank", "duplicate", "truncated"]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return everyone.join(faults, "key", "left").join(digests(rows, cheapest_edits(rows)), "key", "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in [*counts, "illegal", "cost"]),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
