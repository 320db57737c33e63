"""Repair of conversation structure by a dynamic program with square-root checkpoints.

A conversation must read ``(s?(ua)+)?`` in the initials of its roles. Every turn is kept
(0), given the role user or assistant (3) or deleted (4), and turns of user or assistant
without text are inserted (3); keeping or rerolling a truncated turn adds 3, and blank and
repeated turns must be deleted. The state is what was emitted last, so a backward pass
gives for each turn the least cost from each of four states to the end. An edit is tight
if it loses nothing of that cost, and walking forward by the ASCII-least tight edit emits
the least of the cheapest edit strings, since an edit determines the next state.

The vectors of all turns are not kept. A conversation of n turns is cut into blocks of
about sqrt(n), and only the vectors at the ends of blocks are, the checkpoints:

1. Each block is turned into the matrix of least costs from state to state, in a task of
   its own; a turn is one character by now.
2. Per conversation the matrices are applied to the final vector, last block first: the
   checkpoints.
3. Each block recomputes its vectors from its checkpoint and walks forward, from each of
   the four states it may be entered in.
4. Per conversation the blocks are chained: the state that one ends in enters the next.

So a conversation that holds a third of all rows is worked on by as many tasks as it has
blocks, and no task has more than about sqrt(n) of its turns or checkpoints at a time. Of a
whole conversation there is the string of edits that is asked for, one letter to an edit.

Turns are in the order of their number (NULLs first), equal ones in the order of role,
SHA-256 of role and text, and reading. Repeats are found by that digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylens.llm.tables import stored
from assaylens.operators.ranking import join_back, with_position

START, SYSTEM, USER, ASSISTANT = range(4)  # what was emitted last
NEXT = (USER, USER, ASSISTANT, USER)  # what an inserted or rerolled turn becomes after it
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEVER = 1 << 60
END = (0, NEVER, NEVER, 0)  # a conversation may end empty or after an assistant
# a turn as a character: four initials (the last stands for all others) in three conditions
INITIALS = "suax"
FINE, CUT, GONE = "suax", "SUAX", "0123"
SYMBOLS = FINE + CUT + GONE
LEAST = 256  # turns of a block, if the square root is less
_KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
# for each symbol and state: (letter, cost, next state) of the edits that consume the turn, by letter
STEPS: dict[str, tuple[tuple[tuple[str, int, int], ...], ...]] = {
    symbol: tuple(
        (("D", DELETE, state),)
        if symbol in GONE
        else (
            ("D", DELETE, state),
            *[("K", extra, to) for at, to in _KEEP[symbol.lower()].items() if at == state],
            ("R", REROLE + extra, NEXT[state]),
        )
        for state in range(4)
    )
    for symbol in SYMBOLS
    for extra in [TRUNCATED if symbol in CUT else 0]
}


# ---------------------------------------------------------------- the dynamic program


def with_inserts(costs: tuple[int, ...]) -> tuple[int, ...]:
    """The least costs if turns may be inserted first, given those without."""
    user = min(costs[USER], INSERT + costs[ASSISTANT])
    assistant = min(costs[ASSISTANT], INSERT + costs[USER])
    return (min(costs[START], INSERT + user), min(costs[SYSTEM], INSERT + user), user, assistant)


def before(symbol: str, costs: tuple[int, ...]) -> tuple[int, ...]:
    """The cost vector before a turn, given the one behind it."""
    return with_inserts(tuple(min(c + costs[to] for _, c, to in edits) for edits in STEPS[symbol]))


def vectors(symbols: str, end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The cost vectors before each turn of a block, and the one behind it."""
    out = [end]
    for symbol in reversed(symbols):
        out.append(before(symbol, out[-1]))
    return out[::-1]


def matrix(symbols: str) -> list[int]:
    """Least costs from each state before a block to each behind it, row by row."""
    columns = []
    for to in range(4):
        costs = tuple(0 if state == to else NEVER for state in range(4))
        for symbol in reversed(symbols):
            costs = before(symbol, costs)
        columns.append(costs)
    return [min(columns[to][state], NEVER) for state in range(4) for to in range(4)]


def apply(costs: list[int], end: tuple[int, ...]) -> tuple[int, ...]:
    """The vector before a block with this matrix, given the one behind it."""
    return tuple(min(costs[4 * state + to] + end[to] for to in range(4)) for state in range(4))


def walk(symbols: str, behind: list[tuple[int, ...]], state: int, closing: bool) -> tuple[str, int]:
    """The ASCII-least tight edits of a block entered in a state, and the state behind it.

    ``closing`` tells that nothing follows, so that turns may be inserted at the end. In
    between, what is inserted before a turn belongs to the block of that turn.
    """
    letters = []
    for n, symbol in enumerate(symbols):
        while True:
            cost = behind[n][state]
            tight = [(letter, to) for letter, c, to in STEPS[symbol][state] if c + behind[n + 1][to] == cost]
            if INSERT + behind[n][NEXT[state]] == cost:
                tight.append(("I", NEXT[state]))
            letter, state = min(tight)
            letters.append(letter)
            if letter != "I":
                break
    while closing and END[state]:
        letters.append("I")
        state = NEXT[state]
    return "".join(letters), state


def repaired_roles(letters: str, symbols: str, state: int) -> list[tuple[int, int | None]]:
    """For each turn that the edits leave: its number in the block (None: inserted) and new role.

    The role is the state it leads to; that of a kept turn is -1, for it has its own.
    """
    out: list[tuple[int, int | None]] = []
    turn = 0
    for letter in letters:
        if letter == "I":
            state = NEXT[state]
            out.append((None, state))
            continue
        if letter == "K":
            state = _KEEP[symbols[turn].lower()][state]
            out.append((turn, -1))
        elif letter == "R":
            state = NEXT[state]
            out.append((turn, state))
        turn += 1
    return out


# ---------------------------------------------------------------- on Spark


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it and 4 makes
    its role user. NULL roles and texts become one space, as a NULL does in the key.
    """
    blank = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)
    )
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("_fault"),
    ).where("_fault != 0")
    fault = F.col("_fault")
    text = (
        F.when(fault == 1, F.lit(""))
        .when(fault == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id",
        "turn",
        F.when(fault == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")


def _flagged(rows: DataFrame) -> DataFrame:
    """Rows with their first fault and initial; ``rows`` has conv_id, turn, role, key, row and the marks."""
    # only what is repeated needs looking up: one row for each conversation and digest
    repeated = stored(
        rows.groupBy("conv_id", "key")
        .agg(F.min(F.struct("turn", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("conv_id", "key", F.col("first.row").alias("first")),
        "repeated-turns",
    )
    joined = join_back(rows, repeated, ["conv_id", "key"], "left")
    later = F.col("first").isNotNull() & (F.col("first") != F.col("row"))
    fault = (
        F.when(F.col("blank"), F.lit("blank"))
        .when(later, F.lit("duplicate"))
        .when(F.col("open"), F.lit("truncated"))
        .otherwise(F.lit(""))
    )
    at = F.position(F.substring("role", 1, 1), F.lit(INITIALS[:3]))
    initial = F.when((F.length("role") == 0) | (at == 0), F.lit(3)).otherwise(at - 1)
    condition = F.when(fault.isin("blank", "duplicate"), F.lit(2)).when(fault == "truncated", F.lit(1)).otherwise(0)
    symbol = F.element_at(F.array(*map(F.lit, SYMBOLS)), (condition * 4 + initial + 1).cast("int"))
    return joined.select("conv_id", "turn", "role", "key", "row", fault.alias("fault"), symbol.alias("symbol"))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = [matrix(symbols.as_py()) for symbols in batch.column("symbols")]
        yield batch.append_column("matrix", pa.array(costs, pa.list_(pa.int64())))


def _checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector behind each block and the cost before it; rows come last block first."""
    known, behind = object(), END
    for batch in batches:
        ends, costs = [], []
        for conv, last, costs_of in zip(batch.column("conv_id"), batch.column("last"), batch.column("matrix")):
            if last.as_py() or conv.as_py() != known:
                known, behind = conv.as_py(), with_inserts(END)
            ends.append(list(behind))
            behind = apply(costs_of.as_py(), behind)
            costs.append(behind[START])
        kept = batch.drop_columns(["matrix"])
        kept = kept.append_column("behind", pa.array(ends, pa.list_(pa.int64())))
        yield kept.append_column("cost", pa.array(costs, pa.int64()))


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each block and the state behind it, for each state before it."""
    for batch in batches:
        edits, states = [], []
        for symbols, behind, last in zip(batch.column("symbols"), batch.column("behind"), batch.column("last")):
            costs = vectors(symbols.as_py(), tuple(behind.as_py()))
            found = [walk(symbols.as_py(), costs, state, last.as_py()) for state in range(4)]
            edits.append([f[0] for f in found])
            states.append([f[1] for f in found])
        kept = batch.drop_columns(["behind"])
        kept = kept.append_column("edits", pa.array(edits, pa.list_(pa.string())))
        yield kept.append_column("states", pa.array(states, pa.list_(pa.int32())))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits that hold, the state before each block, and illegal pairs; first block first."""
    known, state, initial = object(), START, ""
    for batch in batches:
        letters, entered, illegal = [], [], []
        columns = ("conv_id", "block", "symbols", "edits", "states")
        for conv, block, symbols, edits, states in zip(*(batch.column(c).to_pylist() for c in columns)):
            if block == 0 or conv != known:
                known, state, initial = conv, START, ""
            roles = initial + "".join(INITIALS[SYMBOLS.index(s) % 4] for s in symbols)
            illegal.append(sum(roles[i : i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1)))
            initial = roles[-1]
            letters.append(edits[state])
            entered.append(state)
            state = states[state]
        kept = batch.drop_columns(["edits", "states"])
        kept = kept.append_column("letters", pa.array(letters, pa.string()))
        kept = kept.append_column("entered", pa.array(entered, pa.int32()))
        yield kept.append_column("illegal", pa.array(illegal, pa.int64()))


def _arrow(df: DataFrame, function, drop: tuple[str, ...], add: str) -> DataFrame:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in drop]
    return df.mapInArrow(function, ", ".join([*kept, add]))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repair conversations of (conv_id, turn, role, text); other columns are not looked at.

    Gives two frames. Audits: conv_id, the counts gaps, blank, duplicate, truncated and
    illegal, the cost and the letters of the edits, for each conversation with rows. And the
    repaired turns: conv_id, block, place (in the block), role and text.

    A row is blank if its text has no character but white space; else a duplicate if its
    role and text stood in an earlier row; else truncated if its text does not end in one
    of ``.!?``. NULL roles and texts count as one space, a NULL conv_id is a conversation of
    its own, NULL turns come first. Roles count by their first letter (none for an empty
    role). Repeated rows are duplicates. No rows give no rows.
    """
    blank = F.lit(" ")
    text = F.coalesce("text", blank)
    role = F.coalesce("role", blank)
    clean = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    # a length before the role keeps pairs apart that read alike together
    pair = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    key = F.unhex(F.sha2(pair.cast("binary"), 256))
    base = stored(clean.select("*", key.alias("key"), F.monotonically_increasing_id().alias("row")), "turns")
    shown = r"[^\x20\x09-\x0D]"
    marks = base.select(
        "conv_id",
        "turn",
        "role",
        "key",
        "row",
        (~F.col("text").rlike(shown)).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("key"), F.col("row")]
    placed = with_position(_flagged(marks), order, ["conv_id"]).drop("role", "key")
    count = lambda name: F.count_if(F.col("fault") == name).alias(name)
    counts = stored(
        placed.groupBy("conv_id").agg(
            F.count(F.lit(1)).alias("n"),
            *map(count, ("blank", "duplicate", "truncated")),
            F.coalesce(
                F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)
            ).cast("bigint").alias("gaps"),
        ),
        "conversations",
    )
    sizes = counts.select("conv_id", "n", F.greatest(F.ceil(F.sqrt("n")), F.lit(LEAST)).cast("bigint").alias("width"))
    dealt = stored(
        join_back(placed, sizes, ["conv_id"]).select(
            "conv_id",
            F.floor(F.col("pos") / F.col("width")).cast("bigint").alias("block"),
            (F.col("pos") % F.col("width")).cast("int").alias("place"),
            F.floor((F.col("n") - 1) / F.col("width")).cast("bigint").alias("top"),
            "row",
            "symbol",
        ),
        "dealt-turns",
    )
    by_block = dealt.groupBy("conv_id", "block").agg(
        F.max(F.col("top") == F.col("block")).alias("last"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "symbol"))), lambda t: t.symbol), "").alias(
            "symbols"
        ),
    )
    blocks = _arrow(by_block, _matrices, (), "matrix array<bigint>")
    backward = blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.col("block").desc())
    backward = _arrow(backward, _checkpoints, ("matrix",), "behind array<bigint>, cost bigint")
    walked = _arrow(
        backward.repartition("conv_id", "block"), _walks, ("behind",), "edits array<string>, states array<int>"
    )
    forward = walked.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    chain = stored(
        _arrow(forward, _chained, ("edits", "states"), "letters string, entered int, illegal bigint"), "edits"
    )
    letters = F.transform(F.array_sort(F.collect_list(F.struct("block", "letters"))), lambda b: b.letters)
    audits = chain.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"),
        F.max(F.when(F.col("block") == 0, F.col("cost"))).alias("cost"),
        F.array_join(letters, "").alias("audit"),
    )
    audits = join_back(counts.drop("n"), audits, ["conv_id"])
    return audits, _repaired(chain, dealt, base)


def _repaired(chain: DataFrame, dealt: DataFrame, base: DataFrame) -> DataFrame:
    """The turns that the edits leave, with their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("letters", "symbols", "entered")
        for batch in batches:
            left = [repaired_roles(*row) for row in zip(*(batch.column(c).to_pylist() for c in names))]
            rows = [[{"turn": t, "role": r} for t, r in turns] for turns in left]
            kind = pa.list_(pa.struct([("turn", pa.int32()), ("role", pa.int32())]))
            columns = [batch.column("conv_id"), batch.column("block"), pa.array(rows, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "block", "left"])

    conv = dict(chain.dtypes)["conv_id"]
    left = chain.mapInArrow(run, f"conv_id {conv}, block bigint, left array<struct<turn int, role int>>")
    left = left.select("conv_id", "block", F.posexplode("left").alias("at", "left")).select(
        "conv_id", "block", "at", F.col("left.turn").alias("place"), F.col("left.role").alias("new")
    )
    role = F.when(F.col("new") == USER, F.lit("user")).otherwise(F.lit("assistant"))
    inserted = left.where("place IS NULL").select(
        "conv_id", "block", F.col("at").alias("place"), role.alias("role"), F.lit("").alias("text")
    )
    rows = dealt.select("conv_id", "block", "place", "row")
    kept = join_back(left.where("place IS NOT NULL"), rows, ["conv_id", "block", "place"])
    texts = base.select(F.col("row").alias("base_row"), F.col("role").alias("own"), "text")
    kept = kept.join(texts, F.col("row") == F.col("base_row")).select(
        "conv_id",
        "block",
        F.col("at").alias("place"),
        F.when(F.col("new") < 0, F.col("own")).otherwise(role).alias("role"),
        "text",
    )
    return kept.unionByName(inserted)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of the lines ``role:text`` of each conversation.

    The texts of a block are put together first. A digest has to see a text from its start
    to its end, so the blocks of a conversation pass one task, one after another; it holds
    one block at a time.
    """
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("place", F.concat("role", F.lit(":"), "text").alias("line")))),
        lambda t: t.line,
    )
    blocks = repaired.groupBy("conv_id", "block").agg(F.array_join(lines, "\n").alias("lines"))
    ordered = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, digest, kind = None, None, None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            done = []
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("lines")):
                if digest is not None and conv == known:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        done.append((known, digest.hexdigest()))
                    known, digest = conv, hashlib.sha256()
                digest.update(text.as_py().encode())
            yield _digest_batch(done, kind)
        if digest is not None:
            yield _digest_batch([(known, digest.hexdigest())], kind)

    return ordered.mapInArrow(run, f"conv_id {dict(blocks.dtypes)['conv_id']}, repaired_sha256 string")


def _digest_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "repaired_sha256"])
