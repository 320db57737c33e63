import hashlib
import heapq
import random
import re
import zlib

import pytest
from cases import SF
from compare import compare, connect

from assaylens.llm import conversations
from assaylens.llm.queries import QUERIES, SQL

ROLES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """The least (cost, edits, repaired lines) of rows of (role, text, must go, truncated): best first."""
    heap = [(0, "", 0, ())]
    while heap:
        cost, edits, at, out = heapq.heappop(heap)
        initials = "".join(line[0][:1] for line in out)
        if not re.fullmatch(r"(s?(ua)*u?)?", initials):
            continue
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            return cost, edits, [f"{role}:{text}" for role, text in out]
        if len(out) < 2 * len(rows) + 3:
            for role in ROLES.values():
                heapq.heappush(heap, (cost + 3, edits + "I", at, (*out, (role, ""))))
        if at < len(rows):
            role, text, gone, cut = rows[at]
            heapq.heappush(heap, (cost + 4, edits + "D", at + 1, out))
            if not gone:
                if role[:1] in ("s", "u", "a"):
                    heapq.heappush(heap, (cost + 3 * cut, edits + "K", at + 1, (*out, (role, text))))
                for new in ROLES.values():
                    heapq.heappush(heap, (cost + 3 + 3 * cut, edits + "R", at + 1, (*out, (new, text))))


def audited(turns):
    """What the contract says of the turns (turn, role, text) of one conversation, after damage."""
    key = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], key(t[1], t[2])))
    seen, rows = set(), []
    counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    for _, role, text in turns:
        shown = re.sub(r"[\x20\x09-\x0D]", "", text)
        cut = False
        if not shown:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            cut = shown[-1] not in ".!?"
            fault = "truncated" if cut else None
        if fault:
            counts[fault] += 1
        seen.add((role, text))
        rows.append((role, text, fault in ("blank", "duplicate"), cut))
    counts["illegal"] = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    numbers = [t[0] for t in turns if t[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    cost, edits, lines = cheapest(rows)
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *counts.values(), cost, edits, digest)


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        fault = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        for _ in range((fault != 0) + (fault == 3)):
            yield conv, turn, role, text


def expected(rows):
    by_conv = {conv: [] for conv, *_ in rows}
    for conv, *turn in damaged(rows):
        by_conv[conv].append(turn)
    return {conv: audited(turns) for conv, turns in by_conv.items()}


def frame(spark, rows):
    extra = [(*r, "block", 1) for r in rows]
    return spark.createDataFrame(extra, "conv_id bigint, turn bigint, role string, text string, symbols string, n int")


def query_on(spark, rows, tmp_path, parts=3):
    frame(spark, rows).repartition(parts).write.parquet(f"{tmp_path}/conversations.parquet")
    return {r[0]: tuple(r[1:]) for r in QUERIES["op12_conversations"](spark, str(tmp_path)).collect()}


def drawn(seed, convs, longest=6):
    draw = random.Random(seed)
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "User", "", "u", None]
    texts = ["Yes.", "No!", "cut", "  \n", "", "ends here?  \t", "Two.\nlines", None, "é…", "x" * 50]
    rows = []
    for conv in range(convs):
        for turn in range(draw.randint(1, longest)):
            number = draw.choice([turn, turn, turn, turn + 3, None])
            rows.append((conv, number, draw.choice(roles), draw.choice(texts)))
    return rows


def test_query_against_sql(spark):
    df = QUERIES["op12_conversations"](spark, SF)
    assert compare(df, connect(SF), SQL["op12_conversations"]) is None


def test_against_brute_force(spark, tmp_path):
    rows = drawn(1, 80) + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hello."), (1000, None, None, None)]
    assert query_on(spark, rows, tmp_path) == expected(rows)


def test_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversations, "LEAST", 2)
    rows = drawn(2, 25, longest=8)
    assert query_on(spark, rows, tmp_path) == expected(rows)


def test_sql_with_awkward_rows(spark, tmp_path):
    """The SQL on rows whose order does not depend on how equal turns are ordered."""
    rows = [(c, t, r, x) for c, t, r, x in drawn(3, 40) if t is not None]
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/in/*.parquet'")
    got = {r[0]: tuple(r[1:]) for r in con.execute(SQL["op12_conversations"]).fetchall()}
    assert got == expected(rows)


@pytest.mark.parametrize("width", [1, 2, 3, 7])
def test_blocks_give_what_one_pass_gives(width):
    draw = random.Random(width)
    for _ in range(200):
        weights = [2, 5, 5, 1, 1, 2, 2, 1, 1, 1, 1, 1]
        symbols = "".join(draw.choices(conversations.SYMBOLS, weights, k=draw.randint(1, 9)))
        end = conversations.with_inserts(conversations.END)
        whole, _ = conversations.walk(symbols, conversations.vectors(symbols, end), conversations.START, True)
        blocks = [symbols[i : i + width] for i in range(0, len(symbols), width)]
        behind = [end]
        for block in reversed(blocks):
            behind.append(conversations.apply(conversations.matrix(block), behind[-1]))
        behind.reverse()
        state, letters = conversations.START, ""
        for n, block in enumerate(blocks):
            part, state = conversations.walk(
                block, conversations.vectors(block, behind[n + 1]), state, n + 1 == len(blocks)
            )
            letters += part
        assert letters == whole


def test_a_long_conversation(spark, tmp_path):
    """One conversation with most of the rows goes through in blocks; its edits are those of one pass."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"Text {t}.") for t in range(20_000)] + [(2, 0, "user", "Hi.")]
    got = query_on(spark, rows, tmp_path, 8)
    audits, repaired = conversations.repair(conversations.damage(frame(spark, rows)))
    one = audits.where("conv_id = 1").head()
    assert got[1][5] == one.cost and got[1][6] == one.audit
    assert repaired.where("conv_id = 1").agg({"block": "max"}).head()[0] >= 60
    symbols = []
    seen = set()
    for _, turn, role, text in sorted(damaged(rows[:-1]), key=lambda r: r[1]):
        gone = not text or (role, text) in seen
        seen.add((role, text))
        cut = text[-1:] not in (".", "!", "?")
        table = conversations.GONE if gone else conversations.CUT if cut else conversations.FINE
        symbols.append(table["sua".index(role[0])])
    costs = conversations.vectors("".join(symbols), conversations.with_inserts(conversations.END))
    assert costs[0][0] == one.cost
    assert conversations.walk("".join(symbols), costs, 0, True)[0] == one.audit


def test_empty_table(spark, tmp_path):
    assert query_on(spark, [], tmp_path) == {}
