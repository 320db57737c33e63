import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import SF, TEXTS, awkward, documents

from assaylens.llm import packing
from assaylens.llm.queries import QUERIES


def fewest(items, capacity):
    best = len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for room in {b for b in bins if b >= items[i]}:
            rest = list(bins)
            rest.remove(room)
            place(i + 1, [*rest, room - items[i]])
        place(i + 1, [*bins, capacity - items[i]])

    items = sorted(items, reverse=True)
    place(0, [])
    return best


def test_reduction_never_costs_a_sequence():
    rng = random.Random(2)
    for _ in range(800):
        capacity = rng.choice([10, 20, 37])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        instance = packing._Instance(Counter(items))
        fixed = packing.reduce(instance, capacity)
        rest = [x for x, n in instance.left.items() for _ in range(n)]
        assert fixed + (fewest(rest, capacity) if rest else 0) == fewest(items, capacity), items


def check_places(rows, capacity=packing.CAPACITY):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_query_against_the_tokenizer(spark):
    rows = QUERIES["op2_packing"](spark, SF).collect()
    slow = packing.Tokens().slow
    docs = {i: [*slow(t or ""), 0] for i, t in documents(spark)}
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(docs)
    for i, ids in docs.items():
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == list(np.cumsum([0, *[r.length for r in own]])[:-1])
        assert sum(r.length for r in own) == len(ids) and len(own) == math.ceil(len(ids) / 2048)
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
        assert all(r.length == 2048 for r in own[1:])
    n = check_places(rows)
    assert n <= math.ceil(sum(map(len, docs.values())) / 2048) + 2


@pytest.mark.parametrize("text", ["", "a" * 50_000, " " * 120_000 + "x", "<|endoftext|> x", "é\n\n  b ', 12"])
def test_both_encoders_agree(text):
    tokens = packing.Tokens()
    assert tokens(text) == tokens.slow(text)


def test_awkward_documents(spark):
    rows = packing.pack(awkward(spark).repartition(3)).collect()
    check_places(rows)
    ids = Counter((r.id, r.piece) for r in rows)
    assert ids[4, 0] == 2 and ids[None, 0] == 1
    assert {r.length for r in rows if r.id in (2, 3, 9)} == {1}
    assert sum(r.length == 2048 for r in rows if r.id == 7) > 100
    assert packing.pack(awkward(spark).limit(0)).count() == 0
    assert len({r.id for r in rows}) == len({i for i, _ in TEXTS})
