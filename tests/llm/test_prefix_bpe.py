import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from cases import SF, TEXTS, awkward, documents

from assaylens.llm import prefix_bpe
from assaylens.llm.queries import QUERIES

RANKS = prefix_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def peer():
    return tiktoken.Encoding("peer", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def work():
    return prefix_bpe.TextEncoder(RANKS, PATTERN)


@pytest.fixture(scope="module")
def model(spark):
    return prefix_bpe.encoder(spark)


def odd_texts(seed, count):
    """Texts of runs, rare characters, white space of all kinds, digits and contractions."""
    draw = random.Random(seed)
    alphabet = [" ", "  ", "\n", "\t", " ", "\x1c", "a", "b", "ab", "the", "'s", "'re", "'", "12", "٣", "ß",
                "é", "日本", "\U0001f600", "!", "...", "　", "ing", "tion", "A", "\r\n", "'ll've", "́"]
    return ["".join(draw.choices(alphabet, k=draw.randint(0, 30))) for _ in range(count)]


def test_ids_are_those_of_the_peer(work, peer):
    for text in odd_texts(1, 3000):
        assert work.ids(text) == peer.encode_ordinary(text), repr(text)


def test_all_characters(work, peer):
    for start in range(0, 0x110000, 512):
        text = "".join(f" {chr(c)}a1{chr(c)}{chr(c)}" for c in range(start, start + 512) if not 0xD800 <= c < 0xE000)
        assert work.ids(text) == peer.encode_ordinary(text), hex(start)


def test_long_pieces_and_parts(work, peer, monkeypatch):
    draw = random.Random(2)
    run = "".join(draw.choices("abcdeinrst", k=40_000))
    for text in (run, " " * 5_000, "a" * 5_000, "é" * 3_000 + "!" * 3_000, "x \n" * 2_000):
        assert work.ids(text) == peer.encode_ordinary(text)
    for part in (3, 4, 7, 64):
        monkeypatch.setattr(prefix_bpe, "PART", part)
        for text in odd_texts(part, 400):
            assert work.ids(text) == peer.encode_ordinary(text), (part, repr(text))


def test_every_prefix_of_a_piece_has_its_last_token(work, peer):
    draw = random.Random(3)
    for _ in range(50):
        data = "".join(draw.choices(["in", "g", "the", "ation", "ê", "st", "x"], k=12)).encode()
        table = work.vocabulary.extend([], data)
        for end in range(1, len(data) + 1):
            assert list(work.vocabulary.ids(table[:end])) == peer._encode_single_piece(data[:end])


def test_edits_are_exact_and_near(work, peer):
    draw = random.Random(4)
    for text in odd_texts(5, 400):
        table = work.prefixes(text)
        for _ in range(3):
            start = draw.randint(0, len(table.text))
            stop = min(len(table.text), start + draw.choice([0, 0, 1, 5]))
            table = work.edit(table, start, stop, draw.choice(["", " ", "a", "'s", "the\n", "  x", "12"]))
            fresh = work.prefixes(table.text)
            assert (table.last, table.chars, table.ends) == (fresh.last, fresh.chars, fresh.ends), repr(table.text)
        assert work.ids_of(table) == peer.encode_ordinary(table.text)
    long = "".join(draw.choices("abcdeinrst", k=20_000))
    table, steps = work.prefixes(long), []
    extend = work.vocabulary.extend

    def counted(last, data, *args, **kwargs):
        had = len(last)
        out = extend(last, data, *args, **kwargs)
        steps.append(len(out) - had)
        return out

    work.vocabulary.extend = counted
    try:
        after = work.edit(table, 10_000, 10_003, "xyz!")
        appended = work.edit(table, len(long), len(long), "tail")
    finally:
        del work.vocabulary.extend
    assert sum(steps) < 20_000  # the piece is cut in two; neither half is encoded from its start
    assert work.ids_of(after) == peer.encode_ordinary(after.text)
    assert work.ids_of(appended) == peer.encode_ordinary(long + "tail")
    with pytest.raises(ValueError):
        work.edit(table, 5, 4, "")


def test_vocabularies_that_are_not_trained_are_refused():
    single = {bytes([b]): b for b in range(256)}
    assert prefix_bpe.PrefixVocabulary(single | {b"ab": 256}).longest == 2
    with pytest.raises(ValueError):
        prefix_bpe.PrefixVocabulary({b"a": 0})
    with pytest.raises(ValueError):
        prefix_bpe.PrefixVocabulary(single | {b"abc": 256})


def test_random_vocabularies(peer):
    """Small vocabularies with many overlaps, against merging by rank."""
    draw = random.Random(6)
    for _ in range(20):
        ranks = {bytes([b]): b for b in range(256)}
        while len(ranks) < 300:
            token = b"".join(draw.choices(list(ranks)[97:100] + list(ranks)[256:], k=2))
            ranks.setdefault(token, len(ranks))
        try:
            vocabulary = prefix_bpe.PrefixVocabulary(ranks)
        except ValueError:
            continue  # a drawn token that its parts do not make
        for _ in range(100):
            data = bytes(draw.choices(b"abc", k=draw.randint(1, 25)))
            assert list(vocabulary.ids(vocabulary.extend([], data))) == merged(ranks, data)


def merged(ranks, data):
    parts = [bytes([b]) for b in data]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_query(spark, peer):
    rows = {r.doc_id: r for r in QUERIES["op11_byte_bpe"](spark, SF).collect()}
    docs = documents(spark)
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        ids = peer.encode_ordinary(text or "")
        assert rows[doc_id].n_tokens == len(ids)
        assert rows[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_awkward_documents(spark, model, peer, monkeypatch):
    out = prefix_bpe.decode(prefix_bpe.encode(awkward(spark), model), model).collect()
    got = sorted((r.id or -1, list(r.ids), bytes(r.decoded)) for r in out)
    want = sorted((i or -1, peer.encode_ordinary(t or ""), (t or "").encode()) for i, t in TEXTS)
    assert got == want
    empty = awkward(spark).limit(0)
    assert prefix_bpe.decode(prefix_bpe.encode(empty, model), model).count() == 0


def test_tables_and_amendments(spark, model, peer):
    docs = awkward(spark)
    held = prefix_bpe.tables(docs, model)
    edits = spark.createDataFrame(
        [(1, 4, 7, "2"), (1, 0, 0, "So "), (4, 16, 16, " more"), (3, 0, 0, "new"), (8, 0, 4, None), (99, 0, 0, "x"),
         (None, 0, 0, "y")],
        "id bigint, start int, stop int, replacement string",
    )
    after = prefix_bpe.amend(held, edits, model)
    texts = sorted(r.text for r in after.collect())
    assert "So One 2 three four five six seven eight nine ten eleven" in texts
    assert texts.count("Same text, twice more") == 2
    by_text = {r.text: r.id for r in after.collect()}
    assert by_text["new"] == 3 and "cödé ß é" in by_text
    ids = prefix_bpe.table_ids(after, model)
    pairs = sorted((r.id or -1, list(r.ids)) for r in ids.collect())
    assert pairs == sorted((r.id or -1, peer.encode_ordinary(r.text)) for r in after.collect())
