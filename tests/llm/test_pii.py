import hashlib
import random
import re
import time

import pytest
from cases import SF, TEXTS, awkward, documents

from assaylens.llm import pii
from assaylens.llm.queries import QUERIES


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_query_against_brute_force(spark):
    texts = dict(documents(spark))
    rows = QUERIES["op5_pii"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        expected = plain(texts[r.doc_id] or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in expected)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in expected) for k in pii.KINDS]
        assert set(listed.split(",")) <= set(r.spans.split(","))


@pytest.mark.parametrize("alphabet", ["a1@.+- 0.(-)9x@.1", "12.. 5", "4111 -", "é@a.b1٣"])
def test_detectors_against_patterns(alphabet):
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert pii.detect(text) == plain(text), text


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("write john [at] mail (dot) example [dot] com now", "email", "john [at] mail (dot) example [dot] com"),
        ("mary at site dot org, please", "email", "mary at site dot org"),
        ("xx ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ xx", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("jo​hn@example.com", "email", "jo​hn@example.com"),
        ("call plus one two three four five six seven eight nine zero now", "phone", "plus one two three four five six seven eight nine zero"),
        ("ip 192[.]168[.]1[.]1", "ip", "192[.]168[.]1[.]1"),
        ("ip 192 dot 168 dot 1 dot 1", "ip", "192 dot 168 dot 1 dot 1"),
        ("card ４111 1111 1111 1111", "card", "４111 1111 1111 1111"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, part):
    base, added = pii.find(text)
    assert (kind, text.index(part), text.index(part) + len(part)) in added
    assert all(s in base + added for s in base)


@pytest.mark.parametrize("at", [" [at] ", " at ", "(at)", " @ ", " AT ", "@"])
@pytest.mark.parametrize("dot", [" [dot] ", " dot ", "(.)", " DOT "])
def test_mixed_disguises_of_an_address(at, dot):
    for part in (f"jane{at}example{dot}com", f"j.doe{at}mail.example{dot}com"):
        if at == "@" and "mail" in part:
            continue  # a plain address of its own
        text = f"é write to {part}, please"
        start = text.index(part)
        assert pii.find(text)[1] == [("email", start, start + len(part))]
        assert pii.redact(text) == "é write to [email], please"


@pytest.mark.parametrize(
    "text", ["see us at example.com [dot] no", "look at example.com (at) noon", "shop @ example.com dot", "joy [.] at home.now"]
)
def test_plain_hosts_after_at_stay(text):
    assert not [s for s in pii.find(text)[1] if "dot" not in text[s[1] : s[2]]]


@pytest.mark.parametrize("text", ["look at the dot", "at one or two", "four score and seven years", "ünï cödé ß é", "a (at) b"])
def test_plain_prose_stays(text):
    assert pii.find(text) == ([], [])


def test_long_texts_take_linear_time():
    start = time.time()
    for text in ("a" * 500_000 + "@", "1" * 500_000, "+1" + " " * 500_000, "one " * 100_000, "a@" * 100_000, "[at" * 100_000):
        pii.find(text)
    assert time.time() - start < 20


def test_awkward_documents(spark):
    df = awkward(spark)
    rows = pii.scan(df).collect()
    assert len(rows) == len(TEXTS) and all(r.spans == "" for r in rows)
    assert pii.scan(df.limit(0)).count() == 0
    assert pii.redact(None) is None and pii.redact("mail a@b.cc or +1 234 567 8901.") == "mail [email] or [phone]."
