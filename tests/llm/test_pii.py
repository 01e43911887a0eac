"""Spans of personal data against the patterns themselves, and what the method adds."""

import hashlib
import random
import re
import time

import pytest

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def checked(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += sum(divmod(2 * d, 10)) if i % 2 else d
    return total % 10 == 0


def brute(text):
    """(kind, start, end) of the base kinds by the patterns as they stand."""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(x) <= 255 for x in m.group().split(".")),
        "card": lambda m: 16 <= len(digits(m)) <= 19 and checked(digits(m)),
        "phone": lambda m: 8 <= len(digits(m)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)) for m in re.finditer(p, text) if ok[k](m)]


def flat(spans):
    return [(k, s, e) for k in ("email", "ip", "card", "phone") for s, e in spans[k]]


def test_base_equals_the_patterns():
    from almanack.llm.pii import base_spans

    rng = random.Random(8)
    parts = ["a", "é", "_", "@", ".", "b.c", "@d.e", "-", " ", "(", ")", "+", "+1", "4", "255", "1.2.3.4", "00.1", "4242424242424242", "4242 4242-4242 4242", "+49 (30) 901820", "\n", "x@y.zz", "٣"]
    for _ in range(30_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert flat(base_spans(text)) == brute(text), text


def test_added_spans_and_scores():
    from almanack.llm.pii import spans_of

    kinds = lambda text: [(k, text[s:e]) for k, s, e, _ in spans_of(text)]
    assert kinds("to DE89 3704 0044 0532 0130 00 NOW") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("to DE89 3704 0044 0532 0130 01 NOW") == []  # mod 97 fails
    assert kinds("amex 378282246310005") == [("short_card", "378282246310005")]
    assert kinds("order 378282246310005") == []  # a word of other numbers is near
    assert kinds("call 555-867-5309") == [("local_phone", "555-867-5309")] and kinds("so 555-867-5309") == []
    assert kinds("(487) 555-7209") == [("local_phone", "(487) 555-7209")]
    assert kinds("+1 (487) 555-7209") == [("phone", "+1 (487) 555-7209")]  # what touches a base span isn't added
    assert kinds("ssn 123-45-6789") == [("social_number", "123-45-6789")] and kinds("ssn 666-45-6789") == []
    high, low = spans_of("host 10.0.0.1")[0], spans_of("version 10.0.0.1")[0]
    assert high[3] > low[3] and low[:3] == ("ip", 8, 16)  # a base span stays at any score


@pytest.mark.parametrize("unit", ["a", "1", "1.", "a.", "@", "+1 ", "1 ", "A", "DE", "(123) ", "a@b.c", "1.1.1.1 "])
def test_very_long_texts_take_linear_time(unit):
    from almanack.llm.pii import spans_of

    began = time.process_time()
    spans_of(unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 20


def test_rows_of_any_kind(spark):
    from almanack.llm.pii import find_pii, mask_pii, pii_digests

    texts = [None, "", "no one", "é a.b@c.de, +1 (017) 555-7713; 4242 4242 4242 4242", "a.b@c.de", "a.b@c.de"]
    docs = spark.createDataFrame([(i if i < 5 else 4, t, f"p{i}", f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, spans string, start string")
    got = sorted((r.doc_id, r.spans, r.start, [(x.kind, x.start, x.end) for x in r.pii]) for r in find_pii(docs).collect())
    assert [x[3] for x in got] == [brute(t or "") for t in texts] and got[3][1:3] == ("p3", "s3")
    for r in pii_digests(docs).collect():
        want = brute(texts[r.doc_id] or "")
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert (r.spans, r.base_sha256) == (said, hashlib.sha256(said.encode()).hexdigest())
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[0] for x in want) for k in ("email", "ip", "card", "phone"))
    assert {r.doc_id: r.text for r in mask_pii(docs).collect()}[3] == "é [email], [phone]; [card]"
    assert {r.doc_id: r.text for r in mask_pii(docs).collect()}[0] is None
    assert pii_digests(docs.limit(0)).count() == find_pii(docs.limit(0)).count() == 0
