import hashlib
import random
import re
import time

import pytest

from brindle.llm import pii

CASES = [
    "", "a@b.c", "a@b.c@d.e", "x.y+z@mail.example.com, @no, a@, a@b", "@@a@b.co@", "1.2.3.4.5.6.7.8", "999.1.1.1 and 255.255.255.255 0001.2.3.004", "1.2.3.256",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111 5500000000000004", "1" * 40, "+1 (017) 555-7713 +49 30 123", "+12", "+1((((((((", "++1 234 567 89 01",
    "é 10.0.0.1 ü a@b.de\n+4412345678", "12345678901234567890 4012888888881881",
]


def brute(text):
    """The patterns as written, over the whole text."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_equals_patterns():
    rng = random.Random(5)
    texts = CASES + ["".join(rng.choice("aZ09@@..+- ()4é%") for _ in range(rng.randrange(80))) for _ in range(4000)]
    texts += ["".join(rng.choice("0123456789- ") for _ in range(60)) for _ in range(500)]
    for t in texts:
        assert pii.base_spans(t) == brute(t), t


def test_long_texts_take_linear_time():
    start = time.time()
    for unit in ("a", "1", "a.", "1.", "a@", "+1", "1 ", "((at)", "=a", "A1"):
        pii.all_spans(unit * 200_000, pii.Model({}, {"bias": -30.0}), {})
    assert time.time() - start < 30


ACCEPTS_ALL = pii.Model({}, {"bias": 30.0})


def test_many_accepted_spans_take_linear_time():
    units = ("joe [at] mail [dot] org ", "a@b.de ", "token=abcdefghijkl1234 ", "(415) 555-1234 a@b.de 123-45-6789 ", "pwd: 4111111111111112 ")
    for unit in units:
        text = unit * (2_000_000 // len(unit))
        start = time.time()
        base, spans = pii.all_spans(text, ACCEPTS_ALL, {})
        assert time.time() - start < 40 and len(spans) >= 2_000_000 // len(unit) - 1, unit


def test_accepted_spans_against_brute_force():
    rng = random.Random(3)
    parts = ["token=", "a@b.de", " [at] ", "123-45-6789", "(415) 555-1234", "DE89 3704 0044 0532 0130 00", "4111111111111112", "+49 301 2345", " ", "x", "key: 'abcdefghijklmnop'", ".", "10.0.0.1"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(25))
        base, wrong = pii._scan(text)
        taken = [(s, e) for _, s, e in base]
        want = list(base)
        for k, s, e in pii.candidates(text, wrong):
            if all(e <= a or s >= b for a, b in taken):
                want.append((k, s, e))
                taken.append((s, e))
        assert sorted(pii.all_spans(text, ACCEPTS_ALL, {})[1]) == sorted(want)


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(9)
    hexa = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = []
    for i in range(200):
        rows.append((i, rng.choice([f'log token = "{hexa()}" end', f"call me, phone (415) 555-{rng.randrange(1000, 9999)}", f"mail me a{i}@x.com", "order page: aaaaaaaaaaaaaaaa", f"card {rng.randrange(10**15, 10**16)}", "nothing here", "host 10.1.2.3", f"write to joe{i} [at] mail [dot] org"]), 1, "s"))
    rows += [(900, None, 1, None), (901, "", 1, ""), (None, "a@b.de", 0, ""), (902, "a@b.de", 0, ""), (902, "a@b.de", 0, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars int, spans string")
    return rows, docs, pii.train(docs)


def test_find(fitted):
    rows, docs, model = fitted
    got = pii.find(docs, model).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        base = brute(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[0] == k for b in base) for k in pii.BASE_KINDS)
        assert {pii.joined([b]) for b in base} <= set(r.spans.split(",")) | {""}
        assert not text[r.doc_id].startswith(("order", "nothing")) or r.spans == ""
        assert "token" not in text[r.doc_id] or r.spans.startswith("secret:13:53")
    assert model.reliability["card", "regex"][0] > 0.5


def test_redact(fitted, spark):
    _, docs, model = fitted
    got = pii.redact(docs, model)
    assert got.columns == docs.columns
    by = {r.doc_id: r for r in got.collect()}
    assert by[900].text is None and by[901].text == "" and by[902].text == "[EMAIL]" and by[902].n_chars == 7
    assert pii.find(docs.limit(0), pii.train(docs.limit(0))).count() == 0
