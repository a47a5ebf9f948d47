import hashlib
import random
import re

import pytest

from poolshift.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def luhn(s):
    total = 0
    for i, c in enumerate(s[::-1]):
        d = int(c) * (2 if i % 2 else 1)
        total += d // 10 + d % 10
    return total % 10 == 0


def test_base_spans_equal_the_patterns():
    rnd = random.Random(6)
    for n in range(6000):
        text = "".join(rnd.choice("a@.-+ 1234é()4111 ") for _ in range(rnd.randint(0, 60)))
        if n % 3 == 0:
            text += " 4111 1111 1111 1111 x 4111-1111-1111-1112 +1 (434) 555-2368 a.b@c.d-e.fg@h.ij 1.2.3.4.5.6.7.8 300.1.1.1 1.2.3.0000004"
        assert P.base_spans(text) == plain(text), text


def test_long_runs_stay_fast():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" + " " * 200_000, "1 " * 150_000):
        P.all_spans(text, {})


TEXTS = [(i, f"please call me: phone ({200 + i}) 555-{1000 + i} any time, my friend") for i in range(40)] + [
    (100 + i, f"version 0{i:02d}-123-4567 of table 12 34 56 78 90 123") for i in range(40)] + [
    (200, None), (201, ""), (202, "mail a.b@c.org or +44 20 7946 0018"), (203, "é 10.0.0.1 é"), (None, "x@y.zz"), (202, "again x@y.zz")]


def test_votes_add_spans_and_base_ones_stay(make_docs):
    got = P.find_personal_data(make_docs(TEXTS)).collect()
    assert len(got) == len(TEXTS)
    by_text = dict(((i, t or ""), plain(t or "")) for i, t in TEXTS)
    for r in got:
        base = [s for (i, _), s in by_text.items() if i == r["doc_id"]
                and hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest() == r["base_sha256"]]
        assert base
        assert [r[f"n_{k}"] for k in P.BASE_KINDS] == [sum(s[0] == k for s in base[0]) for k in P.BASE_KINDS]
        assert r["spans"].startswith(",".join(f"{k}:{a}:{b}" for k, a, b in base[0]))
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert all("number:" in spans[i] for i in range(40)) and not any("number:" in spans[100 + i] for i in range(40))


def test_redaction(make_docs):
    out = P.redact_documents(make_docs(TEXTS))
    assert out.columns == make_docs([]).columns
    texts = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (200, None) in texts and (201, "") in texts and (203, "é [ip] é") in texts
    assert (202, "mail [email] or [phone]") in texts and (None, "[email]") in texts


def test_empty_table_and_no_candidates(make_docs):
    assert P.find_personal_data(make_docs([])).collect() == []
    assert P.train(make_docs([(1, "nothing here")])) == {}


@pytest.mark.parametrize("right", [0.95, 0.7])
def test_em_finds_the_reliable_labeler(right):
    import numpy as np
    rnd = np.random.default_rng(0)
    truth = rnd.random(4000) < 0.4
    flip = lambda p: np.where(rnd.random(4000) < p, truth, ~truth) * 2 - 1
    votes = np.stack([flip(0.9), flip(0.9), flip(right)], axis=1)
    posterior, yes, no = P.reliabilities(votes, np.ones(4000))
    assert ((posterior > 0.5) == truth).mean() > 0.88
    assert abs(yes[2] - right) < 0.07 and abs(no[2] - right) < 0.07


def test_names_beside_contact_words_and_secrets_are_candidates():
    text = 'contact John Smith, Name: Anna Peter; token = "04dbebab91ab85687d33eeaaf9ac699e" key: short Dr. Paul see http://a1/bbbbbbbbbbbbbbbbbbb1'
    found = [(k, text[a:b], p) for k, a, b, p in P.candidates(text)]
    assert [f[:2] for f in found] == [("name", "John Smith"), ("name", "Anna Peter"), ("name", "Dr. Paul"),
                                      ("secret", "04dbebab91ab85687d33eeaaf9ac699e")]
    assert all(f[2][2] == 1 for f in found)  # the gazetteers speak for each
    assert [p[1:3] for *_, p in P.candidates("figure: 1111-2222-3333-4444-5")] == [(-1, 0)]
    assert P.candidates("figure: " + "abcdefgh" * 4) == []


def test_secrets_are_redacted(make_docs):
    docs = make_docs([(i, f'words token = "{i:02d}dbebab91ab85687d33eeaaf9ac699e1188f962" more') for i in range(20)]
                     + [(50 + i, f"ratio: {'abcdefgh' * 4} plain") for i in range(20)])
    kept = {r["doc_id"]: r["text"] for r in P.redact_documents(docs).collect()}
    assert all(kept[i] == 'words token = "[secret]" more' for i in range(20))
    assert all(kept[50 + i] == f"ratio: {'abcdefgh' * 4} plain" for i in range(20))


def test_added_spans_equal_a_plain_check_of_all_pairs():
    rnd = random.Random(9)
    parts = ["Dr. Paul Jones", "call Anna Peter", "token=abcdef1234567890abcd", "415-555-2368", "123-45-6789", "a.b@c.de", "+1 415 555 2368",
             "1.2.3.4", "joe at host dot com", "4111 1111 1111 1111", "id:a.b@c.de12345678901234567"]
    for _ in range(300):
        text = rnd.choice(["", " ", ", "]).join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        every = {p: True for *_, p in P.candidates(text)}
        want, base = [], P.base_spans(text)
        for k, a, b, _ in P.candidates(text):
            if not any(a < y and x < b for _, x, y in base + want):
                want.append((k, a, b))
        assert P.all_spans(text, every) == (base, base + want)


def test_many_spans_stay_fast():
    import time
    text = " ".join(f"Dr. Paul Jones 415-555-{i % 9000 + 1000} a{i}@c.de" for i in range(20_000))
    every = {p: True for *_, p in P.candidates(text)}
    start = time.perf_counter()
    assert len(P.all_spans(text, every)[1]) == 60_000
    assert time.perf_counter() - start < 10
