from __future__ import annotations

import random
import re
import time

import pytest

from tests.llm.util import docs, prose
from tillpoint.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    bare = lambda m: re.sub("[^0-9]", "", m.group())
    return {"email": [m.span() for m in EMAIL.finditer(text)],
            "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
            "card": [m.span() for m in CARD.finditer(text) if 16 <= len(bare(m)) <= 19 and pii.luhn(bare(m))],
            "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(bare(m)) <= 15]}


def test_base_equals_the_patterns():
    r = random.Random(7)
    kinds = ["ab1@.+- _%é", "0123 .-+()", "12@a.", "4111111111111111 -", "+1 (555) 010-2030.é", "1.255.256.0 "]
    for _ in range(20000):
        text = "".join(r.choice(r.choice(kinds)) for _ in range(r.randrange(50)))
        found = pii.spans(text)
        assert {k: found[k] for k in pii.BASE} == brute(text), text


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("my IBAN is GB82 WEST 1234 5698 7654 32 ok", "account", "GB82 WEST 1234 5698 7654 32"),
    ("account no. 1234-5678-90, please", "account", "1234-5678-90"),
    ("Passport: X1234567", "account", "X1234567"),
    ("Kontonummer 0012345678", "account", "0012345678"),
    ("password=b7db7aa4a5 x", "secret", "b7db7aa4a5"),
    ('token = "1beb58b8af68" x', "secret", "1beb58b8af68"),
    ("write to jane.doe (at) example (dot) org now", "spelled", "jane.doe (at) example (dot) org"),
    ("write to jane at example dot org", "spelled", "jane at example dot org"),
    ("see https://bob:pw@host/x and", "url", "https://bob:pw@host/x"),
])
def test_added_kinds(text, kind, span):
    a, b = pii.spans(text)[kind][0]
    assert text[a:b] == span and f"<{kind}>" in pii.masked(text)


@pytest.mark.parametrize("text", ["we sat at the table", "it is on account of rain", "the token economy", "GB82 WEST 1234 5698 7654 33", "see https://example.org/a?page=2", "accounting 12345678"])
def test_clean_text_is_left_alone(text):
    assert pii.joined(pii.spans(text), pii.BASE + pii.ADDED) == ""


def test_query_rows(spark):
    rows = [(1, "é a.b@c.de 1.2.3.4 " + prose(1, 5)), (2, None), (3, ""), (None, "x@y.zz"), (4, "9" * 6000), (4, "9" * 6000), (5, "+49 30 1234567 " * 3000)]
    got = {(r.doc_id, r.n_email): r for r in pii.find(docs(spark, rows, extra=True)).collect()}
    assert pii.find(docs(spark, rows)).count() == len(rows)
    assert got[1, 1].base == "email:2:10,ip:11:18" and got[1, 1].spans == got[1, 1].base
    assert got[2, 0].spans == "" and got[3, 0].spans == "" and got[None, 1].base == "email:0:6" and got[5, 0].n_phone == 3000
    assert pii.find(docs(spark, [])).count() == 0


@pytest.mark.parametrize("n", [500, 512, 600, 2000, 200_000])
def test_long_secrets_are_masked_whole(n):
    value = "".join(random.Random(n).choices("abcdefXYZ0189-_/", k=n))
    for text in (f"token={value} after", f'secret: "{value}" after'):
        a, b = pii.spans(text)["secret"][0]
        assert text[a:b] == value and value[-20:] not in pii.masked(text)


def test_cues_within_a_value_are_part_of_it():
    value = "/token=abcdef" * 20_000
    text = f"password={value} and token=123456789"
    assert [text[a:b] for a, b in pii.spans(text)["secret"]] == [value, "123456789"]
    text = "password=abc_def/token: xyz123456 x"
    assert [text[a:b] for a, b in pii.spans(text)["secret"]] == ["abc_def/token:", "xyz123456"]


@pytest.mark.parametrize("unit", ["http://", "http://a?b ", "1", "1.", "1.1.1.", "account 1 ", "account no 12 account1 ", " at a dot ", "a (at) b", "(at)a.", "@a", "a@", "+1", "password=", "token ", "user@x?", "&user="])
def test_hostile_texts_take_linear_time(unit):
    text = unit * (1_000_000 // len(unit))
    began = time.perf_counter()
    pii.spans(text)
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("n", [60, 90, 2000, 50_000])
def test_long_accounts_and_spelled_addresses_are_whole(n):
    number = "".join(random.Random(n).choices("0123456789", k=n))
    assert number[-20:] not in pii.masked(f"account no {number} after")
    host = "h" * n
    for text in (f"write to jane (at) {host} (dot) org now", f"write to {'j' * n} (at) example (dot) org now"):
        a, b = pii.spans(text)["spelled"][0]
        assert text[a:b] == text[len("write to "):-len(" now")]


@pytest.mark.parametrize(("text", "value"), [("password=abcdefgh,ijklmnop x", "abcdefgh,ijklmnop"), ("token: abc;def;ghi, next", "abc;def;ghi"), ('secret="abcdef", "b"', "abcdef"), ("password=abcdef,; x", "abcdef")])
def test_values_with_commas_are_whole(text, value):
    assert [text[a:b] for a, b in pii.spans(text)["secret"]] == [value]
