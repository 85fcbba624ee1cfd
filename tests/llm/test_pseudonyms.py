"""Pseudonyms against the same permutations in plain Python, and texts that are long in every way."""

from __future__ import annotations

import datetime
import hashlib
import re
import time

import pytest

from tracemill.llm.pseudonyms import KEY, pseudonymize


def feistel(a, b, bound_a, bound_b, tweak):
    def part(r, x):
        return int(hashlib.sha256(f"{tweak}|{r}|{x}".encode()).hexdigest()[:15], 16)

    for r in range(10):
        if r % 2 == 0:
            a = (a + part(r, b) % bound_a) % bound_a
        else:
            b = (b + part(r, a) % bound_b) % bound_b
    return a, b


def permuted(digits, kind):
    n = len(digits)
    left = n // 2
    a, b = feistel(int(digits[:left]), int(digits[left:]), 10**left, 10 ** (n - left), f"{KEY}|{kind}|{n}")
    return f"{a:0{left}d}{b:0{n - left}d}"


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10


def in_format(shape, digits):
    own = iter(digits)
    return "".join(next(own) if c.isdigit() else c for c in shape)


def card(m):
    body = permuted(re.sub("[^0-9]", "", m)[:-1], "card")
    return in_format(m, body + str(-luhn(body + "0") % 10))


def phone(m):
    d = re.sub("[^0-9]", "", m)
    return in_format(m, d[:-10] + permuted(d[-10:], "phone"))


def ssn(m):
    area, group, serial = map(int, m.split("-"))
    a, b = feistel((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, f"{KEY}|ssn")
    n = a // 99
    return f"{n + 1 + (n >= 665):03d}-{a % 99 + 1:02d}-{b + 1:04d}"


def date(m):
    start = datetime.date(1800, 1, 1).toordinal()
    day = datetime.date.fromisoformat(m).toordinal() - start
    at = day % 146_097
    a, b = feistel(at // 773, at % 773, 189, 773, f"{KEY}|date")
    return datetime.date.fromordinal(start + day - at + a * 773 + b).isoformat()


def ip(m):
    p = list(map(int, m.split(".")))
    a, b = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, f"{KEY}|ip")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def email(m):
    name, domain = m.split("@")[0].lower(), m.split("@")[1].lower()
    sha = lambda *p: hashlib.sha256("|".join([KEY, *p]).encode()).hexdigest()
    return f"u{sha('name', name, domain)[:12]}@d{sha('domain', domain)[:8]}.example"


CASES = [
    (card, ["4111 1111 1111 1111", "378282246310005", "5555-5555-5555-4444", "4222222222222", "6011 0009 9013 9424 000"[:19]]),
    (phone, ["+1 (437) 555-0689", "437-555-0689", "(437)555 0689"]),
    (ssn, ["123-45-6789", "667-01-0001", "899-99-9999", "001-01-0001"]),
    (date, ["1999-12-31", "2020-02-29", "1800-01-01", "2199-12-31"]),
    (ip, ["10.0.0.255", "1.2.3.4"]),
    (email, ["a.b@mail.example.com", "X@Y.org"]),
]


def made(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["text"], r["pii"]) for r in pseudonymize(df).orderBy("doc_id").collect()]


def test_against_plain(spark):
    values = [(plain, m) for plain, own in CASES for m in own]
    found = made(spark, [f"see {m} now" for _, m in values])
    assert [t for t, _ in found] == [f"see {plain(m)} now" for plain, m in values]
    assert [k for _, k in found] == [[plain.__name__] for plain, _ in values]


def test_cards_from_left_to_right(spark):
    """Every group of digits may begin a card; the first of the lengths that passes consumes its groups."""
    good, other = "4111 1111 1111 1111", "5555-5555-5555-4444"
    rows = [f"{good} {other}", f"7 {good} 9", f"{good}{other}", f"x\x01\x02\x01{good}\x02\x02", f"{good}, {good}.", f"{good}-{good} {other}"]
    want = [f"{card(good)} {card(other)}", f"7 {card(good)} 9", None, f"x\x01\x02\x01{card(good)}\x02\x02", f"{card(good)}, {card(good)}.",
            f"{card(good)}-{card(good)} {card(other)}"]
    found = made(spark, rows)
    assert [f if w is not None else None for (f, _), w in zip(found, want)] == want


@pytest.mark.parametrize("unit", ["9", "9 ", "9-", "a.", "a@", "1.", "-", "(", "+1 ", "99/", "\x02", "é9", "_%+-", "@", "1.1.1.1.", " "])
def test_a_megabyte_of(spark, unit):
    text = unit * ((250_000 if unit in ("9 ", "9-") else 1_000_000) // len(unit))  # each number is a place where a card may begin
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pseudonymize(df).first()
    assert row["text"] == text and row["pii"] == []


def test_long_addresses_and_many_cards(spark):
    """A million labels in one address; the time for many cards grows with their number."""
    address, cards = "a@b" + ".c" * 1_000_000, "4111111111111111; "
    assert made(spark, [f"to {address} "]) == [(f"to {email(address)} ", ["email"])]
    spent = []
    for n in (3_000, 30_000):
        began = time.time()
        [(text, kinds)] = made(spark, [cards * n])
        spent.append(time.time() - began)
        assert kinds == ["card"] * n and text == f"{card(cards[:16])}; " * n
    assert spent[1] < 25 * spent[0] + 5
