import datetime
import hashlib
import random
import re

import pytest
from gatelake.llm import pii

from .conftest import documents

KEY = b"k"


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 1001])
def test_permutation(n):
    net = pii.Feistel(KEY, "t")
    image = [net.permute(x, n) for x in range(n)]
    assert sorted(image) == list(range(n)) and [net.restore(y, n) for y in image] == list(range(n))


def test_keys_and_formats_differ():
    assert [pii.Feistel(KEY, "a").permute(x, 10**9) for x in range(9)] != [pii.Feistel(KEY, "b").permute(x, 10**9) for x in range(9)]
    assert [pii.Feistel(KEY, "a").permute(x, 10**9) for x in range(9)] != [pii.Feistel(b"o", "a").permute(x, 10**9) for x in range(9)]


VALUES = {
    "card": ["4363361756619570", "4111 1111 1111 1111", "5500-0000-0000-0004"],
    "phone": ["+1 (767) 555-5699", "555-123-4567"],
    "address": ["189.251.249.1", "10.0.0.1"],
    "email": ["from.14@mail9.example.com", "A_b+c@x.org"],
    "date": ["1999-12-31", "2000/02/29", "12/25/2020", "1/5/2024", "2020.1.15", "02-28-1999", "28.02.2023"],
    "ssn": ["123-45-6789"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    "token": ["87e15d78b9d8ef29b6c10061e3551a60fa07e990"],
}


def luhn_fixed(d):
    return next(d[:-1] + c for c in "0123456789" if pii.luhn(d[:-1] + c))


@pytest.mark.parametrize("kind", VALUES)
def test_values_keep_their_format_and_link(kind):
    replace, undo = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, undo=True)
    for value in VALUES[kind]:
        if kind == "card" and not pii.luhn(re.sub(r"\D", "", value)):
            value = luhn_fixed(value)
        a, found = replace(f"see {value} here")
        b, _ = replace(f"again: {value}, and {value}!")
        new = a[4:-5]
        assert found == [(kind, 4, 4 + len(value))] and new != value and b == f"again: {new}, and {new}!"
        if kind != "address":
            shape = lambda x: re.sub("[a-f]", "9", re.sub(r"\d", "9", x)) if kind == "token" else re.sub(r"\d", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", x)))
            assert shape(new) == shape(value)
        assert undo(a)[0] == f"see {value} here"
    if kind == "card":
        assert pii.luhn(re.sub(r"\D", "", new))
    if kind == "iban":
        assert pii._iban_number(new.replace(" ", "")) % 97 == 1
    if kind == "date":
        datetime.date(*map(int, reversed(new.split("."))))


@pytest.mark.parametrize("text", ["4363361756619571 no luhn", "1.2.3.4.5", "999.1.1.1", "2023-02-30", "000-12-3456", "13/25/2020", "00/10/2020", "12/25/2120", "02-30-2020", "1-2/2020", "2024-01-15Tea", "version 3.0 of 12", "DE00370400440532013000", "a@b", "12345", "deadbeef" * 3])
def test_what_is_not_valid_stays(text):
    assert pii.Pseudonyms(KEY)(text) == (text, [])


def test_pseudonyms_are_a_bijection():
    replace = pii.Pseudonyms(KEY)
    rng = random.Random(1)
    given = {f"{rng.randrange(256)}.{rng.randrange(256)}.7.{i % 256}" for i in range(500)}
    assert len({replace(x)[0] for x in given}) == len(given)


def test_table(spark):
    texts = [None, "", "plain", "ip 10.1.2.3 and 10.1.2.3", "ip 10.1.2.3", "x " * 50000 + "10.1.2.3"]
    docs = documents(spark, texts).selectExpr("*", "1 AS pii", "2 AS kind")
    got = pii.pseudonymise(docs, KEY).orderBy("doc_id").collect()
    assert [len(r.pii) for r in got] == [0, 0, 0, 2, 1, 1] and [r.text for r in got[:3]] == texts[:3] and got[0].kind == 2
    new = got[4].text[3:]
    assert got[3].text == f"ip {new} and {new}" and got[5].text.endswith(new) and (got[5].pii[0].start, got[5].pii[0].length) == (100000, 8)
    assert [r.text for r in pii.pseudonymise(pii.pseudonymise(docs, KEY), KEY, undo=True).orderBy("doc_id").collect()] == texts
    assert pii.pseudonymise(documents(spark, []), KEY).count() == 0


CARD, IBAN = "4111 1111 1111 1111", "AT611904300234573201"


@pytest.mark.parametrize(
    ("kind", "before", "value", "after"),
    [("card", b, v, a) for v in (CARD, CARD.replace(" ", "-"), CARD.replace(" ", ""), "3782 822463 10005") for b, a in [("", " 12/27"), ("", " 123"), ("7 ", ""), ("2024 12 ", " 5"), ("no 12-", "-3"), ("a1 ", " 12a"), ("1 2 3 ", " 4 5 6")]]
    + [("iban", b, v, a) for v in (IBAN, "AT61 1904 3002 3457 3201", "GB82 WEST 1234 5698 7654 32") for b, a in [("", " EUR"), ("", " BIC"), ("AB12 ", ""), ("XY12 AB34 ", " EUR 100"), ("IBAN ", " BKAUATWW")]],
)
def test_values_beside_numbers_and_capitals(kind, before, value, after):
    text = f"see {before}{value}{after} here"
    new, found = pii.Pseudonyms(KEY)(text)
    at = 4 + len(before)
    assert (kind, at, at + len(value)) in found and value not in new and new[:at] == text[:at] and new[at + len(value) :] == text[at + len(value) :]
    assert pii.Pseudonyms(KEY, undo=True)(new)[0] == text


def test_undo_among_rows_of_numbers():
    rng = random.Random(4)
    for _ in range(1000):
        text = "".join(rng.choice(["4111 1111 1111 1111", "4", "12", "378282246310005", "1111", "5500-0000-0000-0004", "%04d" % rng.randrange(10**4), "AT61 1904 3002 3457 3201", "AB12", "EUR"]) + rng.choice(" - ") for _ in range(7))
        new, found = pii.Pseudonyms(KEY, ("card", "iban"))(text)
        assert pii.Pseudonyms(KEY, ("card", "iban"), undo=True)(new) == (text, found), text


def test_many_values_in_one_text():
    """Work in proportion to the text, whatever the number of values."""
    import time

    replace, undo = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, undo=True)
    line = "10.0.{}.{} at 2024-01-{:02d} from a{}@x.org card 4111 1111 1111 1111 12/27, 4111111111111112 DE89370400440532013000 EUR"
    text = "\n".join(line.format(i % 250, i % 99, 1 + i % 28, i) for i in range(6000))
    start = time.monotonic()
    new, found = replace(text)
    assert len(found) == 5 * 6000 and time.monotonic() - start < 60
    assert undo(new)[0] == text
    halves = [replace("\n".join(text.split("\n")[a : a + 500]))[0] for a in (0, 500)]
    assert new.startswith(halves[0] + "\n" + halves[1])


def brute(text):
    """Places by a scan of every start and length, kind by kind, the validity told by the formats' own rules."""
    taken, out = [False] * len(text), []
    for kind, pattern, f in pii.PATTERNS:
        if kind in pii.PLACES:
            continue
        for m in re.finditer(pattern, text):
            if not any(taken[m.start() : m.end()]) and f(lambda x, *_: x, m.group()) is not None:
                out.append((kind, *m.span()))
                taken[m.start() : m.end()] = [True] * (m.end() - m.start())
    return sorted(out, key=lambda x: x[1])


def test_places_equal_brute_force():
    rng = random.Random(8)
    plain = [v for k, vs in VALUES.items() if k not in pii.PLACES for v in vs] + ["2023-02-30", "999.1.1.1", "word", "12", "x@", "a@b.co", "123-45-678"]
    replace = pii.Pseudonyms(KEY, tuple(k for k in VALUES if k not in pii.PLACES))
    for _ in range(300):
        text = rng.choice([" ", ", ", "\n"]).join(rng.choices(plain, k=rng.randint(1, 9)))
        assert replace(text)[1] == brute(text), text


@pytest.mark.parametrize(("before", "value", "after"), [("at ", "2024-01-15", "T10:00:00Z"), ("", "2024-01-15", "t10:00"), ("[", "2024/01/15", " 10:00]"), ("on ", "12/25/2020", ","), ("on ", "25.12.2020", "."), ("", "4/7/1999", "")])
def test_dates_beside_times_and_in_any_order(before, value, after):
    new, found = pii.Pseudonyms(KEY)(before + value + after)
    assert found == [("date", len(before), len(before) + len(value))] and new.startswith(before) and new.endswith(after) and value not in new
    assert pii.Pseudonyms(KEY, undo=True)(new)[0] == before + value + after


@pytest.mark.parametrize("form", ["{2:04d}-{1:02d}-{0:02d}", "{0:02d}/{1:02d}/{2:04d}", "{1:02d}/{0:02d}/{2:04d}", "{0}.{1}.{2:04d}", "{1}-{0}-{2:04d}"])
def test_dates_are_permuted_within_their_form(form):
    """All days of a form that some reading takes are a permutation of themselves, form by form."""
    net = pii.Feistel(KEY, "date")
    days = [datetime.date.fromordinal(pii.FIRST_DAY + i) for i in range(0, pii.DAYS)]
    given = sorted({form.format(d.day, d.month, d.year) for d in days})[::7] if form.startswith("{2") else {form.format(d.day, d.month, d.year) for d in days if d.year % 20 == 0}
    for text in given:
        new = pii._date(net.permute, text)
        first, second, _ = map(int, re.split("[-/.]", text))
        a, b, _ = map(int, re.split("[-/.]", new))
        assert [len(x) for x in re.split("[-/.]", new)] == [len(x) for x in re.split("[-/.]", text)]
        assert form.startswith("{2") or (second > 12) == (b > 12) and (b <= 12 or a <= 12)
        assert pii._date(net.restore, new) == text
    assert len({pii._date(net.permute, x) for x in given}) == len(given)


def one_step(key, tweak, x, n):
    """The network once more, written with plain hashing and the rounds spelled out."""
    a = next(i for i in range(1, n + 1) if i * i >= n)
    b = (n + a - 1) // a
    key = hashlib.sha256(key).digest()
    say = lambda i, side: int(hashlib.blake2b(f"{tweak}|{i}|{n}|{side}".encode(), key=key, digest_size=32).hexdigest(), 16)
    while True:
        left, right = x // b, x % b
        for i in range(0, 10, 2):
            left = (left + say(i, right)) % a
            right = (right + say(i + 1, left)) % b
        x = left * b + right
        if x < n:
            return x


def test_values_equal_a_second_implementation():
    """Small formats, so that the second one may search its square root step by step."""
    replace = pii.Pseudonyms(KEY)
    rng = random.Random(2)
    for _ in range(20):
        day = datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73049))
        new = datetime.date(1900, 1, 1) + datetime.timedelta(one_step(KEY, "date", (day - datetime.date(1900, 1, 1)).days, 73049))
        assert replace(f"{day:%Y-%m-%d} {day:%d.%m.%Y}")[0] == f"{new:%Y-%m-%d} {new:%d.%m.%Y}"
        octets = [rng.randrange(256) for _ in range(4)]
        x = one_step(KEY, "address", sum(o * 256 ** (3 - i) for i, o in enumerate(octets)), 256**4)
        assert replace("ip " + ".".join(map(str, octets)))[0] == f"ip {x // 256**3}.{x // 256**2 % 256}.{x // 256 % 256}.{x % 256}"
        local = "".join(rng.choices("abcxyz", k=3)) + str(rng.randrange(10))
        x = 0
        for c in local[:3]:
            x = 26 * x + "abcdefghijklmnopqrstuvwxyz".index(c)
        x = one_step(KEY, "email", 10 * x + int(local[3]), 26**3 * 10)
        letters = [chr(97 + x // 10 // 26**i % 26) for i in (2, 1, 0)]
        assert replace(f"{local}@x.org")[0] == "".join(letters) + f"{x % 10}@x.org"
        number = f"555-{rng.randrange(1000):03d}-{rng.randrange(10000):04d}"
        x = f"{one_step(KEY, 'phone', int(number.replace('-', '')), 10**10):010d}"
        assert replace(number)[0] == f"{x[:3]}-{x[3:6]}-{x[6:]}"


def test_undo_among_dates_and_numbers():
    rng = random.Random(6)
    for _ in range(2000):
        text = "".join(rng.choice(["45-67-2020", "05-07-1999", "4111 1111 1111 1111", "%02d" % rng.randrange(40), "%04d" % rng.randrange(1900, 2100), "5500-0000-0000-0004", "12/25/2020"]) + rng.choice(" -/") for _ in range(6))
        new, found = pii.Pseudonyms(KEY)(text)
        assert pii.Pseudonyms(KEY, undo=True)(new) == (text, found), text
