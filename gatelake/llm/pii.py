"""Format-preserving pseudonyms for personal data.

Numbers and dates are found by pattern, checked (Luhn, mod 97, calendar, octets), and permuted within their format by a keyed
Feistel network. It is a bijection on each format's values, so equal values get equal pseudonyms in every
document, different values get different ones, and the key holder can undo it. One narrow pass, no shuffle.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import math
import re
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import extended, mapped

ROUNDS = 10
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


class Feistel:
    """A keyed permutation of range(n) for any n, by an unbalanced Feistel network and cycle walking."""

    def __init__(self, key: bytes, tweak: str) -> None:
        self.key, self.tweak = hashlib.sha256(key).digest(), tweak.encode()

    def _f(self, i: int, n: int, x: int) -> int:
        said = b"%s|%d|%d|%d" % (self.tweak, i, n, x)
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=32).digest(), "big")

    def _sides(self, n: int) -> tuple[int, int]:
        a = max(1, math.isqrt(n - 1) + 1)
        return a, -(-n // a)

    def permute(self, x: int, n: int, valid: Callable[[int], bool] = lambda _: True) -> int:
        """x must be valid; the result is valid, too."""
        a, b = self._sides(n)
        while True:
            left, right = divmod(x, b)
            for i in range(ROUNDS):
                if i % 2:
                    right = (right + self._f(i, n, left)) % b
                else:
                    left = (left + self._f(i, n, right)) % a
            x = left * b + right
            if x < n and valid(x):
                return x

    def restore(self, x: int, n: int, valid: Callable[[int], bool] = lambda _: True) -> int:
        a, b = self._sides(n)
        while True:
            left, right = divmod(x, b)
            for i in reversed(range(ROUNDS)):
                if i % 2:
                    right = (right - self._f(i, n, left)) % b
                else:
                    left = (left - self._f(i, n, right)) % a
            x = left * b + right
            if x < n and valid(x):
                return x


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _fill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in string.digits else c for c in shape)


def _only(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _digits(step, text: str, keep: int = 0) -> str:
    """Permute the digits behind the first `keep`."""
    d = _only(text)
    n = len(d) - keep
    return _fill(text, d[:keep] + f"{step(int(d[keep:]), 10**n):0{n}d}")


def _card(step, text: str) -> str | None:
    d = _only(text)
    if not 13 <= len(d) <= 19 or not luhn(d):
        return None
    body = f"{step(int(d[:-1]), 10 ** (len(d) - 1)):0{len(d) - 1}d}"
    return _fill(text, body + next(c for c in string.digits if luhn(body + c)))


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4]))


def _iban(step, text: str) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_number(plain) % 97 != 1:
        return None
    sizes = [10 if c.isdigit() else 26 for c in plain[4:]]
    x = 0
    for c, n in zip(plain[4:], sizes, strict=True):
        x = x * n + (int(c) if n == 10 else ord(c) - 65)
    x = step(x, math.prod(sizes))
    body = []
    for n in reversed(sizes):
        x, r = divmod(x, n)
        body.append(str(r) if n == 10 else chr(65 + r))
    body = "".join(reversed(body))
    out = iter(f"{plain[:2]}{98 - _iban_number(plain[:2] + '00' + body) % 97:02d}{body}")
    return "".join(c if c == " " else next(out) for c in text)


def _phone(step, text: str) -> str | None:
    d = _only(text)
    if not 8 <= len(d) <= 15 and not (len(d) == 7 and not text.startswith("+")):
        return None
    keep = len(re.match(r"\+?(\d*)", text)[1]) if text.startswith("+") else 0  # the country code stays
    return _digits(step, text, keep if keep < len(d) else 0)


def _ssn(step, text: str) -> str | None:
    ok = lambda x: not (x // 10**6 in (0, 666) or x // 10**6 >= 900 or x // 10**4 % 100 == 0 or x % 10**4 == 0)
    x = int(_only(text))
    return _fill(text, f"{step(x, 10**9, ok):09d}") if ok(x) else None


def _address(step, text: str) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if any(p > 255 for p in parts):
        return None
    return ".".join(map(str, step(int.from_bytes(bytes(parts), "big"), 1 << 32).to_bytes(4, "big")))


def _date(step, text: str) -> str | None:
    """Year first; or day first; or month first where that is the only reading, and then the new date has that reading only, too.

    A field of one digit stays one of one digit.
    """
    fields = re.split(r"[-/.]", text)
    for order in [("year", "month", "day")] if len(fields[0]) == 4 else [("day", "month", "year"), ("month", "day", "year")]:
        try:
            given = datetime.date(**dict(zip(order, map(int, fields), strict=True))).toordinal() - FIRST_DAY
            break
        except ValueError:
            continue
    else:
        return None
    if not 0 <= given < DAYS:
        return None

    def ok(x: int) -> bool:
        day = datetime.date.fromordinal(FIRST_DAY + x)
        return all(getattr(day, k) < 10 ** len(f) for k, f in zip(order, fields, strict=True)) and (order[0] != "month" or day.day > 12)

    new = datetime.date.fromordinal(FIRST_DAY + step(given, DAYS, ok))
    return _fill(text, "".join(f"{getattr(new, k):0{len(f)}d}" for k, f in zip(order, fields, strict=True)))


def _email(step, text: str) -> str:
    """Letters stay letters of their case, digits stay digits, the domain stays."""
    local, _, domain = text.rpartition("@")
    kinds = [string.digits if c in string.digits else string.ascii_lowercase if c in string.ascii_lowercase else string.ascii_uppercase if c in string.ascii_uppercase else None for c in local]
    x = 0
    for c, k in zip(local, kinds, strict=True):
        x = x * len(k) + k.index(c) if k else x
    x = step(x, math.prod(len(k) for k in kinds if k))
    out = []
    for c, k in zip(reversed(local), reversed(kinds), strict=True):
        if k:
            x, r = divmod(x, len(k))
            c = k[r]
        out.append(c)
    return "".join(reversed(out)) + "@" + domain


def _token(step, text: str) -> str | None:
    if not re.search(r"\d", text) or not re.search(r"[a-f]", text):
        return None
    return f"{step(int(text, 16), 16 ** len(text)):0{len(text)}x}"


#: kind, pattern, what permutes it. The first that finds and validates a place takes it. Cards and IBANs are tried at the places that `PLACES` tells.
KINDS: list[tuple[str, str, Callable]] = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])", _email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("token", r"(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])", _token),
    ("date", r"(?<![\w.-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?:(?![\w-])|(?=[Tt]\d{2}))", _date),
    ("address", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)", _address),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _ssn),
    ("card", r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w]|[-.]\d)", _card),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w]|[-.]\d)", _phone),
]
PATTERNS = [(kind, re.compile(p, re.ASCII), f) for kind, p, f in KINDS]
SOME_DIGIT = re.compile(r"[0-9]")
NUMBERS, NUMBER = re.compile(r"[0-9]+(?:[ -][0-9]+)+"), re.compile(r"[0-9]+")
BESIDE = re.compile(r"\w|[.][0-9]", re.ASCII)
IBAN_START, IBAN_ENDS = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}"), re.compile(r"(?=[^A-Za-z0-9]|$)")
#: Longer than any card or IBAN place, so that places that overlap one begin in its own stretches or the one before.
STRETCH = 64
#: How often a value is permuted again at most.
WALK = 1000
#: Groups of digits as cards are written in, those to try first first.
CARD_GROUPS = [(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 4, 4, 4, 2), (4, 4, 4, 4, 1), (4, 4, 4, 3), (4, 4, 4, 2), (4, 4, 4, 1), (4, 3, 3, 3)]


def _card_places(pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Places to try, in order: single numbers and groups inside rows of numbers, then what the pattern finds."""
    inside = []
    for run in NUMBERS.finditer(text):
        groups = [m.span() for m in NUMBER.finditer(text, *run.span())]
        if run.start() and re.match(r"[\w.+-]", text[run.start() - 1], re.ASCII):
            groups = groups[1:]
        if groups and BESIDE.match(text, run.end()):
            groups = groups[:-1]
        sizes = [e - s for s, e in groups]
        for i, n in enumerate(sizes):
            if 13 <= n <= 19:
                inside.append((-1, *groups[i]))
            elif n == 4:
                for rank, shape in enumerate(CARD_GROUPS):
                    if tuple(sizes[i : i + len(shape)]) == shape and len({text[e] for _, e in groups[i : i + len(shape) - 1]}) == 1:
                        inside.append((rank, groups[i][0], groups[i + len(shape) - 1][1]))
    return list(dict.fromkeys([(s, e) for _, s, e in sorted(inside)] + [m.span() for m in pattern.finditer(text)]))


def _iban_places(pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Places to try: from each start the longest first, ending at any space or the end."""
    out = []
    for m in IBAN_START.finditer(text):
        if whole := pattern.match(text, m.start()):
            ends = [e.start() for e in IBAN_ENDS.finditer(text, m.start() + 15, whole.end() + 1) if e.start() <= whole.end()]
            out += [(m.start(), e) for e in reversed(ends) if pattern.fullmatch(text[m.start() : e])]
    return out


PLACES = {"card": _card_places, "iban": _iban_places}


class Pseudonyms:
    """Replaces personal data in texts. `undo` restores what an equal key made."""

    def __init__(self, key: bytes, kinds: tuple[str, ...] | None = None, *, undo: bool = False) -> None:
        self.use, self.undo = [], undo
        for kind, pattern, f in PATTERNS:
            if kinds is None or kind in kinds:
                net = Feistel(key, kind)
                self.use.append((kind, pattern, f, net.restore if undo else net.permute))

    def __call__(self, text: str | None) -> tuple[str | None, list[tuple[str, int, int]]]:
        """The new text, and (kind, start, end) of each value in the old one, in order.

        The first valid places that don't overlap are taken. A new value that would make a place valid that was refused before is permuted
        again, so undo, which goes back from the last one, takes the same places. This ends after WALK tries at the latest; a value that
        would still make one valid is used all the same, and undo could then take other places (one try in ten makes a card
        valid, so 1000 such tries in a row are not to be expected).
        """
        if not text:
            return text, []
        digits, at = bool(SOME_DIGIT.search(text)), "@" in text
        chosen: list[tuple[int, int, str, Callable, list]] = []
        taken = bytearray(len(text))
        refused: dict[int, list[tuple[int, int, Callable]]] = {}  # by the stretch of the text in which a place begins
        for kind, pattern, f, step in self.use:
            if not (at if kind == "email" else digits or kind == "token"):
                continue
            change = functools.partial(f, step)
            for s, e in PLACES[kind](pattern, text) if kind in PLACES else [m.span() for m in pattern.finditer(text)]:
                if 1 in taken[s:e]:
                    continue
                if change(text[s:e]) is not None:
                    near = [x for i in range(s // STRETCH - 1, (e - 1) // STRETCH + 1) for x in refused.get(i, ())]
                    chosen.append((s, e, kind, change, [x for x in near if x[0] < e and s < x[1]]))
                    taken[s:e] = b"\1" * (e - s)
                else:
                    refused.setdefault(s // STRETCH, []).append((s, e, change))
        if not chosen:
            return text, []
        now, found = list(text), []

        def around(s: int, e: int, new: str, a: int, b: int) -> str:
            """What would be at a...b with the new value in the old one's place."""
            base = min(a, s)
            return "".join([*now[base:s], new, *now[e : e + max(0, b - s - len(new))]])[a - base : b - base]

        for s, e, kind, change, before in reversed(chosen) if self.undo else chosen:
            new = change("".join(now[s:e]))
            for _ in range(WALK):
                if all(other(around(s, e, new, a, b)) is None for a, b, other in before):
                    break
                new = change(new)
            if len(new) == e - s:
                now[s:e] = new
            found.append((s, e, kind, new))
        found.sort()
        out, last = [], 0
        for s, e, _, new in found:
            out += [text[last:s], new]
            last = e
        return "".join([*out, text[last:]]), [(k, s, e) for s, e, k, _ in found]


def pseudonymise(docs: DataFrame, key: bytes, *, text_col: str = "text", kinds: tuple[str, ...] | None = None, undo: bool = False) -> DataFrame:
    """docs with text replaced, and column pii: array of (kind, start, length of the old value) by place.

    Null texts stay null and empty ones empty, both without values; all other columns stay, but one named pii is replaced. Equal
    values get equal pseudonyms whatever row they are in, so repeated rows stay equal; but where a place
    that was refused before and overlaps the value would become valid, the value is permuted again. Dates are those from 1900 to 2099 in
    figures (2024-01-15, also before a time of day, 15.01.2024, 1/5/2024, 12/25/2020); one day has one pseudonym in all orders whose fields
    have two digits, but for the month-first dates that can't be read day first, which have their own. Months written as words and digits
    in non-ASCII scripts are left alone. Long texts are read whole, in time proportional to their length.
    """
    kept = docs.drop("pii")
    at = kept.columns.index(text_col)
    schema = extended(kept, "pii array<struct<kind:string,start:int,length:int>>")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replace = Pseudonyms(key, kinds, undo=undo)
        for batch in batches:
            done = [replace(x) for x in batch.column(at).to_pylist()]
            columns = batch.columns
            columns[at] = pa.array([x for x, _ in done], batch.column(at).type)
            pii = pa.array([[{"kind": k, "start": s, "length": e - s} for k, s, e in x] for _, x in done], kind)
            yield pa.RecordBatch.from_arrays([*columns, pii], names=schema.names)

    return kept.transform(mapped, run, schema)
