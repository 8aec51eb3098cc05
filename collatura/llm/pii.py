"""PII: keyed pseudonyms that keep the format and the validity of what they replace."""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame

from collatura.llm.common import names_beside, slices

KINDS = ("email", "phone", "card", "iban", "ssn", "ipv4", "ipv6", "date")
ROUNDS = 10


def permute(x: int, n: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of 0..n-1: a Feistel network over the two digits of a number to base about sqrt(n).

    Results of n or more are permuted again until one falls below n, which
    keeps it a permutation.  ``back`` inverts it.
    """
    if n < 2:
        return x
    v = math.isqrt(n - 1) + 1
    u = -(-n // v)
    size = max(16, (max(u, v).bit_length() + 7) // 8 + 8)

    def f(turn: int, half: int) -> int:
        data = turn.to_bytes(1, "big") + half.to_bytes((half.bit_length() + 7) // 8 or 1, "big")
        out = b"".join(hashlib.blake2b(data + k.to_bytes(2, "big"), key=key, person=tweak[:16], digest_size=64).digest() for k in range(-(-size // 64)))
        return int.from_bytes(out[:size], "big")

    while True:
        a, b = divmod(x, v)
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if turn % 2:
                b = (b + sign * f(turn, a)) % v
            else:
                a = (a + sign * f(turn, b)) % u
        x = a * v + b
        if x < n:
            return x


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _like(text: str, digits: str) -> str:
    """``text`` with its digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _classes(text: str, key: bytes, tweak: bytes, back: bool) -> str:
    """Letters and digits permuted together, each staying in its class; other characters stay."""
    bases = [(ord("0"), 10) if "0" <= c <= "9" else (ord("a"), 26) if "a" <= c <= "z" else (ord("A"), 26) if "A" <= c <= "Z" else (0, 1) for c in text]
    x, n = 0, 1
    for c, (low, base) in zip(text, bases, strict=True):
        if base > 1:
            x, n = x * base + ord(c) - low, n * base
    x = permute(x, n, key, tweak + bytes(str(len(text)), "ascii"), back)
    out = []
    for c, (low, base) in reversed(list(zip(text, bases, strict=True))):
        if base > 1:
            x, d = divmod(x, base)
            c = chr(low + d)
        out.append(c)
    return "".join(reversed(out))


def email(text: str, key: bytes, back: bool) -> str | None:
    """The part before the sign, and the domain but for its last label, so that domains stay linked too."""
    local, at, domain = text.rpartition("@")
    own, dot, top = domain.rpartition(".")
    return _classes(local, key, b"email", back) + at + _classes(own, key, b"domain", back) + dot + top


def phone(text: str, key: bytes, back: bool) -> str | None:
    """The country's code, or the zero that stands for it, stays: the digits up to the first separator after a plus, or two."""
    digits = _digits(text)
    if text[0] == "+":
        first = re.match(r"\+([0-9]+)", text)[1]
        code = first if len(first) <= 3 else first[:2]
    else:
        code = "0" if digits[0] == "0" and len(digits) != 10 or _FRENCH.fullmatch(text) else ""
    own = digits[len(code) :]
    if not 7 <= len(own) <= 14 or len(digits) > 15:
        return None
    return _like(text, code + f"{permute(int(own), 10 ** len(own), key, b'phone%d' % len(own), back):0{len(own)}d}")


_FRENCH = re.compile(r"0[0-9](?:[ .\-][0-9]{2}){4}")


def card(text: str, key: bytes, back: bool) -> str | None:
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]):
        return None
    own = f"{permute(int(digits[:-1]), 10 ** (len(digits) - 1), key, b'card%d' % len(digits), back):0{len(digits) - 1}d}"
    return _like(text, own + str(luhn(own)))


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban(text: str, key: bytes, back: bool) -> str | None:
    plain = text.replace(" ", "")
    land, own = plain[:2], plain[4:]
    if not 15 <= len(plain) <= 34 or _mod97(own + plain[:4]) != 1 or not 2 <= int(plain[2:4]) <= 98:
        return None
    own = _classes(own, key, b"iban" + land.encode(), back)
    made = iter(f"{land}{98 - _mod97(own + land + '00'):02d}{own}")
    return "".join(c if c == " " else next(made) for c in text)


def ssn(text: str, key: bytes, back: bool) -> str | None:
    """Area 001-899 without 666, group 01-99, serial 0001-9999."""
    area, group, serial = map(int, text.split("-"))
    if not 0 < area < 900 or area == 666 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(permute(x, 898 * 99 * 9999, key, b"ssn", back), 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def ipv4(text: str, key: bytes, back: bool) -> str | None:
    parts = list(map(int, text.split(".")))
    if max(parts) > 255 or any(str(p) != s for p, s in zip(parts, text.split("."), strict=True)):
        return None
    x = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, b"ipv4", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def ipv6(text: str, key: bytes, back: bool) -> str | None:
    """Written in its short form, whichever one it came in, so all spellings of an address stay linked."""
    try:
        address = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    if len(re.sub("[^0-9a-fA-F]", "", text)) < 3:
        return None
    return str(ipaddress.IPv6Address(permute(int(address), 1 << 128, key, b"ipv6", back)))


_FIRST, _LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


def _date(y: str, m: str, d: str) -> date | None:
    try:
        made = date(int(y), int(m), int(d))
    except ValueError:
        return None
    return made if _FIRST <= made.toordinal() <= _LAST else None


#: Names of the months (fixed values): English, German, French, Spanish.
MONTHS = {
    "en": ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"),
    "de": ("januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"),
    "fr": ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    "es": ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
}
_MONTH = "|".join(sorted({m for names in MONTHS.values() for m in names}, key=len, reverse=True))
_WRITTEN = re.compile(rf"(?P<d>[0-9]{{1,2}})(?P<x>\.? |\.?er | de )(?P<m>(?i:{_MONTH}))(?P<z> | de |, )(?P<y>[0-9]{{4}})|(?P<m2>(?i:{_MONTH}))(?P<x2> )(?P<d2>[0-9]{{1,2}})(?P<z2>,? )(?P<y2>[0-9]{{4}})")


def _walk(found: date, key: bytes, tweak: bytes, back: bool, fits: Callable[[date], bool]) -> date:
    """The permuted day; permuted again until it is one that can be written as the first was."""
    x = found.toordinal()
    while True:
        x = _FIRST + permute(x - _FIRST, _LAST - _FIRST + 1, key, tweak, back)
        if fits(made := date.fromordinal(x)):
            return made


def _written(text: str, key: bytes, back: bool) -> str | None:
    """A day with its month's name: language, order, capitals and number of digits stay.

    A name that several languages share counts as the first one's that fits the
    words around it.
    """
    m = _WRITTEN.fullmatch(text)
    if m is None:
        return None
    late = m["m"] is None
    d, name, y, before, after = (m[k + "2" * late] for k in ("d", "m", "y", "x", "z"))
    tongues = [t for t, names in MONTHS.items() if name.lower() in names]
    tongue = next((t for t in tongues if (t == "es") == (" de " in (before, after)) and (t == "de") == before.startswith(".")), tongues[0])
    names = MONTHS[tongue]
    if (found := _date(y, str(names.index(name.lower()) + 1), d)) is None:
        return None
    wide = len(d) == 2 and d[0] == "0"
    short = lambda x: f"{x:02d}" if wide else str(x)
    shared = [k for k, n in enumerate(names) if next((t for t in (t for t, all_ in MONTHS.items() if n in all_) if (t == "es") == (" de " in (before, after)) and (t == "de") == before.startswith(".")), next(t for t, all_ in MONTHS.items() if n in all_)) == tongue]
    fits = lambda x: (x.day < 10 if wide else len(str(x.day)) == len(d)) and x.month - 1 in shared
    made = _walk(found, key, b"written" + tongue.encode(), back, fits)
    month = names[made.month - 1]
    month = month.upper() if name.isupper() else month.capitalize() if name[0].isupper() else month
    return f"{month}{before}{short(made.day)}{after}{made.year:04d}" if late else f"{short(made.day)}{before}{month}{after}{made.year:04d}"


def day(text: str, key: bytes, back: bool) -> str | None:
    """Years first, days first, or (where a days-first reading is no date) months first; from 1900 to 2099.

    Where a day or month has one digit, numbers are written without zeros and
    keep their numbers of digits.
    """
    if any(c.isalpha() for c in text):
        return _written(text, key, back)
    sep = "-" if "-" in text else "/" if "/" in text else "."
    a, b, c = text.split(sep)
    orders = ("ymd",) if len(a) == 4 else ("dmy", "mdy")
    for order in orders:
        part = dict(zip(order, (a, b, c), strict=True))
        if (found := _date(part["y"], part["m"], part["d"])) is None:
            continue
        bare = 1 in (len(part["m"]), len(part["d"]))
        if bare and "0" in (part["m"][0], part["d"][0]):
            return None
        # Months first stays among dates that no days-first reading has.
        fits = lambda x: (order != "mdy" or x.day > 12) and (not bare or (len(str(x.month)), len(str(x.day))) == (len(part["m"]), len(part["d"])))  # noqa: B023, E731
        made = _walk(found, key, b"date" + order.encode(), back, fits)
        texts = {"y": f"{made.year:04d}", "m": str(made.month) if bare else f"{made.month:02d}", "d": str(made.day) if bare else f"{made.day:02d}"}
        return sep.join(texts[k] for k in order)
    return None


_RULES: dict[str, tuple[str, Callable[[str, bytes, bool], str | None]]] = {
    "email": (r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![A-Za-z0-9])", email),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    "ipv6": (r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:]|\.[0-9])", ipv6),
    "phone": (
        r"(?<![0-9A-Za-z])(?:(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}"
        r"|\+[1-9][0-9]{0,2}(?:[ .\-/]?\(?[0-9]{1,6}\)?){2,6}|\+[1-9][0-9]{8,14}|0[0-9](?:[ .\-][0-9]{2}){4})(?![0-9A-Za-z])",
        phone,
    ),
    "ssn": (r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])", ssn),
    "date": (r"(?<![0-9A-Za-z\-/.])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}([\-/.])[0-9]{1,2}\1[0-9]{4}|" + _WRITTEN.pattern.replace("?P<", "?P<w_") + r")(?![0-9A-Za-z\-/]|\.[0-9])", day),
    "ipv4": (r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])", ipv4),
    "card": (r"(?<![0-9A-Za-z])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z])", card),
}
_ONE = re.compile("|".join(f"(?P<{k}>{p.replace(chr(92) + '1', '(?P=sep)').replace('([' + chr(92) + '-/.])', '(?P<sep>[' + chr(92) + '-/.])')})" for k, (p, _) in _RULES.items()))
_MAY = re.compile("[0-9@]")


class Pseudonyms:
    """Replaces personal data in texts; equal values get equal pseudonyms under one key."""

    def __init__(self, key: bytes, remember: int = 100_000):
        self.key, self.remember = hashlib.blake2b(key, digest_size=32).digest(), remember
        self.known: dict[tuple[str, str], str | None] = {}

    def value(self, kind: str, text: str, back: bool = False) -> str | None:
        """The pseudonym of a value, or None if it isn't valid for its kind."""
        if back:
            return _RULES[kind][1](text, self.key, True)
        if (kind, text) not in self.known:
            if len(self.known) >= self.remember:
                self.known.clear()
            self.known[kind, text] = _RULES[kind][1](text, self.key, False)
        return self.known[kind, text]

    def text(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and how many values of each kind were replaced."""
        counts = dict.fromkeys(KINDS, 0)
        if not _MAY.search(text):
            return text, counts

        def one(m: re.Match) -> str:
            kind = next(k for k in KINDS if m[k] is not None)
            made = self.value(kind, m[0])
            if made is None:
                return m[0]
            counts[kind] += 1
            return made

        return _ONE.sub(one, text), counts


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, n_email, ..., n_date) of each row of ``docs`` with its personal data replaced.

    Card numbers are valid by Luhn's check, IBANs by theirs, addresses by
    range, dates by the calendar; what isn't valid stays.  A value is permuted
    within the values of its format under ``key``, so equal values stay equal
    in all documents, different ones different, and results are valid too.  A
    null text stays null, with counts of 0.  Repeated rows each give a row; an
    empty table gives none.
    """
    counts = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key)
        for batch in slices(batches):
            texts, found = [], []
            for text in batch.column(1).to_pylist():
                made, n = own.text(text or "")
                texts.append(made if text is not None else None)
                found.append([n[k] for k in KINDS])
            columns = list(zip(*found, strict=True)) or [()] * len(KINDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "text", *counts])

    return names_beside(docs, "doc_id", "text").mapInArrow(run, "doc_id long, text string, " + ", ".join(f"{c} long" for c in counts))
