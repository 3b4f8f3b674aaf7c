"""Personal data replaced by format-preserving pseudonyms from a keyed Feistel network.

Found and validated: e-mail addresses, payment card numbers (13 to 19 digits, Luhn), IBANs (mod 97), IPv4 addresses (each
part at most 255) and IPv6 addresses, telephone numbers (with + and a country code, or North American in a bracketed or
3-3-4 form), US social security numbers (ranges that are issued) and calendar dates of the years 1900 to 2099 (ISO; with
dots, slashes or dashes, day first, or month first where only that is a date; with the month's name in English, German,
French or Spanish); the day must exist. A number that fails its validation is left alone, as is everything else. Out of
scope: names, postal addresses, numbers dialled with 00, dates without a year or with two digits of it.

Each value is permuted within its own format: digits among numbers of as many digits, letters among words of as many
letters, a date among the days of its century, an address among addresses (IPv6 in its shortest form). Separators, case,
country code (the longest known one, whatever follows it) and check digits' validity are kept (check digits are worked out again). Equal values, however they are punctuated, get equal pseudonyms in
every document, since the permutation depends on the key and the format only; no table is shared or shuffled. A Feistel
network of ``ROUNDS`` rounds over two halves permutes a domain of size a * b; cycle walking keeps to smaller domains.
Being a permutation, it may leave a value as it is, with a chance of one in the size of its format.

Where kinds compete for the same characters, the first in ``KINDS`` has them, and within a kind the leftmost match. Null
and empty texts stay as they are and hold nothing. Very long texts are read whole, in time linear to them. Repeated rows get the same result; empty tables give no rows.
Other columns are not read.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import ipaddress
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.common import two_columns, worker_state

ROUNDS = 8
_LOWER = "abcdefghijklmnopqrstuvwxyz"


# ---- permutation ------------------------------------------------------------------------------------------------------
def _feistel(x: int, a: int, b: int, key: bytes, tweak: str) -> int:
    """Permutes 0 .. a * b - 1."""
    left, right = divmod(x, b)
    for i in range(ROUNDS):
        word = f"{tweak}|{i}|{a}|{b}|{right if i % 2 == 0 else left}".encode()
        f = int.from_bytes(hashlib.blake2b(word, key=key, digest_size=16).digest(), "big")
        if i % 2 == 0:
            left = (left + f) % a
        else:
            right = (right + f) % b
    return left * b + right


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1, by cycle walking over a domain of at most four times the size."""
    if size <= 1:
        return x
    a = 1
    while a * a < size:
        a *= 2
    b = -(-size // a)
    x = _feistel(x, a, b, key, tweak)
    while x >= size:
        x = _feistel(x, a, b, key, tweak)
    return x


def _digits(text: str, key: bytes, tweak: str, keep: int = 0) -> str:
    """Permutes the digits of ``text`` after the first ``keep`` of them; everything else stays in place."""
    old = [c for c in text if c.isdigit()]
    body = old[keep:]
    if not body:
        return text
    size = 10 ** len(body)
    new = iter([*old[:keep], *str(permute(int("".join(body)), size, key, f"{tweak}{len(body)}")).zfill(len(body))])
    return "".join(next(new) if c.isdigit() else c for c in text)


def _letters(text: str, key: bytes, tweak: str) -> str:
    """Permutes the ASCII letters of ``text`` (case kept apart from the value) and its digits, each among their kind."""
    word = [c.lower() for c in text if c.isascii() and c.isalpha()]
    if word:
        value = 0
        for c in word:
            value = value * 26 + _LOWER.index(c)
        value = permute(value, 26 ** len(word), key, f"{tweak}a{len(word)}")
        out = []
        for _ in word:
            value, r = divmod(value, 26)
            out.append(_LOWER[r])
        new = iter(reversed(out))
        text = "".join((n.upper() if c.isupper() else n) if c.isascii() and c.isalpha() and (n := next(new)) else c for c in text)
    return _digits(text, key, tweak + "d")


# ---- kinds ------------------------------------------------------------------------------------------------------------
def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _card(m: re.Match, key: bytes) -> str | None:
    digits = "".join(c for c in m[0] if c.isdigit())
    if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
        return None
    body = _digits(digits[:-1], key, f"card{digits[0]}", keep=1)
    new = iter(body + next(c for c in "0123456789" if luhn(body + c)))
    return "".join(next(new) if c.isdigit() else c for c in m[0])


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(m: re.Match, key: bytes) -> str | None:
    plain = m[0].replace(" ", "").upper()
    if not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
        return None
    body = _letters(plain[4:], key, f"iban{plain[:2]}")
    check = 98 - _iban_rest(plain[:2] + "00" + body)
    new = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(new) for c in m[0])


def _ip(m: re.Match, key: bytes) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255:
        return None
    value = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _email(m: re.Match, key: bytes) -> str | None:
    user, _, host = m[0].rpartition("@")
    name, dot, top = host.rpartition(".")
    return f"{_letters(user, key, 'user')}@{_letters(name, key, 'host')}{dot}{top}"


# Country codes of one and two digits; every other one has three. None begins another.
_SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def country_code(digits: str) -> str:
    return next((digits[:n] for n in (1, 2) if digits[:n] in _SHORT_CODES), digits[:3])


def _phone(m: re.Match, key: bytes) -> str | None:
    """The national number is permuted; forms without a country code are North American, so their code is 1.

    A bracketed trunk zero behind the code, ``+49 (0)30``, is no part of the number.
    """
    trunk = m[0].find("(0)") if m[0][0] == "+" else -1
    at = [i for i, c in enumerate(m[0]) if c.isdigit() and i != trunk + 1] if trunk >= 0 else [i for i, c in enumerate(m[0]) if c.isdigit()]
    digits = "".join(m[0][i] for i in at)
    if not 7 <= len(digits) <= 15:
        return None
    code = country_code(digits) if m[0][0] == "+" else ""
    new = iter(code + _digits(digits[len(code) :], key, f"phone{code or 1}-"))
    at = set(at)
    return "".join(next(new) if i in at else c for i, c in enumerate(m[0]))


def _ip6(m: re.Match, key: bytes) -> str | None:
    try:
        value = int(ipaddress.IPv6Address(m[0]))
    except ValueError:
        return None
    if not any(c.isdigit() for c in m[0]) or value < 1 << 32:  # names in code, loopback
        return None
    return str(ipaddress.IPv6Address(permute(value, 1 << 128, key, "ip6")))


def _ssn(m: re.Match, key: bytes) -> str | None:
    area, group, serial = (int(x) for x in m[0].split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    # areas 1..899 without 666: 898 of them
    at = area - 1 - (area > 666)
    value = permute((at * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, "ssn")
    value, serial = divmod(value, 9999)
    at, group = divmod(value, 99)
    return f"{at + 1 + (at + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _other_day(year: int, month: int, day: int, key: bytes) -> datetime.date | None:
    """The pseudonym of a date, a day of its century; None if there is no such day."""
    try:
        at = datetime.date(year, month, day)
    except ValueError:
        return None
    first = datetime.date(year // 100 * 100, 1, 1)
    days = (datetime.date(year // 100 * 100 + 100, 1, 1) - first).days
    return first + datetime.timedelta(permute((at - first).days, days, key, "date"))


def _date(m: re.Match, key: bytes) -> str | None:
    """Day first; month first where only that is a date."""
    if m["y1"] is not None:
        new = _other_day(int(m["y1"]), int(m["m1"]), int(m["d1"]), key)
        return new and f"{new.year:04d}{m['s1']}{new.month:02d}{m['s1']}{new.day:02d}"
    year, one, two, sep = int(m["y2"]), int(m["d2"]), int(m["m2"]), m["s2"]
    if new := _other_day(year, two, one, key):
        return f"{new.day:02d}{sep}{new.month:02d}{sep}{new.year:04d}"
    new = _other_day(year, one, two, key)
    return new and f"{new.month:02d}{sep}{new.day:02d}{sep}{new.year:04d}"


# Names of the months, January to December, in English (also short), German, French and Spanish.
_MONTHS = tuple(tuple(x.split()) for x in (
    "january february march april may june july august september october november december",
    "jan feb mar apr may jun jul aug sep oct nov dec",
    "januar februar märz april mai juni juli august september oktober november dezember",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
))
_MONTH = "|".join(sorted({w for names in _MONTHS for w in names}, key=len, reverse=True))


def _named_date(m: re.Match, key: bytes) -> str | None:
    first = m["n1"] is None  # day, month, year
    name, day, year = (m["n2"], m["d2n"], m["y2n"]) if first else (m["n1"], m["d1n"], m["y1n"])
    german = first and m.string[m.end("d2n")] == "."  # several names are the same in English and German
    names = next(x for x in ((_MONTHS[2], *_MONTHS) if german else _MONTHS) if name.lower() in x)
    new = _other_day(int(year), names.index(name.lower()) + 1, int(day), key)
    if new is None:
        return None
    other = names[new.month - 1]
    other = other.upper() if name.isupper() else other.capitalize() if name[0].isupper() else other
    shown = f"{new.day:02d}" if day[0] == "0" else str(new.day)
    parts = ((m.start("d2n"), day, shown), (m.start("n2"), name, other), (m.start("y2n"), year, f"{new.year:04d}")) if first else ((m.start("n1"), name, other), (m.start("d1n"), day, shown), (m.start("y1n"), year, f"{new.year:04d}"))
    return _cut(m[0], ((s - m.start(), s - m.start() + len(old), text) for s, old, text in parts))


#: (kind, pattern, replacement or None if the match fails validation), the first kind that fits wins.
KINDS: tuple[tuple[str, str, Callable], ...] = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w])", _email),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,3})?(?!\w)", _iban),
    ("date", r"(?<![\w.,/+-])(?:(?P<y1>(?:19|20)\d\d)(?P<s1>[-/.])(?P<m1>\d\d)(?P=s1)(?P<d1>\d\d)|(?P<d2>\d\d)(?P<s2>[-/.])(?P<m2>\d\d)(?P=s2)(?P<y2>(?:19|20)\d\d))(?![\w/-]|[.,]\d)", _date),
    ("date", rf"(?i)(?<![\w.,/-])(?:(?P<n1>{_MONTH})\.? (?P<d1n>\d{{1,2}})(?:st|nd|rd|th)?,? (?P<y1n>(?:19|20)\d\d)|(?P<d2n>\d{{1,2}})(?:\.|st|nd|rd|th)? (?:de |of )?(?P<n2>{_MONTH})\.?(?: de|,)? (?P<y2n>(?:19|20)\d\d))(?![\w/-]|[.,]\d)", _named_date),
    ("ip", r"(?<![\w:.])[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){1,7}(?:::)?(?![\w:]|\.\d)", _ip6),
    ("ip", r"(?<![\w.+])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", _ip),
    ("ssn", r"(?<![\w+-])\d{3}-\d{2}-\d{4}(?![\w-])", _ssn),
    ("card", r"(?<![\w+-])\d(?:[ -]?\d){12,18}(?![\w-])", _card),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(0\)[ .-]?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\+\d{1,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)", _phone),
)
_EACH = [(kind, re.compile(pattern), how) for kind, pattern, how in KINDS]
#: Every kind holds an @ or four digits among at most two separators.
_HINT = re.compile(r"@|\d(?:[^\w\n]{0,2}\d){3}|[A-Z]{2}\d\d|[0-9A-Fa-f]::?[0-9A-Fa-f]")


def pseudonymize(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of every value in the old text."""
    if not _HINT.search(text):
        return text, []
    spans: list[tuple[int, int, str, str]] = []
    rest = text  # what was found is blanked out, so that no later kind reaches into it
    for kind, pattern, how in _EACH:
        found = [(m.start(), m.end(), kind, new) for m in pattern.finditer(rest) if (new := how(m, key)) is not None]
        if found:
            rest = _cut(rest, ((s, e, "\0" * (e - s)) for s, e, _, _ in found))
        spans += found
    spans.sort()
    return _cut(text, ((s, e, new) for s, e, _, new in spans)), [(k, s, e) for s, e, k, _ in spans]


def _cut(text: str, parts: Iterable[tuple[int, int, str]]) -> str:
    """The text with the (start, end) of each part replaced; parts stand in order and apart."""
    out, at = [], 0
    for s, e, new in parts:
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_pii, spans) of every row; text has pseudonyms, spans (kind, start, end) refer to the old text."""
    kind = docs.schema[id_col].dataType.simpleString()
    secret = hmac.new(b"tessella", key.encode(), hashlib.sha256).digest()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("pii")
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            texts, spans = [], []
            for t in batch.column(1).to_pylist():
                new, found = pseudonymize(t, secret) if t else (t, [])
                texts.append(new)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string()), "n_pii": pa.array([len(s) for s in spans], pa.int64()), "spans": pa.array(spans, span)})

    return two_columns(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, text string, n_pii long, spans array<struct<kind:string,start:long,end:long>>")
