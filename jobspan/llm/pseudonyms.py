"""Personal data: format-preserving pseudonyms by a keyed Feistel network.

Values are found by their form and validated (check digits, calendars, octets, number ranges), then permuted within their
format: a card number becomes another number with a right check digit and the same separators, a date another date written
alike. The permutation depends on the key and the kind alone, so equal values have equal pseudonyms in all documents and
different values different ones, and who holds the key can undo it.
"""
from __future__ import annotations

import datetime as dt
import hashlib
import bisect
import re
from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobspan.llm.common import portions

ROUNDS = 10


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. size-1: a balanced Feistel network on the next even number of bits, walked along its cycle
    until it falls into the range again."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8

    def mix(r: int, x: int) -> int:
        seed = b"%s|%d|%d|" % (tweak.encode(), size, r) + x.to_bytes(width, "big")
        return int.from_bytes(hashlib.shake_128(key + b"|" + seed).digest(width), "big") & mask

    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            left, right = (right ^ mix(r, left), left) if back else (right, left ^ mix(r, right))
        value = left << half | right
        if value < size:
            return value


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _as_number(text: str, alphabets: list[str]) -> tuple[int, int]:
    value, size = 0, 1
    for c, a in zip(text, alphabets, strict=True):
        value, size = value * len(a) + a.index(c), size * len(a)
    return value, size


def _as_text(value: int, alphabets: list[str]) -> str:
    out = []
    for a in reversed(alphabets):
        value, k = divmod(value, len(a))
        out.append(a[k])
    return "".join(reversed(out))


def _permuted(text: str, alphabets: list[str], key: bytes, kind: str, back: bool) -> str:
    value, size = _as_number(text, alphabets)
    return _as_text(permute(value, size, key, kind, back), alphabets)


def _refill(text: str, new: str, chosen: Callable[[str], bool]) -> str:
    """The chosen characters of the text replaced in their order."""
    rest = iter(new)
    return "".join(next(rest) if chosen(c) else c for c in text)


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_digit(c: str) -> bool:
    return "0" <= c <= "9"


def luhn_digit(payload: str) -> str:
    total = sum(sum(divmod(int(c) * (2 - k % 2), 10)) for k, c in enumerate(reversed(payload)))
    return str(-total % 10)


def is_card(text: str) -> bool:
    d = digits_of(text)
    return 13 <= len(d) <= 19 and len(set(d)) > 1 and luhn_digit(d[:-1]) == d[-1]


def card(text: str, key: bytes, back: bool = False) -> str:
    d = digits_of(text)
    new = _permuted(d[:-1], [_ALPHABETS[0]] * (len(d) - 1), key, "card", back)
    return _refill(text, new + luhn_digit(new), _is_digit)


def digits(text: str, key: bytes, kind: str, keep: int = 0, back: bool = False) -> str:
    """All digits but the first ``keep`` permuted."""
    d = digits_of(text)
    return _refill(text, d[:keep] + _permuted(d[keep:], [_ALPHABETS[0]] * (len(d) - keep), key, f"{kind}{d[:keep]}", back), _is_digit)


def is_phone(text: str) -> bool:
    return 8 <= len(digits_of(text)) <= 15


def phone(text: str, key: bytes, back: bool = False) -> str:
    """The country code, digits up to the first other character behind a plus, stays."""
    code = re.match(r"\+(\d{1,3})(?=\D)", text)
    return digits(text, key, "phone", len(code[1]) if code else 0, back)


def is_ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def ssn(text: str, key: bytes, back: bool = False) -> str:
    area, group, serial = map(int, text.split("-"))
    index = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    index, serial = divmod(permute(index, 898 * 99 * 9999, key, "ssn", back), 9999)
    area, group = divmod(index, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def is_ip(text: str) -> bool:
    return all(int(x) <= 255 for x in text.split("."))


def ip(text: str, key: bytes, back: bool = False) -> str:
    value = int.from_bytes(bytes(map(int, text.split("."))), "big")
    return ".".join(map(str, permute(value, 1 << 32, key, "ip", back).to_bytes(4, "big")))


_FIRST, _DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()


def _date_parts(text: str) -> tuple[str, tuple[int, int, int]] | None:
    """(order of the parts, year month day) of a calendar date from 1900 to 2099: year first, or day first, or month first where
    only that is a date."""
    a, b, c = (int(x) for x in re.split(r"[-/.]", text))
    forms = [("ymd", (a, b, c))] if a > 999 else [("dmy", (c, b, a)), ("mdy", (c, a, b))]
    for form, (y, m, d) in forms:
        try:
            if 1900 <= dt.date(y, m, d).year <= 2099:
                return form, (y, m, d)
        except ValueError:
            pass
    return None


def is_date(text: str) -> bool:
    return _date_parts(text) is not None


def date(text: str, key: bytes, back: bool = False) -> str:
    """Day-first dates are permuted among dates whose text is read day first, month-first ones among the others."""
    form, ymd = _date_parts(text)
    at = dt.date(*ymd).toordinal() - _FIRST
    while True:
        at = permute(at, _DAYS, key, f"date{form}", back)
        day = dt.date.fromordinal(_FIRST + at)
        if form != "mdy" or day.day > 12:  # else it would read as day first
            break
    parts = {"y": f"{day.year:04d}", "m": f"{day.month:02d}", "d": f"{day.day:02d}"}
    marks = re.findall(r"[-/.]", text)
    return parts[form[0]] + marks[0] + parts[form[1]] + marks[1] + parts[form[2]]


def iban_check(country: str, body: str) -> str:
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(number) % 97:02d}"


def is_iban(text: str) -> bool:
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and iban_check(t[:2], t[4:]) == t[2:4]


def iban(text: str, key: bytes, back: bool = False) -> str:
    t = text.replace(" ", "")
    body = _permuted(t[4:], [_ALPHABETS[0] if _is_digit(c) else _ALPHABETS[2] for c in t[4:]], key, "iban" + t[:2], back)
    return _refill(text, t[:2] + iban_check(t[:2], body) + body, lambda c: c != " ")


def _classes(text: str) -> list[str]:
    return [next(a for a in _ALPHABETS if c in a) for c in text]


def _plain(c: str) -> bool:
    return c.isascii() and c.isalnum()


def email(text: str, key: bytes, back: bool = False) -> str:
    """All letters and digits before the last label, each within its class; case is no part of the value."""
    head, _, last = text.rpartition(".")
    inner = "".join(c for c in head.lower() if _plain(c))
    new = iter(_permuted(inner, _classes(inner), key, "email", back))
    swapped = "".join(next(new) if _plain(c) else c for c in head)
    return "".join(n.upper() if c.isupper() else n for c, n in zip(head, swapped, strict=True)) + "." + last


def secret(text: str, key: bytes, back: bool = False) -> str:
    """Keys and tokens: characters within their class; hexadecimal ones stay hexadecimal."""
    inner = "".join(c for c in text if _plain(c))
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", inner):
        alphabets = ["0123456789abcdef" if inner.lower() == inner else "0123456789ABCDEF"] * len(inner)
    else:
        alphabets = _classes(inner)
    return _refill(text, _permuted(inner, alphabets, key, "secret", back), _plain)


_GROUPS = r"(?:[ .-]?\(?\d{2,4}\)?){2,5}"
# kind, pattern, validation, permutation: tried in this order where they begin at one place, the longest first.
DETECTORS: list[tuple[str, str, Callable[[str], bool], Callable[..., str]]] = [
    ("email", r"[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-]@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", lambda t: True, email),
    ("secret", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", lambda t: True,
     lambda t, key, back=False: t[:4] + secret(t[4:], key, back)),
    ("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])", lambda t: not t.isdigit(), secret),
    ("secret", r"(?<![A-Za-z0-9])(?:sk|pk|gh[pousr]|xox[abprs])[-_][A-Za-z0-9_-]{20,}", lambda t: True,
     lambda t, key, back=False: (m := re.match(r"[a-z]+[-_]", t))[0] + secret(t[m.end():], key, back)),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", is_iban, iban),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", is_ip, ip),
    ("date", r"(?<![\d./-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?![\d]|[./-]\d)", is_date, date),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", is_ssn, ssn),
    ("phone", r"(?<![\d+])\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d+])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)|"
     r"(?<![\d+])\+\d{1,3}" + _GROUPS + r"(?!\d)", is_phone, phone),
    ("card", r"(?<![\d.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![\d-])", is_card, card),
]
_COMPILED = [(kind, re.compile(pattern), valid, new) for kind, pattern, valid, new in DETECTORS]
_DOMAIN = re.compile(r"@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HINT = re.compile(r"[0-9@]|sk[-_]|pk[-_]|gh[pousr]_|xox[abprs]-|A[KS]IA")


def _emails(text: str):
    """Start and end of what the pattern of addresses finds, read to the left from each ``@``: linear in the text."""
    last = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and text[m.start() - 1] != ".":
            last = m.end()
            yield start, last


def find(text: str) -> list[tuple[int, int, str, Callable]]:
    """(start, end, kind, permutation) of the validated values; of overlapping ones the first in DETECTORS' order."""
    if not _HINT.search(text):
        return []
    found: list[tuple[int, int, str, Callable]] = []  # sorted; none overlaps another, so neighbours alone are compared
    for kind, pattern, valid, new in _COMPILED:
        for start, end in _emails(text) if kind == "email" else (m.span() for m in pattern.finditer(text)):
            k = bisect.bisect_left(found, start, key=lambda x: x[0])
            if ((k == 0 or found[k - 1][1] <= start) and (k == len(found) or end <= found[k][0])
                    and valid(text[start:end])):
                found.insert(k, (start, end, kind, new))
    return found


def replace(text: str, key: bytes, back: bool = False) -> tuple[str, list[dict]]:
    """The text with pseudonyms, and where they stand in it. ``back`` undoes it."""
    out, spans, at, size = [], [], 0, 0
    for start, end, kind, new in find(text):
        put = new(text[start:end], key, back)
        out += [text[at:start], put]
        size += start - at
        spans.append({"kind": kind, "start": size, "end": size + len(put)})
        size += len(put)
        at = end
    return ("".join(out) + text[at:] if out else text), spans


def pseudonymize(docs: DataFrame, key: str, back: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, n_replaced, spans array<struct<kind, start, end>> in the new text.

    A null text stays null with no spans, an empty one empty. Whole texts of any length; repeated rows are replaced alike, ids
    may be null, other columns are not read. Narrow: nothing is shuffled. With ``back`` and the same key the texts come back.
    """
    if not key:
        raise ValueError("a key is needed")
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        partial(_replace_batches, key=key.encode(), back=back),
        f"doc_id {kind}, text string, n_replaced int, spans array<struct<kind: string, start: int, end: int>>")


def _replace_batches(batches, key: bytes, back: bool):
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        for part in portions(batch, 1):
            rows = [(None, []) if t is None else replace(t, key, back) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([t for t, _ in rows], pa.string()), pa.array([len(s) for _, s in rows], pa.int32()),
                 pa.array([s for _, s in rows], span)], names=["doc_id", "text", "n_replaced", "spans"])
