"""PII: format-preserving pseudonyms by a keyed Feistel network.

A value is validated first (check digits, ranges, calendar), then permuted within its format under the key, so
equal values have equal pseudonyms in all documents and different values different ones. Positions keep
their class: a digit stays a digit, a letter a letter of its case. Where a format has invalid members the
permutation is walked on until a valid one comes, and members that are told apart (numbers that a country's plan allows and
others) stay on their side, so two sides never meet; check digits are computed anew. A single position is permuted by a
keyed order of its values. Dates are permuted as days of their century, one permutation for all spellings, in which days
above 12 stay above 12: a numeric date with the month first stays readable as one.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

ROUNDS = 8
_VALUE = "array<struct<kind: string, first: int, end: int, pseudonym: string>>"
_VALUE_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())]))
MONTHS = "january february march april may june july august september october november december".split()

#: Country calling codes of one and two digits; all others have three. Fixed values.
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_MONTH = "(?:" + "|".join(f"{m.capitalize()}|{m[:3].capitalize()}[.]?" for m in MONTHS) + ")"
_TH = "(?:st|nd|rd|th)?"
_KINDS = {
    "iban": r"[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?",
    "date": r"\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4}"
    rf"|\d{{1,2}}{_TH}[ ]{_MONTH}[ ]\d{{4}}|{_MONTH}[ ]\d{{1,2}}{_TH},[ ]\d{{4}}",
    "ip6": r"(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:",
    "ip": r"\d{1,3}(?:\.\d{1,3}){3}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone": r"\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}|(?:\(\d{3}\)[ ]?|\d{3}[.\-])\d{3}[.\-]\d{4}",
    "card": r"\d(?:[ \-]?\d){12,18}",
}
_BEFORE, _AFTER = r"(?<![\w@])(?<![\w][.\-/])", r"(?![\w@])(?![.\-/]\d)"
_NUMBERS = _BEFORE + "(?:" + "|".join(f"(?P<{k}>{v})" for k, v in _KINDS.items()) + ")" + _AFTER
_EMAIL = r"(?<![\w.+%\-])(?P<email>[A-Za-z0-9_][A-Za-z0-9._%+\-]*)@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}(?![\w])"
_PLAIN, _BOTH = re.compile(_NUMBERS), re.compile(rf"(?:{_EMAIL})|(?:{_NUMBERS})")
_START, _END = re.compile(_BEFORE + r"[\w+(]"), re.compile(_AFTER)
#: Within a failed match a card counts only as cards are grouped; of the parts of a row of small numbers some always pass Luhn.
_PARTS = {k: re.compile(v) for k, v in _KINDS.items()} | {"card": re.compile(r"\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1(?:\d{1,7}|\d{4}\1\d{1,3})|\d{4}([ \-])\d{6}\2\d{4,5}|\d{6}[ \-]\d{13}")}
_LONGEST = 50  # characters of the longest value: a phone or an IBAN with its spaces
_DIGIT = re.compile(r"\d")


def feistel(values: list[int], sizes: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of mixed-radix numbers: position k is below sizes[k]."""
    if len(values) == 1:  # nothing to mix it with: the order of the values' keyed hashes
        return [sorted(range(sizes[0]), key=lambda v: hashlib.blake2b(f"{tweak}|one|{v}".encode(), key=key[:64]).digest())[values[0]]]
    out, half = list(values), (len(values) + 1) // 2
    for r in range(ROUNDS):
        mine, other = (range(half), range(half, len(out))) if r % 2 else (range(half, len(out)), range(half))
        seed = f"{tweak}|{r}|" + ",".join(str(out[k]) for k in other) + f"|{len(out)}"
        stream, block = b"", 0
        while len(stream) < 8 * len(mine):
            stream += hashlib.blake2b(f"{seed}|{block}".encode(), key=key[:64]).digest()
            block += 1
        for n, k in enumerate(mine):
            out[k] = (out[k] + int.from_bytes(stream[8 * n : 8 * n + 8], "little")) % sizes[k]
    return out


def walk(values: list[int], sizes: list[int], key: bytes, tweak: str, valid: Callable[[list[int]], bool]) -> list[int]:
    """The permutation within the valid values: applied until it gives one."""
    out = feistel(values, sizes, key, tweak)
    while not valid(out):
        out = feistel(out, sizes, key, tweak)
    return out


def _letters(text: str, key: bytes, tweak: str, keep: Callable[[int], bool] = lambda k: False, valid: Callable[[str], bool] = lambda t: True) -> str:
    """Permute the ASCII letters and digits of text, each within its class, but for the places that keep names."""
    classes = {c: ("0", 10) if c.isdigit() else ("a", 26) if c.islower() else ("A", 26) for c in set(text) if c.isascii() and c.isalnum()}
    places = [k for k, c in enumerate(text) if c in classes and not keep(k)]

    def put(values: list[int]) -> str:
        out = list(text)
        for k, v in zip(places, values):
            out[k] = chr(ord(classes[text[k]][0]) + v)
        return "".join(out)

    values = [ord(text[k]) - ord(classes[text[k]][0]) for k in places]
    sizes = [classes[text[k]][1] for k in places]
    shape = "".join(classes[c][0] if c in classes else c for c in text)
    return put(walk(values, sizes, key, f"{tweak}|{shape}", lambda v: valid(put(v)))) if places else text


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _fill(text: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def luhn(digits: str) -> bool:
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _card(text: str, key: bytes) -> str | None:
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or len(set(digits)) == 1 or not luhn(digits):
        return None
    whole = lambda b: b + next(c for c in "0123456789" if luhn(b + c))
    # the first digit names the kind of card; a row of one digit is no card
    body = _letters(digits[:-1], key, "card", lambda k: k == 0, lambda b: len(set(whole(b))) > 1)
    return _fill(text, whole(body))


def _ssn_valid(t: str) -> bool:
    return t[:3] not in ("000", "666") and t[0] != "9" and t[4:6] != "00" and t[7:] != "0000"


def _ssn(text: str, key: bytes) -> str | None:
    return _letters(text, key, "ssn", valid=_ssn_valid) if _ssn_valid(text) else None


def _phone(text: str, key: bytes) -> str | None:
    """A number of ten digits without a country is one of country 1, with or without its code."""
    digits = _digits(text)
    if not 7 <= len(digits) <= 15:
        return None
    code = "" if text[0] != "+" else next((digits[:n] for n in (1, 2) if digits[:n] in SHORT_CODES), digits[:3])
    own = digits[len(code) :]
    if len(set(own)) == 1:
        return None
    if len(own) == 10 and code in ("", "1"):
        country, fits = "1", lambda d: d[0] >= "2" and d[3] >= "2"
    else:
        country, fits = code, lambda d: d[0] != "0"
    side = fits(own)
    return _fill(text, code + _letters(own, key, f"phone{country}", valid=lambda d: fits(d) == side and len(set(d)) > 1))


def _ip6(text: str, key: bytes) -> str | None:
    """Whole addresses, and shortened ones with three groups and a digit; written as the standard library does."""
    try:
        number = int(ipaddress.IPv6Address(text))
    except ValueError:
        return None
    if "::" in text and (sum(map(bool, text.split(":"))) < 3 or not _DIGIT.search(text)):
        return None
    groups = [number >> 16 * k & 0xFFFF for k in range(8)]

    def said(values: list[int]) -> str:
        return ipaddress.IPv6Address(sum(v << 16 * k for k, v in enumerate(values))).compressed

    # what would not be found again (a few groups, no digit) is no pseudonym
    readable = lambda v: "::" not in said(v) or sum(map(bool, said(v).split(":"))) >= 3 and _DIGIT.search(said(v)) is not None
    if not readable(groups):
        return None
    new = walk(groups, [1 << 16] * 8, key, "ip6", readable)
    out = said(new) if len(text) < 39 else ipaddress.IPv6Address(sum(v << 16 * k for k, v in enumerate(new))).exploded
    return out.upper() if re.search("[A-F]", text) else out


def _ip(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts) or text in ("0.0.0.0", "255.255.255.255", "127.0.0.1"):
        return None
    used = lambda v: v not in ([0] * 4, [255] * 4, [127, 0, 0, 1])
    return ".".join(map(str, walk([int(p) for p in parts], [256] * 4, key, "ip", used)))


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4]))


def _iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_number(plain) % 97 != 1:
        return None
    body = _letters(plain[4:], key, f"iban{plain[:2]}")
    check = 98 - _iban_number(f"{plain[:2]}00{body}") % 97
    it = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(it) for c in text)


def _date(text: str, key: bytes) -> str | None:
    """Day before month where both are numbers, unless only the other order is valid; a year of four digits."""
    named = re.search(r"[A-Z][a-z]+", text)
    numbers = [int(n) for n in re.findall(r"\d+", text)]
    if named:
        order = "dmy" if text[0].isdigit() else "mdy"
        parts = {"m": next(k for k, m in enumerate(MONTHS, 1) if m.startswith(named[0].lower())), "d": numbers[0], "y": numbers[1]}
    else:
        order = "ymd" if re.match(r"\d{4}", text) else "dmy"
        parts = dict(zip(order, numbers))
        if parts["m"] > 12 and order == "dmy":
            order, parts = "mdy", {"m": parts["d"], "d": parts["m"], "y": parts["y"]}
    try:
        day = datetime.date(parts["y"], parts["m"], parts["d"])
    except ValueError:
        return None
    first = datetime.date(max(1, day.year // 100 * 100), 1, 1).toordinal()
    end = datetime.date(day.year // 100 * 100 + 99, 12, 31).toordinal()
    number = lambda v: first + v[0] * 200 + v[1]
    late = day.day > 12
    fits = lambda v: number(v) <= end and (datetime.date.fromordinal(number(v)).day > 12) == late
    moved = datetime.date.fromordinal(number(walk(list(divmod(day.toordinal() - first, 200)), [200, 200], key, f"date{day.year // 100}", fits)))
    if named:
        name = MONTHS[moved.month - 1].capitalize()
        if len(named[0]) == 3 and (parts["m"] != 5 or "." in text):  # May is both
            name = name[:3] + ("." if "." in text else "")
        th = {1: "st", 2: "nd", 3: "rd"}.get(moved.day % 10 if moved.day // 10 != 1 else 0, "th") if re.search(r"\d(?:st|nd|rd|th)", text) else ""
        return f"{moved.day}{th} {name} {moved.year:04d}" if order == "dmy" else f"{name} {moved.day}{th}, {moved.year:04d}"
    new = {"d": moved.day, "m": moved.month, "y": moved.year}
    widths = [len(n) for n in re.findall(r"\d+", text)]
    padded = all(w == 2 for c, w in zip(order, widths) if c != "y")
    it = iter(f"{new[c]:0{4 if c == 'y' else 2 if padded else 1}d}" for c in order)
    return re.sub(r"\d+", lambda _: next(it), text)


def _email(local: str, key: bytes) -> str:
    return _letters(local, key, "email")


KINDS: dict[str, Callable[[str, bytes], str | None]] = {"email": _email, "iban": _iban, "date": _date, "ip6": _ip6, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


def _within(text: str, begin: int, stop: int, key: bytes) -> list[tuple[int, int, str, str]]:
    """The valid values that start within a match that failed as a whole: the longest first, none over another."""
    found = []
    for first in range(begin, stop):
        if not _START.match(text, first):
            continue
        for end in range(first + 7, min(len(text), first + _LONGEST) + 1):
            if _END.match(text, end):
                for kind, part in _PARTS.items():
                    if part.fullmatch(text, first, end) and (new := KINDS[kind](text[first:end], key)) is not None:
                        found.append((first, end, kind, new))
    out: list[tuple[int, int, str, str]] = []
    for f in sorted(found, key=lambda f: (f[0] - f[1], f[0])):
        if all(f[1] <= o[0] or o[1] <= f[0] for o in out):
            out.append(f)
    return sorted(out)


def pseudonymized(text: str, key: bytes) -> tuple[str, list[dict]]:
    """The text with pseudonyms, and each value's kind, place in the result, and pseudonym."""
    if "@" not in text and not _DIGIT.search(text):
        return text, []
    out, values, done, length, at = [], [], 0, 0, 0
    pattern = _BOTH if "@" in text else _PLAIN
    while m := pattern.search(text, at):
        kind = m.lastgroup
        new = KINDS[kind](m[kind], key)
        found = _within(text, m.start(), m.end(), key) if new is None else [(m.start(kind), m.end(kind), kind, new)]
        for first, end, kind, new in found:
            out.append(text[done:first])
            length += len(out[-1])
            values.append({"kind": kind, "first": length, "end": length + len(new), "pseudonym": new})
            out.append(new)
            length += len(new)
            done = end
        at = max(m.end(), done)
    return "".join([*out, text[done:]]), values


def _permute(key: bytes, carry: int):
    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                rows = [(None, []) if t is None else pseudonymized(t, key) for t in b.column(carry).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:carry], pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], _VALUE_ARROW)], names=[*b.schema.names[:carry], "text", "values"])

    return permute


def pseudonymize(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, text with pseudonyms, values (kind, first, end, pseudonym; places are
    characters of the new text).

    Kinds: cards (13 to 19 digits, Luhn), phones (7 to 15 digits written as a phone), IPv4 and IPv6 addresses, social
    security numbers (valid ranges), IBANs (mod 97), dates (a real day of the years 1 to 9999, the year in four digits, months as
    numbers, names or three letters), and the local parts of e-mail addresses. What fails its validation stays as it is, but the valid values within it (cards there only in their usual
    groups) do not. A null text stays null without values; an empty one empty.
    Null and repeated ids pass through; an empty table gives no rows. Rows never meet: no shuffle.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    return own.mapInArrow(_permute(key, 1), f"doc_id long, text string, values {_VALUE}")
