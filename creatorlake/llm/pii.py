"""Format-preserving pseudonyms for personal data.

A value found and validated is read as an integer below the number of values of its format, and a keyed Feistel
network permutes that range (walking on until it falls inside), so the same value gets the same pseudonym in every
document, no two values share one, and the result still has the format: as many digits, a valid date, a valid check digit.
"""

from __future__ import annotations

import datetime
import re
import string
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from creatorlake.llm.common import each_text, free, sliced

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

#: Tried at each place in this order, after emails. Digits that other digits, letters or a dash touch are no value of their own.
FORMATS = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])",
    "date": r"(?<![A-Za-z0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![A-Za-z0-9/-]|\.[0-9])",
    "ip": r"(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9]|\.[0-9])",
    "national": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "phone": r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,4}){2,4}|\([0-9]{3}\)[\x20-]?[0-9]{3}[\x20-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![A-Za-z0-9])",
    "account": r"(?<![A-Za-z0-9-])(?:[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{12,19})(?![A-Za-z0-9-])",
}
SCAN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in FORMATS.items()), re.ASCII)
HINT = re.compile(r"[0-9@]")
#: A letter or digit, then any of these, an @, and a host.
NAME_START, NAME = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "._%+-"
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
#: Longer values are permuted in pieces of so many characters.
PIECE = 1024


def permuted(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size)."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    salt = blake2b(f"{tweak}:{size}".encode(), digest_size=16).digest()
    while size > 1:
        a, b = x >> half, x & mask
        for r in range(ROUNDS):
            f = b""
            while len(f) < width:
                f += blake2b(b.to_bytes(width, "big") + len(f).to_bytes(4, "big"), key=key, person=r.to_bytes(16, "big"), salt=salt).digest()
            a, b = b, a ^ (int.from_bytes(f[:width], "big") & mask)
        x = a << half | b
        if x < size:
            return x
    return x


def luhn(digits: str) -> int:
    """The check digit that belongs behind digits."""
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(digits)))
    return -total % 10


def _digits(value: str, key: bytes, tweak: str, keep: int = 0) -> str:
    """value with its digits permuted, but for the first `keep`; all else stays."""
    own = [c for c in value if c.isdigit()]
    rest = "".join(own[keep:])
    new = iter(own[:keep] + list(str(permuted(int(rest), 10 ** len(rest), key, tweak)).zfill(len(rest)))) if rest else iter(own)
    return "".join(next(new) if c.isdigit() else c for c in value)


def _letters(value: str, key: bytes, tweak: str) -> str:
    """value with each digit, small and capital letter replaced by one of its kind, all together as one number (of each piece)."""
    if len(value) > PIECE:
        return "".join(_letters(value[i : i + PIECE], key, f"{tweak}{i}:") for i in range(0, len(value), PIECE))
    sizes = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in value]
    bases = ["0" if c.isdigit() else "a" if c.islower() else "A" for c in value]
    x, size = 0, 1
    for c, n, b in zip(value, sizes, bases, strict=True):
        x, size = x * n + (ord(c) - ord(b) if n > 1 else 0), size * n
    x, out = permuted(x, size, key, tweak + "".join(f"{n}{b}" for n, b in zip(sizes, bases, strict=True))), []
    for c, n, b in reversed(list(zip(value, sizes, bases, strict=True))):
        x, d = divmod(x, n)
        out.append(chr(ord(b) + d) if n > 1 else c)
    return "".join(reversed(out))


def _email(value: str, key: bytes) -> str:
    """The name and all of the host but its suffix."""
    name, _, host = value.partition("@")
    host, dot, suffix = host.rpartition(".")
    return f"{_letters(name, key, 'name')}@{_letters(host, key, 'host')}{dot}{suffix}"


def _ip(value: str, key: bytes) -> str | None:
    parts = [int(p) for p in value.split(".")]
    if max(parts) > 255:
        return None
    return ".".join(str(b) for b in permuted(int.from_bytes(bytes(parts), "big"), 2**32, key, "ip").to_bytes(4, "big"))


@cache
def _late_days() -> list[int]:
    """The days after the 12th of their month, in order."""
    return [d for d in range(FIRST_DAY, LAST_DAY + 1) if datetime.date.fromordinal(d).day > 12]


def _date(value: str, key: bytes) -> str | None:
    """Day-first, or month-first where that alone is a date; the order stays."""
    for form in ("%Y-%m-%d",) if "-" in value else ("%d/%m/%Y", "%m/%d/%Y") if "/" in value else ("%d.%m.%Y",):
        try:
            day = datetime.datetime.strptime(value, form).date().toordinal()
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY and form == "%m/%d/%Y":
            # only days after the 12th are written so; they are permuted among themselves, apart from what day-first dates become
            late = _late_days()
            return datetime.date.fromordinal(late[permuted(bisect_left(late, day), len(late), key, "month-first")]).strftime(form)
        if FIRST_DAY <= day <= LAST_DAY:
            new = datetime.date.fromordinal(FIRST_DAY + permuted(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))
            return new.strftime(form)
    return None


def _account(value: str, key: bytes) -> str:
    """A number with a valid check digit gets another with a valid one."""
    own = "".join(c for c in value if c.isdigit())
    if luhn(own[:-1]) != int(own[-1]):
        # the range of numbers without a valid check digit: nine last digits for each front
        x = int(own[:-1]) * 9 + (int(own[-1]) - luhn(own[:-1])) % 10 - 1
        front, last = divmod(permuted(x, 9 * 10 ** (len(own) - 1), key, "account"), 9)
        front = str(front).zfill(len(own) - 1)
        new = front + str((luhn(front) + 1 + last) % 10)
    else:
        front = _digits(own[:-1], key, "card")
        new = front + str(luhn(front))
    at = iter(new)
    return "".join(next(at) if c.isdigit() else c for c in value)


def _iban(value: str, key: bytes) -> str | None:
    own = value.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if number(own[4:] + own[:4]) % 97 != 1:
        return None
    body = _letters(own[4:], key, f"iban{own[:2]}")
    new = own[:2] + str(98 - number(body + own[:2] + "00") % 97).zfill(2) + body
    at = iter(new)
    return "".join(c if c == " " else next(at) for c in value)


def _national(value: str, key: bytes) -> str | None:
    """Area 000, 666 and 900 or more, group 00 and serial 0000 are never given out."""
    area, group, serial = map(int, value.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(permuted(x, 898 * 99 * 9999, key, "national"), 9999)
    area, group = divmod(x, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(value: str, key: bytes) -> str | None:
    """The country code stays."""
    if not 7 <= sum(c.isdigit() for c in value) <= 15:
        return None
    country = re.match(r"\+([0-9]{1,3})(?=[^0-9])", value)
    return _digits(value, key, "phone", keep=len(country[1]) if country else 0)


def _key(value: str, key: bytes) -> str:
    pieces = [value[i : i + PIECE] for i in range(0, len(value), PIECE)]
    new = "".join(f"{permuted(int(p, 16), 16 ** len(p), key, f'key{i}' if i else 'key'):0{len(p)}x}" for i, p in enumerate(pieces))
    return new.upper() if value.upper() == value and value.lower() != value else new


RULES: dict[str, Callable[[str, bytes], str | None]] = {"email": _email, "iban": _iban, "key": _key, "date": _date, "ip": _ip, "national": _national, "phone": _phone, "account": _account}


def emails(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, place of the @, end) of what could be an email; each character is looked at once, however long a run without white space is."""
    before, at = 0, text.find("@")
    while at >= 0:
        run = text[before:at]
        name = run[len(run.rstrip(NAME)) :].lstrip("._%+-")
        host = HOST.match(text, at + 1) if name else None
        if host:
            yield at - len(name), at, host.end()
        before, at = at + 1, text.find("@", at + 1)


def values(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end), leftmost first; an email that begins inside another value begins behind it, if enough is left."""
    found, at = emails(text), 0
    mail, other = next(found, None), SCAN.search(text)
    while mail or other:
        if mail and mail[0] < at:
            name = text[at : mail[1]].lstrip("._%+-") if at < mail[1] else ""
            mail = (mail[1] - len(name), *mail[1:]) if name else next(found, None)
        elif other and other.start() < at:
            other = SCAN.search(text, at)
        elif mail and (not other or mail[0] <= other.start()):
            yield "email", mail[0], mail[2]
            at = mail[2]
        else:
            yield other.lastgroup, other.start(), other.end()
            at = other.end()


def pseudonymise(text: str, key: bytes, known: dict | None = None) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with each validated value replaced, and (kind, start, end) of the values in the old text."""
    if not HINT.search(text):
        return text, []
    out, spans, at = [], [], 0
    known = {} if known is None else known
    for kind, start, end in values(text):
        value = text[start:end]
        if (kind, value) not in known:
            if len(known) >= 100_000:
                known.clear()
            known[kind, value] = RULES[kind](value, key)
        if (new := known[kind, value]) is not None:
            out += [text[at:start], new]
            at = end
            spans.append((kind, start, end))
    return "".join([*out, text[at:]]) if spans else text, spans


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def pseudonymised(df: DataFrame, key: bytes = b"creatorlake", text: str = "text", spans: str = "pii_spans", keep: tuple[str, ...] | None = None) -> DataFrame:
    """df (or its columns in keep, and the text) with pseudonyms in place of personal data and the spans of what was replaced, in code points of the old text.

    Emails, IBANs, long hexadecimal keys, dates, IPv4 addresses, national and phone numbers, account and card numbers.
    Values that don't validate (an octet over 255, a 31st of April, a wrong IBAN check) stay, as do null texts, whose
    spans are empty. Values of more than PIECE characters are permuted piece by piece. The key should be secret: whoever has it can undo the permutation. Rows aren't moved.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in (text.lower(), spans.lower())]
    order = [c for c in df.columns if c.lower() != spans.lower() and (c in kept or c.lower() == text.lower())]
    schema = T.StructType([T.StructField(c, T.StringType()) if c.lower() == text.lower() else df.schema[c] for c in order] + [T.StructField(spans, SPAN)])
    place = next(i for i, c in enumerate(order) if c.lower() == text.lower())
    names = free(df, *[f"__{i}" for i in range(len(order))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in sliced(batches):
            both = [(None, []) if t is None else pseudonymise(t, key, known) for t in each_text(b.column(place))]
            columns = [b.column(i) for i in range(len(order))]
            columns[place] = pa.array([x for x, _ in both], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for _, x in both], kind)], names=schema.names)

    return df.select(*[(df[c].cast("string") if i == place else df[c]).alias(names[i]) for i, c in enumerate(order)]).mapInArrow(run, schema)
