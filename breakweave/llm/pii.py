"""Format-preserving pseudonyms for personal data.

Validated numbers, addresses and dates are found in a text and each is replaced by a value of the same
format: a keyed Feistel network permutes the values of that format (decimal digits, letters, hexadecimal
digits, days), walking on until the result is valid again. The permutation depends only on key, kind and
format, so equal values get equal pseudonyms in all documents, different values different ones, and the
holder of the key can undo it.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Longest run that is one value of the permutation; longer ones are permuted in parts, so that time stays in proportion.
PART = 64
#: Country calling codes of one and two digits (fixed values); all others have three.
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _round(key: bytes, tweak: str, turn: int, value: int, modulus: int) -> int:
    mac = hmac.new(key, f"{tweak}/{turn}/{value}".encode(), hashlib.sha256).digest()
    return int.from_bytes(mac, "big") % modulus


def feistel(value: int, left: int, right: int, key: bytes, tweak: str, undo: bool = False) -> int:
    """Keyed permutation of 0 .. left * right - 1 (alternating rounds on the two halves)."""
    a, b = divmod(value, right)
    for turn in reversed(range(ROUNDS)) if undo else range(ROUNDS):
        sign = -1 if undo else 1
        if turn % 2:
            b = (b + sign * _round(key, tweak, turn, a, right)) % right
        else:
            a = (a + sign * _round(key, tweak, turn, b, left)) % left
    return a * right + b


def permute(value: int, size: int, key: bytes, tweak: str, valid: Callable[[int], bool] = lambda v: True, undo: bool = False) -> int:
    """Permutation of the valid values below ``size``, by walking the Feistel cycle; 0 stays if nothing else is valid."""
    left = max(1, math.isqrt(size))
    right = -(-size // left)
    while True:
        value = feistel(value, left, right, key, tweak, undo)
        if value < size and valid(value):
            return value


def over_alphabet(text: str, alphabet: str, key: bytes, tweak: str, valid: Callable[[str], bool] = lambda s: True, undo: bool = False) -> str:
    """Permute a string among those of its length over ``alphabet`` that are valid."""
    base, n = len(alphabet), len(text)
    value = 0
    for c in text:
        value = value * base + alphabet.index(c)

    def spell(v: int) -> str:
        out = []
        for _ in range(n):
            v, k = divmod(v, base)
            out.append(alphabet[k])
        return "".join(reversed(out))

    return spell(permute(value, base**n, key, f"{tweak}/{n}", lambda v: valid(spell(v)), undo))


DIGITS, LETTERS, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
#: Small accented letters up to U+024F whose capitals are single letters that lead back to them.
ACCENTED = "".join(c for c in map(chr, range(0xC0, 0x250)) if c.islower() and len(c.upper()) == 1 and c.upper() != c and 0xC0 <= ord(c.upper()) < 0x250 and c.upper().lower() == c)


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _in_place(text: str, new: str, of: Callable[[str], bool]) -> str:
    """Put the characters of ``new`` where ``text`` has characters of the class; separators stay."""
    it = iter(new)
    return "".join(next(it) if of(c) else c for c in text)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isascii() and c.isdigit())


def _number(kind: str, valid: Callable[[str], bool]) -> Callable[..., str | None]:
    def change(text: str, key: bytes, undo: bool) -> str | None:
        digits = _digits(text)
        if not valid(digits):
            return None
        return _in_place(text, over_alphabet(digits, DIGITS, key, kind, valid, undo), lambda c: c.isascii() and c.isdigit())

    return change


def _phone(text: str, key: bytes, undo: bool) -> str | None:
    """Country code and marks stay, the national number is permuted.

    The permutation depends on country code and length only, so a number has one pseudonym however it is
    written; ten digits without a country code are read as a number of country code 1.
    """
    digits = _digits(text)
    keep = next((n for n in (1, 2) if digits[:n] in CALLING_CODES), 3) if text.startswith("+") else 0
    country, national = digits[:keep] or "1", digits[keep:]
    if not 6 <= len(national) <= 12 or (country == "1" and len(national) != 10):
        return None
    new = digits[:keep] + over_alphabet(national, DIGITS, key, f"phone{country}", undo=undo)
    return _in_place(text, new, lambda c: c.isascii() and c.isdigit())


def _ip(text: str, key: bytes, undo: bool) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if any(x > 255 for x in parts):
        return None
    value = 0
    for x in parts:
        value = value * 256 + x
    value = permute(value, 1 << 32, key, "ip", undo=undo)
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _letters_digits(text: str, key: bytes, tweak: str, undo: bool) -> str:
    """Runs of letters, of accented letters and of digits permuted within their class, ``PART`` characters at a time; case and marks stay."""
    out = []
    for m in re.finditer(rf"[A-Za-z]+|[0-9]+|[{ACCENTED}{ACCENTED.upper()}]+|[^A-Za-z0-9{ACCENTED}{ACCENTED.upper()}]+", text):
        for at in range(0, len(m.group()), PART):
            run = m.group()[at : at + PART]
            own = tweak if not at else f"{tweak}{at}"
            if run[0] in DIGITS:
                run = over_alphabet(run, DIGITS, key, own + "d", undo=undo)
            elif run[0].lower() in LETTERS + ACCENTED:
                plain = run[0].isascii()
                new = over_alphabet(run.lower(), LETTERS if plain else ACCENTED, key, own + ("l" if plain else "a"), undo=undo)
                run = "".join(n.upper() if o.isupper() else n for n, o in zip(new, run, strict=True))
            out.append(run)
    return "".join(out)


def _email(text: str, key: bytes, undo: bool) -> str:
    local, _, domain = text.rpartition("@")
    name, dot, top = domain.rpartition(".")
    return _letters_digits(local, key, "local", undo) + "@" + _letters_digits(name, key, "domain", undo) + dot + top


def _secret(text: str, key: bytes, undo: bool) -> str:
    new = over_alphabet(text.lower(), HEX, key, "hex", undo=undo)
    return new.upper() if text.upper() == text else new


def _social(digits: str) -> bool:
    return len(digits) == 9 and digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


_FIRST, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def _date(order: str) -> Callable[..., str | None]:
    def change(text: str, key: bytes, undo: bool) -> str | None:
        mark = text[4] if order == "ymd" else text[2]
        parts = dict(zip(order, map(int, text.split(mark)), strict=True))
        try:
            day = (date(parts["y"], parts["m"], parts["d"]) - _FIRST).days
        except ValueError:
            return None
        if not 0 <= day < _DAYS:
            return None
        new = _FIRST + timedelta(days=permute(day, _DAYS, key, "date", undo=undo))
        return mark.join({"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}[c] for c in order)

    return change


def _iban(text: str, key: bytes, undo: bool) -> str | None:
    """Country stays; the rest is permuted until the check number is right again."""
    plain = text.replace(" ", "")
    check = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    if not 15 <= len(plain) <= 34 or not check(plain):
        return None
    tail = plain[4:]
    digits = _digits(tail)
    if len(digits) < 8:
        return None
    body = _in_place(tail, over_alphabet(digits, DIGITS, key, "iban" + re.sub(r"\d", "0", tail), undo=undo), str.isdigit)
    number = int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
    return _in_place(text, plain[:2] + f"{98 - number:02d}" + body, lambda c: c != " ")


_LOCAL = r"A-Za-z0-9._%+\-À-ɏ"
#: Kinds in the order in which they are tried at a place: (name, pattern, change). Every run that a pattern can repeat over
#: is entered at its first character only and never given back in parts, so the search takes time in proportion to the text.
KINDS: list[tuple[str, str, Callable[..., str | None]]] = [
    ("email", rf"(?<![{_LOCAL}])[{_LOCAL}]++@[A-Za-z0-9\-À-ɏ]++(?:\.[A-Za-z0-9\-À-ɏ]++)*\.[A-Za-z]{{2,}}", _email),
    ("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])", _secret),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])", _iban),
    ("date", r"(?<![\d./\-])\d{4}-\d{2}-\d{2}(?!\d|[./\-]\d)", _date("ymd")),
    ("date", r"(?<![\d./\-])\d{2}\.\d{2}\.\d{4}(?!\d)", _date("dmy")),
    ("date", r"(?<![\d./\-])\d{2}/\d{2}/\d{4}(?!\d)", _date("mdy")),
    ("ip", r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)", _ip),
    ("social", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])", _number("social", _social)),
    ("account", r"(?<![\d\-])\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}(?![\d\-])|(?<![\d\-])\d{13,19}(?!\d)", _number("account", luhn)),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w\-.])\d{3}[\-.]\d{3}[\-.]\d{4}(?![\w\-])", _phone),
]
_COMPILED = [(name, re.compile(p), change) for name, p, change in KINDS]
_ANY = re.compile("|".join(f"(?P<k{i}>{p})" for i, (_, p, _) in enumerate(KINDS)))
#: Every kind has a digit or an at sign; a text without any is left at once.
_HINT = re.compile(r"[0-9@]")


def pseudonymise(text: str | None, key: bytes, undo: bool = False) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, length) of each in the new text; lengths may change only for addresses."""
    if text is None or not _HINT.search(text):
        return text, []
    out, spans, done, size, at = [], [], 0, 0, 0
    while m := _ANY.search(text, at):
        kind, end, new = _first_valid(text, m, key, undo)
        if new is None:
            at = m.start() + 1  # what the failed match covers may hold other values
            continue
        out += [text[done : m.start()], new]
        size += m.start() - done
        spans.append((kind, size, len(new)))
        size += len(new)
        done = at = end
    return "".join(out) + text[done:], spans


def _first_valid(text: str, m: re.Match, key: bytes, undo: bool) -> tuple[str, int, str | None]:
    """Kind, end and pseudonym of the first kind that is valid at a match's start, in full or cut at one of its marks."""
    for kind, pattern, change in _COMPILED[int(m.lastgroup[1:]) :]:
        own = pattern.match(text, m.start())
        while own:
            new = _changed(change, own.group(), key, undo)
            if new is not None:
                return kind, own.end(), new
            cut = max(own.group().rfind(c) for c in " .-")
            own = pattern.match(text, m.start(), m.start() + cut) if cut > 0 else None
    return "", m.end(), None


@lru_cache(maxsize=20_000)
def _changed(change: Callable[..., str | None], found: str, key: bytes, undo: bool) -> str | None:
    return change(found, key, undo)


def pseudonymise_documents(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, text, found, kinds``; ``key`` is the caller's secret.

    ``text`` has pseudonyms in place of all personal data found, ``found`` is their number, ``kinds`` one
    (kind, start, length) each, by code points of the new text. Defined cases: a null text stays null and
    an empty one empty, with none found; values that fail validation (an impossible date, an octet over
    255, a wrong check number or check digit) are no personal data and stay, but what they cover is searched
    again, for shorter values of the kind and for other kinds; national numbers written with a leading 0, a 0
    in brackets after the country code, and addresses of the longer internet protocol are not looked for; one-letter
    parts of addresses have one of 26 pseudonyms; very long texts are read whole in time proportional to their length;
    other columns are ignored, so their names can't clash; null ids and repeated rows are handled like
    any other row; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                done = [pseudonymise(t.as_py(), key) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([len(s) for _, s in done], pa.int64()), pa.array([[{"kind": k, "start": a, "length": n} for k, a, n in s] for _, s in done], kind)],
                    ["doc_id", "text", "found", "kinds"],
                )

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id bigint, text string, found bigint, kinds array<struct<kind:string,start:bigint,length:bigint>>")
