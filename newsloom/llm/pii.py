"""PII: format-preserving Feistel pseudonyms.

Validated values are found in whole texts and replaced by a keyed permutation inside their own format, so equal values
stay linked across documents and a replaced value is valid again: card numbers keep their Luhn check, IBANs their
mod-97 check, dates stay calendar dates, IPv4 addresses stay addresses. Letter case and separators are kept.

Each kind is a bijection on [0, size): a generalised Feistel network over a * b >= size with a keyed BLAKE2b round
function, walked until it lands inside the range. Of mail addresses with a very long local part, the two halves of the
network are lists of letters and digits instead of numbers, so any length takes linear time. A local part that is not ASCII, or has no letter
or digit, becomes ``u`` and a keyed digest of 128 bits instead.

Phone numbers keep their country code and the 0 or 1 dialled before an area; month-first dates stay month-first.

Defined cases: a null text stays null with 0 findings; texts without a digit or ``@`` are passed on unread; overlapping
candidates are taken left to right, the longest kind first; numbers that fail their check are left alone, and the scan goes
on behind their first group. A run of digit groups is read at every group border, customary card layouts before any other;
an IBAN ends where its country's length says. The key is a required parameter; ``session_key`` reads it from the session's settings. Rows, ids and extra columns are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import os
import re
import struct
import unicodedata
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.arrow import small_batches, text_bytes

# The session setting that holds the key, in hexadecimal. Its name is one that Spark redacts in logs.
KEY_SETTING = "spark.newsloom.pii.secret"
_RANDOM_KEY = os.urandom(32)                    # of this driver, where the session names none
ROUNDS = 8
LONG = 64                                       # letters and digits above which a local part is permuted digit by digit
KINDS = ("email", "iban", "ipv4", "phone", "date", "ssn", "card")

_MAYBE = re.compile(rb"[0-9@]")
# Combining marks: parts of letters that \w leaves out.
_MARKS = (r"\u0300-\u036f\u0483-\u0487\u0591-\u05bd\u064b-\u065f\u0670\u0900-\u0963\u0966-\u0dff\u0e31-\u0e4e"
          r"\u1ab0-\u1aff\u1dc0-\u1dff\u3099\u309a")
# A lookbehind lets each run of characters start a match once, so long runs stay linear.
_FIND = re.compile(r"""
  (?P<email>(?<![\w.%+MARKS-])[\w.%+MARKS-]+@[\wMARKS-]+(?:\.[\wMARKS-]+)+)
 |(?P<iban>(?<![\w])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))
 |(?P<ipv4>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9]))
 |(?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])
   |(?<![\w+])(?:\+|(?<![.-])00)[1-9][0-9]{0,2}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]){5,28}(?!\w)
   |(?<![\w+/-])(?<![0-9]\.)(?:1[ .-])?(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}(?P<sep>[ .-])[0-9]{3}(?P=sep)[0-9]{4}
     (?!(?P=sep)[0-9]))(?![\w-])
   |(?<![\w+/-])(?<![0-9]\.)0[1-9](?P<two>[ .-])[0-9]{2}(?:(?P=two)[0-9]{2}){3}(?!\w|(?P=two)[0-9])
   |(?<![\w+/-])(?<![0-9]\.)(?:\(0[1-9][0-9]{1,4}\)[ ]?|0[1-9][0-9]{1,4}[ /-])(?:[0-9]{5,8}|[0-9]{3,4}[ -][0-9]{3,4})(?![\w-]))
 |(?P<date>(?<![\w/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})
   (?:(?=[Tt][0-9]{2}:?[0-9]{2})|(?![\w/-])))
 |(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
 |(?P<card>(?<![\w.-])[0-9](?:[ -]?[0-9]){12,37}(?![\w-]))
""".replace("MARKS", _MARKS), re.VERBOSE)
_IBAN_START = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}")
_GROUP = re.compile(r"[0-9]+")
_NANP = re.compile(r"(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}")
_TEN_DIGITS = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}")
_CARD_16 = re.compile(r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
_FIRST_GROUP = re.compile(r"\W*\w+")
# Lengths of the IBAN registry.
_IBAN_LENGTHS = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in cs.split()}
_DOUBLED = str.maketrans("0123456789", "0246813579")
_CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (13,), (14,), (15,), (16,), (17,), (18,), (19,)}
# The country calling codes of two digits; +1 and +7 have one, all others three.
_TWO_DIGIT_CODES = frozenset(map(str, (20, 27, *range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59),
                                       *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98)))
# Digits behind the country code where nearly all numbers of a country have as many.
_BODY_DIGITS = {"1": 10, "7": 10, "31": 9, "33": 9, "34": 9, "41": 9, "44": 10, "45": 8, "47": 8, "48": 9, "61": 9, "65": 8,
                "91": 10, "351": 9, "380": 9, "420": 9}
_DATE_FORMS = {"-": "%Y-%m-%d", "/": "%d/%m/%Y", ".": "%d.%m.%Y"}
_FIRST_DAY = dt.date(1900, 1, 1).toordinal()
_DAYS = dt.date(2100, 1, 1).toordinal() - _FIRST_DAY


def _noise(message: bytes, width: int, key: bytes) -> bytes:
    """``width`` keyed bytes: one digest, or numbered digests of the message's digest."""
    if width <= 64:
        return hashlib.blake2b(message, key=key[:64], digest_size=width).digest()
    seed = hashlib.blake2b(message, key=key[:64]).digest()
    return b"".join(hashlib.blake2b(seed + i.to_bytes(8, "big"), key=key[:64]).digest()
                    for i in range(-(-width // 64)))[:width]


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of [0, size)."""
    if size < 2:
        return x
    a = isqrt(size - 1) + 1
    b = -(-size // a)
    width = (max(a, b).bit_length() + 7) // 8 + 8

    def noise(i: int, v: int) -> int:
        return int.from_bytes(_noise(f"{tweak}|{size:x}|{i}|{v:x}".encode(), width, key), "big")

    while True:
        left, right = divmod(x, b)
        for i in range(0, ROUNDS, 2):
            left = (left + noise(i, right)) % a
            right = (right + noise(i + 1, left)) % b
        x = left * b + right
        if x < size:
            return x


def _permute_digits(values: list[int], bases: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of the mixed-radix numbers of ``bases``, digit by digit, in time linear in their count."""
    half = len(values) // 2
    parts, radix = [values[:half], values[half:]], [bases[:half], bases[half:]]
    for i in range(ROUNDS):
        to, other = parts[i % 2], parts[1 - i % 2]
        noise = _noise(f"{tweak}|{len(values)}|{i}|".encode() + bytes(other), 8 * len(to), key)
        parts[i % 2] = [(v + x) % n for v, (x,), n in zip(to, struct.iter_unpack(">Q", noise), radix[i % 2], strict=True)]
    return parts[0] + parts[1]


def _luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(shape: str, chars: str) -> str:
    """``shape`` with its ASCII letters and digits replaced in order by ``chars``; letter case is kept."""
    it = iter(chars)
    return "".join((next(it).upper() if c.isupper() else next(it)) if c.isascii() and c.isalnum() else c for c in shape)


def _shuffle_chars(text: str, key: bytes, tweak: str) -> str:
    """Permutes ASCII letters among letters and digits among digits, as one mixed-radix number."""
    bases = [(10, 48) if c.isdigit() else (26, 97) for c in text.lower() if c.isascii() and c.isalnum()]
    if len(bases) > LONG:
        values = [ord(c) - first for c, (_, first) in zip(
            (c for c in text.lower() if c.isascii() and c.isalnum()), bases, strict=True)]
        shape = "".join("d" if n == 10 else "l" for n, _ in bases)
        values = _permute_digits(values, [n for n, _ in bases], key, f"{tweak}|{shape}")
        return _refill(text, "".join(chr(first + v) for v, (_, first) in zip(values, bases, strict=True)))
    value, size = 0, 1
    for c, (n, first) in zip((c for c in text.lower() if c.isascii() and c.isalnum()), bases, strict=True):
        value, size = value * n + ord(c) - first, size * n
    value = permute(value, size, key, f"{tweak}|{''.join('d' if n == 10 else 'l' for n, _ in bases)}")
    out = []
    for n, first in reversed(bases):
        value, d = divmod(value, n)
        out.append(chr(first + d))
    return _refill(text, "".join(reversed(out)))


def _ascii_name(local: str, host: str, key: bytes) -> str:
    """The replacement of a local part that has other than ASCII characters, or no letter and no digit: a keyed digest."""
    plain = unicodedata.normalize("NFC", local).lower()
    return "u" + hashlib.blake2b(f"email|{host.lower()}|{plain}".encode(), key=key[:64], digest_size=16).hexdigest()


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban_end(text: str, at: int) -> int | None:
    """The end of the valid IBAN that starts at ``at``, by its country's length."""
    left, end = _IBAN_LENGTHS.get(text[at:at + 2], 0), at
    if not left:
        return None
    while left and end < len(text):
        c = text[end]
        if c == " " and text[end - 1] != " ":
            end += 1
            continue
        if not (c.isascii() and (c.isdigit() or c.isupper())):
            return None
        left, end = left - 1, end + 1
    if left or end < len(text) and (text[end].isalnum() or text[end] == "_"):
        return None
    plain = text[at:end].replace(" ", "")
    return end if _mod97(plain[4:] + plain[:4]) == 1 else None


def _iban_span(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The first IBAN of a registered country in a candidate; of any other code, the candidate as a whole."""
    for m in _IBAN_START.finditer(text, start, end):
        found = _iban_end(text, m.start())
        if found:
            return m.start(), found
    return None if text[start:start + 2] in _IBAN_LENGTHS else (start, end)


def _is_card(digits: str) -> bool:
    return sum(map(int, digits[::-2])) % 10 == -sum(map(int, digits[-2::-2].translate(_DOUBLED))) % 10


def _card_span(text: str, start: int, end: int) -> tuple[int, int] | None:
    """A card number in a run of digit groups: a reading from the first group on, the longest one, unless one in a
    customary layout starts before its end. Customary layouts also stand inside hyphenated numbers."""
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    sizes = tuple(b - a for a, b in groups)
    plain, digits = None, ""
    for a, b in groups:
        digits += text[a:b]
        if len(digits) > 19:
            break
        if len(digits) >= 13 and text[b:b + 1] != "-" and _is_card(digits):
            plain = groups[0][0], b
    for i, (a, _) in enumerate(groups):
        if plain and a >= plain[1]:
            break
        if sizes[i] != 4 and sizes[i] < 13:
            continue
        for n in (1, 3, 4, 5):                  # 4-4-4-4 before the rare 4-4-4-4-3
            b = groups[i + n - 1][1] if i + n <= len(groups) else 0
            if sizes[i:i + n] in _CARD_GROUPS and b and _is_card("".join(filter(str.isdigit, text[a:b]))):
                return a, b
    return plain


def _phone_prefix(found: str, digits: str) -> str:
    """The digits of a phone number that stay: its country code with 00, and the 0 or 1 dialled before the area."""
    lead = "00" if found.startswith("00") else ""
    if not lead and found[0] != "+":
        return "" if _NANP.fullmatch(found) else digits[0]
    rest = digits[len(lead):]
    code = rest[:1 if rest[0] in "17" else 2 if rest[:2] in _TWO_DIGIT_CODES else 3]
    if code == "1" and len(rest) != 11 and _TEN_DIGITS.fullmatch(found):
        return digits[:-10]
    trunk = "0" if code not in ("1", "39") and rest[len(code):len(code) + 1] == "0" else ""
    return lead + code + trunk


def _phone_span(text: str, start: int, end: int) -> tuple[int, int] | None:
    """An international number's customary length of its country, if a group ends there; else its longest reading in
    front of another value."""
    if text[start] != "+" and not text.startswith("00", start):
        return start, end
    best = None
    for m in _GROUP.finditer(text, start, end):
        if best:
            other = _FIND.match(text, m.start())
            card = _CARD_16.match(text, m.start())
            if other and other.lastgroup in ("date", "ssn", "ipv4") and pseudonym(other.lastgroup, other[0], b"") or (
                    card and pseudonym("card", card[0], b"")):
                break
        found = text[start:m.end()]
        if pseudonym("phone", found, b""):
            best = start, m.end()
            digits = "".join(filter(str.isdigit, found))
            kept = _phone_prefix(found, digits)
            if len(digits) - len(kept) == _BODY_DIGITS.get(kept.lstrip("0").removesuffix("0")):
                break
    return best


def pseudonym(kind: str, found: str, key: bytes) -> str | None:
    """The replacement of one candidate; None if it isn't a valid value of its kind."""
    digits = "".join(c for c in found if c.isdigit())
    if kind == "email":
        local, _, host = found.partition("@")
        if not local.isascii() or not any(c.isalnum() for c in local):
            return f"{_ascii_name(local, host, key)}@{host}"
        return f"{_shuffle_chars(local, key, 'email|' + host.lower())}@{host}"
    if kind == "iban":
        plain = found.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
            return None
        body = _shuffle_chars(plain[4:], key, "iban|" + plain[:2])
        return _refill(found, f"{plain[:2]}{98 - _mod97(body + plain[:2] + '00'):02d}{body}")
    if kind == "ipv4":
        parts = [int(p) for p in found.split(".")]
        if max(parts) > 255 or any(str(p) != s for p, s in zip(parts, found.split("."), strict=True)):
            return None
        n = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, kind)
        return ".".join(map(str, n.to_bytes(4, "big")))
    if kind == "phone":
        kept = _phone_prefix(found, digits)
        body = digits[len(kept):]
        if not 6 <= len(body) <= 13 or not 9 <= len(digits) <= 15 or kept in ("1", "001") and len(body) != 10:
            return None
        tweak = kind if len(body) == 10 else f"{kind}|{len(body)}"
        new = permute(int(body), 10 ** len(body), key, tweak)
        while (new < 10 ** (len(body) - 1)) != (body[0] == "0"):    # a leading 0 stays one and none appears
            new = permute(new, 10 ** len(body), key, tweak)
        return _refill(found, kept + f"{new:0{len(body)}d}")
    if kind == "date":
        form = _DATE_FORMS[next(c for c in found if not c.isdigit())]
        month_first = form == "%d/%m/%Y" and int(found[:2]) <= 12 < int(found[3:5])
        if month_first:
            form = "%m/%d/%Y"
        try:
            day = dt.datetime.strptime(found, form).date().toordinal() - _FIRST_DAY
        except ValueError:
            return None
        if not 0 <= day < _DAYS:
            return None
        day = permute(day, _DAYS, key, kind)
        while month_first and dt.date.fromordinal(_FIRST_DAY + day).day <= 12:      # never read as a day-first date
            day = permute(day, _DAYS, key, kind)
        return dt.date.fromordinal(_FIRST_DAY + day).strftime(form)
    if kind == "ssn":
        def valid(n: int) -> bool:
            area, rest = divmod(n, 10 ** 6)
            return area not in (0, 666) and area < 900 and rest // 10 ** 4 > 0 and rest % 10 ** 4 > 0
        n = int(digits)
        if not valid(n):
            return None
        n = permute(n, 9 * 10 ** 8, key, kind)
        while not valid(n):                     # walking on stays a bijection of the valid numbers
            n = permute(n, 9 * 10 ** 8, key, kind)
        return _refill(found, f"{n:09d}")
    if _luhn(digits[:-1]) != int(digits[-1]):
        return None
    size = len(digits) - 2                      # the first digit (the network) and the check digit frame the payload
    body = digits[0] + f"{permute(int(digits[1:-1]), 10 ** size, key, f'card|{digits[0]}'):0{size}d}"
    return _refill(found, body + str(_luhn(body)))


_SPANS = {"iban": _iban_span, "phone": _phone_span, "card": _card_span}


def replace_all(text: bytes | None, key: bytes) -> tuple[str | None, dict[str, int]]:
    """The text with every validated value replaced, and how many of each kind."""
    if text is None:
        return None, {}
    if not _MAYBE.search(text):
        return text.decode(), {}
    n: dict[str, int] = {}

    whole, out, done, at = text.decode(), [], 0, 0
    while m := _FIND.search(whole, at):
        kind, span = m.lastgroup, m.span()
        if kind in _SPANS:
            span = _SPANS[kind](whole, *span)
        new = pseudonym(kind, whole[slice(*span)], key) if span else None
        if new is None:
            at = _FIRST_GROUP.match(whole, m.start()).end()
            continue
        n[kind] = n.get(kind, 0) + 1
        out += [whole[done:span[0]], new]
        done = at = span[1]
    return "".join([*out, whole[done:]]), n


def session_key(spark: SparkSession) -> bytes:
    """The key that ``KEY_SETTING`` names, else a random one of this driver: pseudonyms are then linked within one
    application, and nobody can invert them afterwards. Set one to link texts of several runs."""
    named = spark.conf.get(KEY_SETTING, None)
    return bytes.fromhex(named) if named else _RANDOM_KEY


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``doc_id, text`` (replaced) and ``n_<kind>`` per kind, one row per row of ``docs``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [replace_all(t, key) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t for t, _ in done], pa.string()),
                 *[pa.array([n.get(k, 0) for _, n in done], pa.int64()) for k in KINDS]],
                ["doc_id", "text", *[f"n_{k}" for k in KINDS]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, text string, " + ", ".join(f"n_{k} long" for k in KINDS))


def rewrite(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with replaced texts and all its other columns; ``n_chars``, where present, follows the new text."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([replace_all(t, key)[0] for t in text_bytes(batch.column(at))], pa.string())
            yield batch.set_column(at, batch.schema.field(at), new.cast(batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                             .otherwise(F.length("text")).cast(kind))
    return out
