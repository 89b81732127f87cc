"""Format-preserving pseudonyms by a keyed Feistel network.

Numbers and dates that hold up to their own rules are replaced by others of the same form: card numbers (Luhn), IBANs
(remainder by 97), social security numbers, IPv4 addresses, telephone numbers, dates of 1900-2099, and the local parts
of mail addresses. A value is read as a number below the count of its form's values and permuted there (ten rounds;
values outside are permuted again until one falls inside), and check digits are worked out anew. The key and the form
fix the permutation, so equal values have equal pseudonyms in every document, however they are spaced.

Defined results: null stays null, empty stays empty; texts are read whole; what breaks the rules of every form it has, at
all lengths that end between words, is left alone, and the next place is tried; equal rows give equal results; an empty
table gives an empty table; input columns that have the name of a new one are replaced.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_right
from calendar import monthrange
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from postlake.llm.arrow import batch_of, map_slices

ROUNDS = 10
_MAYBE = re.compile(r"[0-9]{2}|@")
_MAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*)@(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2})", re.ASCII)


def _forms(after: str, *shapes: str) -> tuple[re.Pattern, list[re.Pattern]]:
    return re.compile(after, re.ASCII), [re.compile(s, re.ASCII) for s in shapes]


#: Per form what may not follow it, and its shapes. Cards in their usual groups and the other strict forms are looked for
#: first, cards in odd groups and telephone numbers between them; so these do not run into a value of a strict form.
_STRICT = {
    "iban": _forms(r"[A-Za-z0-9]", r"(?<!\w)[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?"),
    "ip": _forms(r"\w|\.[0-9]", r"(?<!\w)[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    "date": _forms(r"\w|[-/.][0-9]", r"(?<!\w)(?:[0-9]{4}(?P<s>[-/.])[0-9]{1,2}(?P=s)[0-9]{1,2}|[0-9]{1,2}(?P<z>[-/.])[0-9]{1,2}(?P=z)[0-9]{4})"),
    "ssn": _forms(r"\w|-[0-9]", r"(?<!\w)[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "card": _forms(r"\w", r"(?<![\w+])(?:[0-9]{13,19}|[0-9]{4}(?P<s>[ -])(?:[0-9]{4}(?P=s)[0-9]{4}(?P=s)[0-9]{4}(?:(?P=s)[0-9]{3})?|[0-9]{6}(?P=s)[0-9]{4,5}))"),
}
#: Without a country code a telephone number has a pattern that only they have: an area code in brackets, groups of
#: three, three and four digits, or a trunk 0 and nine digits at least. Ranges of years, counts in groups, pages and the
#: inside of longer codes have none of them.
_LOOSE = {
    "card": _forms(r"\w", r"(?<!\w)[0-9](?:[ -]?[0-9]){12,18}"),
    "phone": _forms(
        r"\w|[.-][0-9]",
        r"(?<![\w.])(?:\+1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}",
        r"(?<![\w.])\+(?:1[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{8,15})",
        r"(?<![\w.])\+[0-9]{1,15}(?:[ .-]?\([0-9]{1,5}\)[ .-]?[0-9]{1,12}|[ .-][0-9]{1,12}){0,14}",
        r"(?<![\w.-])[0-9]{3} [0-9]{3}[ .-][0-9]{4}",
        r"(?<![\w.-])\([0-9]{2,4}\)[ .-]?(?:[0-9]{2,4}[ .-]){0,7}[0-9]{3,8}",
        r"(?<![\w.-])0[1-9][0-9]{0,3}(?:[ .-][0-9]{2,4}){0,6}[ .-][0-9]{2,8}",
    ),
}
_STRICT_START = re.compile(r"(?<!\w)(?:[0-9]{1,6}[-/. ][0-9]|[0-9]{13}|[A-Z]{2}[0-9]{2}[ A-Z0-9])", re.ASCII)
_LOOSE_START = re.compile(r"(?<!\w)(?:\+[0-9]|\+?\([0-9]{2,4}\)|[0-9]{1,18}[ .-][0-9]|[0-9]{13})", re.ASCII)
#: Country codes that are not of three digits.
_CODE = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]")
#: How many days after the twelfth there are before each month from January 1900 to the end of 2099.
_LATE = [0, *accumulate(monthrange(y, m)[1] - 12 for y in range(1900, 2100) for m in range(1, 13))]


class Permuter:
    """Keyed permutations of 0 .. size - 1, one for each form."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def permute(self, value: int, size: int, form: str) -> int:
        if size < 2:
            return value
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask, width = (1 << half) - 1, (half + 7) // 8
        tweak = f"{form}:{size}:".encode()
        while True:
            left, right = value >> half, value & mask
            for r in range(ROUNDS):
                digest = hashlib.shake_256(self.key + tweak + bytes([r]) + right.to_bytes(width, "big")).digest(width)
                left, right = right, left ^ (int.from_bytes(digest, "big") & mask)
            value = left << half | right
            if value < size:
                return value

    def digits(self, digits: str, form: str) -> str:
        return str(self.permute(int(digits), 10 ** len(digits), form)).zfill(len(digits))


def luhn(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def luhn_digit(payload: str) -> str:
    total = 0
    for i, d in enumerate(reversed(payload)):
        n = int(d) * (2 - i % 2)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def _refill(form: str, digits: str) -> str:
    """``form`` with its digits replaced, one by one."""
    fresh = iter(digits)
    return "".join(next(fresh) if c.isdigit() else c for c in form)


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _card(p: Permuter, text: str) -> str | None:
    digits = _only_digits(text)
    if not luhn(digits) or len(set(digits)) == 1:
        return None
    # The first digit, which names the network, stays.
    payload = digits[0] + p.digits(digits[1:-1], "card")
    return _refill(text, payload + luhn_digit(payload))


def _iban_number(text: str) -> int:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved))


def _iban(p: Permuter, text: str) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_number(plain) % 97 != 1:
        return None
    value, size = 0, 1
    for c in plain[4:]:
        base = 10 if c.isdigit() else 26
        value, size = value * base + (int(c) if base == 10 else ord(c) - 65), size * base
    value = p.permute(value, size, "iban" + plain[:2])
    body = []
    for c in reversed(plain[4:]):
        base = 10 if c.isdigit() else 26
        value, d = divmod(value, base)
        body.append(str(d) if base == 10 else chr(65 + d))
    body = "".join(reversed(body))
    fresh = iter(plain[:2] + f"{98 - _iban_number(plain[:2] + '00' + body) % 97:02d}" + body)
    return "".join(c if c == " " else next(fresh) for c in text)


def _other_date(p: Permuter, year: int, month: int, day: int) -> tuple[int, int, int]:
    """Days up to the twelfth and later ones are permuted apart, in every way to write a date.

    A day that could be a month stays one, so a pseudonym is read like its date, and all forms of a date stay linked.
    """
    place = (year - 1900) * 12 + month - 1
    if day <= 12:
        place, day = divmod(p.permute(place * 12 + day - 1, (len(_LATE) - 1) * 12, "date12"), 12)
        day += 1
    else:
        value = p.permute(_LATE[place] + day - 13, _LATE[-1], "date31")
        place = bisect_right(_LATE, value) - 1
        day = value - _LATE[place] + 13
    return 1900 + place // 12, place % 12 + 1, day


def _date(p: Permuter, text: str) -> str | None:
    parts = re.split(r"[-/.]", text)
    sign = text[len(parts[0])]
    if len(parts[0]) == 4:
        order = (0, 1, 2)
    else:
        order = (2, 0, 1) if sign == "/" and int(parts[0]) <= 12 else (2, 1, 0)
    year, month, day = (int(parts[i]) for i in order)
    try:
        datetime.date(year, month, day)
    except ValueError:
        return None
    if not 1900 <= year <= 2099:
        return None
    year, month, day = _other_date(p, year, month, day)
    out = ["", "", ""]
    for i, n in zip(order, (year, month, day), strict=True):
        out[i] = str(n).zfill(len(parts[i])) if len(parts[i]) > 1 else str(n)
    return sign.join(out)


def _ip(p: Permuter, text: str) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(str(n) != x for n, x in zip(parts, text.split("."), strict=True)):
        return None
    value = p.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _ssn(p: Permuter, text: str) -> str | None:
    def valid(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    digits = _only_digits(text)
    if not valid(digits):
        return None
    digits = p.digits(digits, "ssn")
    while not valid(digits):
        digits = p.digits(digits, "ssn")
    return _refill(text, digits)


def _phone(p: Permuter, text: str) -> str | None:
    digits = _only_digits(text)
    if not (9 if text[0] == "0" else 8) <= len(digits) <= 15:
        return None
    # The country code stays; it is read from the digits, so that spacing makes no difference.
    code = _CODE.match(digits)
    keep = (len(code[0]) if code else 3) if text[0] == "+" else 0
    if len(digits) - keep < 6:
        return None
    return _refill(text, digits[:keep] + p.digits(digits[keep:], "phone"))


def _mail(p: Permuter, text: str) -> str | None:
    local = text[:-1].lower()
    value, size = 0, 1
    for c in local:
        base = 26 if c.isalpha() else 10 if c.isdigit() else 1
        value, size = value * base + (ord(c) - 97 if base == 26 else int(c) if base == 10 else 0), size * base
    value = p.permute(value, size, "mail")
    out = []
    for c in reversed(text[:-1]):
        base = 26 if c.isalpha() else 10 if c.isdigit() else 1
        value, d = divmod(value, base)
        out.append(c if base == 1 else str(d) if base == 10 else chr((65 if c.isupper() else 97) + d))
    return "".join(reversed(out)) + "@"


_RULES = {"mail": _mail, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}


def _value_at(permuter: Permuter, text: str, start: int, high: int, forms: dict) -> tuple[str, int, int, str] | None:
    """The first form, and the longest value of its first shape, that holds up at one place: kind, start, end, pseudonym."""
    for kind, (after, shapes) in forms.items():
        for shape in shapes:
            m = shape.match(text, start, high)
            for end in range(m.end() if m else 0, start, -1):
                if text[end - 1].isalnum() and not after.match(text, end) and shape.fullmatch(text, start, end):
                    new = _RULES[kind](permuter, text[start:end])
                    if new is not None:
                        return kind, start, end, new
    return None


def _values(permuter: Permuter, text: str, taken: list[tuple], starts: re.Pattern, forms: dict) -> list[tuple]:
    """``taken`` and the values between them; where none holds up the next place is tried."""
    out, at = [], 0
    for after in [*taken, (None, len(text), len(text), "")]:
        high = after[1]
        while m := starts.search(text, at, high):
            value = _value_at(permuter, text, m.start(), high, forms)
            at = value[2] if value else m.start() + 1
            if value:
                out.append(value)
        out.append(after)
        at = after[2]
    return out[:-1]


def pseudonymize(permuter: Permuter, text: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of what they replace, in code points of the input."""
    if not _MAYBE.search(text):
        return text, []
    found = [("mail", m.start(), m.end(), _mail(permuter, m[0])) for m in _MAIL.finditer(text)]
    found = _values(permuter, text, found, _STRICT_START, _STRICT)
    found = _values(permuter, text, found, _LOOSE_START, _LOOSE)
    out, at = [], 0
    for _, start, end, new in found:
        out += [text[at:start], new]
        at = end
    return "".join(out) + text[at:], [f[:3] for f in found]


def replace(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with pseudonyms in ``text``, and pii_spans, n_replaced."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    kept = [c for c in docs.columns if c not in ("pii_spans", "n_replaced")]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("pii_spans", T.ArrayType(span)), T.StructField("n_replaced", T.LongType())])

    def make():
        permuter = Permuter(key)

        def step(part: pa.RecordBatch):
            done = [(None, []) if t is None else pseudonymize(permuter, t) for t in part.column(text).to_pylist()]
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in done]
            yield batch_of(schema, {c: part.column(c) for c in kept} | {
                text: pa.array([t for t, _ in done], pa.large_string()), "pii_spans": spans, "n_replaced": [len(s) for s in spans]})

        return step

    return map_slices(docs.select(kept), text, schema, make)
