"""Format-preserving pseudonyms by a keyed Feistel permutation.

Values that pass their own validation - card numbers (Luhn), bank accounts (mod 97), IPv4 and IPv6
addresses, phone numbers, social security numbers, calendar dates, e-mail addresses - are replaced by another
value of the same format. A value is ranked within its format, the rank is permuted by a balanced
Feistel network under a key (walking the cycle until it falls in range), and unranked. The map is a
bijection of each format, so equal values stay equal in all documents, different ones different, and
the key's holder can go back.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import textvec as tv
from .common import narrow

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def permute(rank: int, size: int, key: bytes, tweak: str, inverse: bool = False) -> int:
    """A keyed bijection of range(size): Feistel on the least even number of bits, walking the cycle."""
    if size < 2:
        return rank
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    salt = hashlib.blake2b(f"{tweak}|{size}".encode(), digest_size=16).digest()

    def turn(part: int, k: int) -> int:
        data = bytes([k]) + part.to_bytes((half + 7) // 8, "big")
        return int.from_bytes(hashlib.blake2b(data, key=key[:64], salt=salt, digest_size=min(64, (half + 7) // 8 + 8)).digest(), "big") & mask

    while True:
        a, b = rank >> half, rank & mask
        if inverse:
            for k in reversed(range(ROUNDS)):
                a, b = b ^ turn(a, k), a
        else:
            for k in range(ROUNDS):
                a, b = b, a ^ turn(b, k)
        rank = a << half | b
        if rank < size:
            return rank


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        x = int(c) * (2 - i % 2)
        total += x - 9 * (x > 9)
    return str(-total % 10)


def refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(value: str) -> str:
    return "".join(c for c in value if c.isdigit())


def card(value: str, key: bytes, back: bool) -> str | None:
    d = _digits(value)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    n = len(d) - 1
    new = str(permute(int(d[:-1]), 10**n, key, f"card{n}", back)).zfill(n)
    return refill(value, new + luhn_digit(new))


def iban(value: str, key: bytes, back: bool) -> str | None:
    """The account part; letters stay letters, digits digits; the check digits are made anew."""
    plain = value.replace(" ", "").upper()

    def number(text: str) -> int:
        return int("".join(str(int(c, 36)) for c in text))

    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = mixed(plain[4:], key, f"iban{plain[:2]}", back)
    signs = iter(plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(signs) for c in value)


def ipv4(value: str, key: bytes, back: bool) -> str | None:
    parts = [int(p) for p in value.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in value.split(".")):
        return None
    rank = permute(sum(p << 8 * (3 - k) for k, p in enumerate(parts)), 1 << 32, key, "ipv4", back)
    return ".".join(str(rank >> 8 * (3 - k) & 255) for k in range(4))


def phone(value: str, key: bytes, back: bool) -> str | None:
    """The digits after the country code, so that +1 stays +1."""
    d = _digits(value)
    lead = len(d) - 10
    if not 0 <= lead <= 3:
        return None
    return refill(value, d[:lead] + str(permute(int(d[lead:]), 10**10, key, "phone", back)).zfill(10))


def phone_abroad(value: str, key: bytes, back: bool) -> str | None:
    """+ and 8 to 15 digits in any groups. The first group stays if it can be a country code, else two digits."""
    d = _digits(value)
    if not 8 <= len(d) <= 15:
        return None
    first = len(re.match(r"\d+", value[1:]).group())
    return _behind(value, d, first if first <= 3 else 2, key, back)


def phone_at_home(value: str, key: bytes, back: bool) -> str | None:
    """9 to 12 digits from 0 on, in any groups; two stay."""
    d = _digits(value)
    return _behind(value, d, 2, key, back) if 9 <= len(d) <= 12 else None


def _behind(value: str, d: str, lead: int, key: bytes, back: bool) -> str:
    n = len(d) - lead
    return refill(value, d[:lead] + str(permute(int(d[lead:]), 10**n, key, f"phone{n}", back)).zfill(n))


def ssn(value: str, key: bytes, back: bool) -> str | None:
    """Ranked among the valid numbers: area 001-899 without 666, group 01-99, serial 0001-9999."""
    area, group, serial = (int(p) for p in value.split("-"))
    if not (1 <= area <= 899 and area != 666 and group and serial):
        return None
    rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rank = permute(rank, 898 * 99 * 9999, key, "ssn", back)
    rank, serial = divmod(rank, 9999)
    area, group = divmod(rank, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def day(year: int, month: int, of_month: int, key: bytes, back: bool) -> datetime.date | None:
    try:
        n = datetime.date(year, month, of_month).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= n <= LAST_DAY:
        return None
    return datetime.date.fromordinal(FIRST_DAY + permute(n - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date", back))


MONTHS = "January February March April May June July August September October November December".split()


def long_date(value: str, key: bytes, back: bool) -> str | None:
    """March 5, 2020."""
    month, of_month, year = re.match(r"(\w+) (\d+), (\d+)", value).groups()
    new = day(int(year), MONTHS.index(month) + 1, int(of_month), key, back)
    return new and f"{MONTHS[new.month - 1]} {new.day}, {new.year:04d}"


def ipv6(value: str, key: bytes, back: bool) -> str | None:
    """Addresses in their short form, in small letters, as most programs write them."""
    try:
        old = ipaddress.IPv6Address(value)
    except ValueError:
        return None
    if str(old) != value:
        return None
    return str(ipaddress.IPv6Address(permute(int(old), 1 << 128, key, "ipv6", back)))


def iso_date(value: str, key: bytes, back: bool) -> str | None:
    new = day(int(value[:4]), int(value[5:7]), int(value[8:]), key, back)
    return new and f"{new.year:04d}{value[4]}{new.month:02d}{value[7]}{new.day:02d}"


def day_first(value: str, key: bytes, back: bool) -> str | None:
    """dd/mm/yyyy or dd.mm.yyyy."""
    sign = value[2]
    a, b, y = (int(p) for p in value.split(sign))
    new = day(y, b, a, key, back)
    if new:
        return f"{new.day:02d}{sign}{new.month:02d}{sign}{new.year:04d}"
    return None


def month_first(value: str, key: bytes, back: bool) -> str | None:
    """mm/dd/yyyy with a day above 12, which day_first leaves; the new day is above 12 too."""
    m, d, y = (int(p) for p in value.split("/"))
    new = day(y, m, d, key, back) if d > 12 else None
    while new and new.day <= 12:
        new = day(new.year, new.month, new.day, key, back)
    return new and f"{new.month:02d}/{new.day:02d}/{new.year:04d}"


def mixed(value: str, key: bytes, tweak: str, back: bool) -> str:
    """Letters and digits permuted within their own alphabets, all other signs kept."""
    sizes = [(10, "0") if "0" <= c <= "9" else (26, "a") if "a" <= c <= "z" else (26, "A") if "A" <= c <= "Z" else (1, c) for c in value]
    rank = size = 0
    size = 1
    for c, (n, zero) in zip(value, sizes, strict=True):
        rank, size = rank * n + ord(c) - ord(zero), size * n
    rank = permute(rank, size, key, tweak + "".join(z for _, z in sizes), back)
    out = []
    for n, zero in reversed(sizes):
        rank, r = divmod(rank, n)
        out.append(chr(ord(zero) + r))
    return "".join(reversed(out))


def email(value: str, key: bytes, back: bool) -> str | None:
    local, _, domain = value.rpartition("@")
    return f"{mixed(local, key, 'email' + domain.lower(), back)}@{domain}"


KINDS: dict[str, tuple[str, Callable[[str, bytes, bool], str | None]]] = {
    "email": (r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", email),
    "iban": (r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", iban),
    "ipv4": (r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", ipv4),
    "iso_date": (r"(?<![\w/.-])\d{4}(?:-\d{2}-|/\d{2}/)\d{2}(?=T\d{2}:|(?![\w/-]))", iso_date),
    "day_first": (r"(?<![\w/.-])\d{2}(?:/\d{2}/|\.\d{2}\.)\d{4}(?![\w/-])", day_first),
    "month_first": (r"(?<![\w/.-])\d{2}/\d{2}/\d{4}(?![\w/-])", month_first),
    "long_date": (rf"\b(?:{'|'.join(MONTHS)}) (?:[1-9]|[12]\d|3[01]), \d{{4}}(?!\w)", long_date),
    "ipv6": (r"(?<![\w:.])(?:[0-9a-f]{1,4}(?=:)|(?=::))(?::{1,2}[0-9a-f]{1,4}){0,7}(?:::)?(?![\w:.])", ipv6),
    "ssn": (r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", ssn),
    "phone": (r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)", phone),
    "phone_abroad": (r"(?<![\w+])\+[1-9]\d{0,14}(?:[ .-]\d{1,12}| ?\(\d{1,5}\)(?: ?\d{1,12})?)*(?!\w)", phone_abroad),
    "phone_at_home": (r"(?<![\w+./-])(?<!\d )(?!\d{3}-\d{2}-\d{4}(?!\d))(?:\(0[1-9]\d{0,3}\) ?\d{2,8}|0[1-9]\d{0,3}[ ./-]\d{2,8})(?:[ .-]\d{2,8}){0,4}(?![ ./-]?\d)(?!\w)", phone_at_home),
    "card": (r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)", card),
}
EACH = [(kind, re.compile(p)) for kind, (p, _) in KINDS.items()]
ONE = re.compile("|".join(f"(?P<{kind}>{p})" for kind, (p, _) in KINDS.items()))


@lru_cache(maxsize=1 << 16)
def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    return KINDS[kind][1](value, key, back)


def spans(text: str, key: bytes, back: bool = False) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, new value) of each valid value, left to right."""
    out = []
    at = 0
    while m := ONE.search(text, at):
        at = m.start() + 1  # if nothing here is valid, a value may still begin inside
        if found := first_valid(text, m.start(), key, back):
            kind, end, new = found
            if kind == "card":
                new = settled(text, out[-1][2] if out else 0, m.start(), end, new, key, back)
            out.append((kind, m.start(), end, new))
            at = end
    return out


def ends(kind: str, text: str, m: re.Match) -> list[int]:
    """Where a value may end that begins at ``m``: of a card each end of a run of digits, the nearest first; of a telephone number the farthest first.

    A nearer end of a card takes its validity from the card alone, not from what follows, which a pseudonym of the next value changes.
    """
    borders = [k for k in range(m.start() + 1, m.end() + 1) if text[k - 1].isdigit() and not text[k : k + 1].isalnum() and text[k : k + 1] not in ("_", ")")]
    if kind == "card":
        return borders
    return borders[::-1] if kind == "phone_abroad" else [m.end()]


def first_valid(text: str, start: int, key: bytes, back: bool) -> tuple[str, int, str] | None:
    """(kind, end, new value) of the value that begins at ``start``: kinds in their order."""
    for kind, pattern in EACH:
        if m := pattern.match(text, start):
            for end in ends(kind, text, m):
                new = pseudonym(kind, text[start:end], key, back)
                if new is not None:
                    return kind, end, new
    return None


def settled(text: str, after: int, start: int, end: int, new: str, key: bytes, back: bool) -> str:
    """The first of the card's successive pseudonyms that a scan finds at this place again. ``after``: the end of the value before.

    Digits before a card in one run, or the first groups of a long one, could become valid together
    with the new digits; walking on, as permute does, keeps the way back.
    """
    low = max(after, start - 40)
    before, behind = text[max(0, low - 1) : start], text[end : end + 40]
    pattern = dict(EACH)["card"]

    def moved(value: str) -> bool:
        line, own = before + value + behind, len(before)
        for at in range(low - max(0, low - 1), own + 1):
            if m := pattern.match(line, at):
                for stop in ends("card", line, m):
                    if stop > own and (at, stop) != (own, own + len(value)) and (at < own or stop < own + len(value)) and card(line[at:stop], key, back):
                        return True
        return False

    while moved(new):
        new = pseudonym("card", new, key, back)
    return new


def replace(text: str, key: bytes, back: bool = False) -> tuple[str, int]:
    found = spans(text, key, back)
    out, at = [], 0
    for _, a, b, new in found:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), len(found)


def worth_a_look(column: pa.Array) -> np.ndarray:
    """Texts with a sign @, two colons or four digits close together (eight bytes); all others have no value of any kind."""
    out = np.zeros(len(column), bool)
    for i, j, raw, offs in tv.slices(column):
        digit = ((raw >= 48) & (raw <= 57)).astype(np.int8)
        near = digit.copy()
        for k in range(1, 8):
            near[k:] += digit[:-k]
        colons = np.zeros(len(raw), bool)
        colons[1:] = (raw[1:] == 58) & (raw[:-1] == 58)
        at = np.flatnonzero((near >= 4) | (raw == 64) | colons)
        out[i + np.unique(np.searchsorted(offs, at, "right") - 1)] = True
    return out


def pseudonymise(docs: DataFrame, *, key: bytes, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """id, text with pseudonyms, n_replaced of every row.

    ``key`` is the secret of whoever runs this; there is no default. Values that fail their validation
    stay, and so do dates outside 1900 to 2099 and ten digits in one run. Ids are whole numbers. A null
    text stays null, with 0 replaced, an empty one stays empty, texts of any length are read whole; null
    ids and repeated rows are treated like any other. Where several kinds could begin at one place, the
    first of KINDS is taken. Extra columns are not read. An empty table gives no rows. ``back`` undoes it
    with the same key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                texts, n = part.column("text"), np.zeros(len(part), np.int64)
                look = worth_a_look(texts)
                new = []
                for i in np.flatnonzero(look).tolist():
                    text, n[i] = replace(texts[i].as_py(), key, back)
                    if n[i]:
                        new.append(text)
                if new:
                    texts = pc.replace_with_mask(texts, pa.array(n > 0), pa.array(new, texts.type))
                yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.int64()), texts.cast(pa.string()), pa.array(n)], ["id", "text", "n_replaced"])

    return narrow(docs, {"id": id_col, "text": text_col}).mapInArrow(run, "id long, text string, n_replaced long").withColumnsRenamed({"id": id_col, "text": text_col})
