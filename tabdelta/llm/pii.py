"""Format-preserving pseudonyms by a keyed Feistel network.

Personal values are found by pattern, validated (Luhn check, IPv4 octets, real
calendar dates, plausible phone and account numbers), and replaced by the image of
a keyed permutation of all values of the same format: a card number stays a valid
card number, a date a date, an address an address. The permutation is a function
of the key and the value alone, so equal values stay linked across documents with
no shared state, and the holder of the key can invert it. The key is an argument
without default.

Dates with slashes are read day first. One that isn't a date that way but is one
month first (12/25/1990) is permuted among the dates of that kind.

Defined results: a null text stays null, with counts of 0; every row gives one row,
repeated ones included; columns named like a result column are replaced; values
that fail validation are left alone. Texts are read whole, one at a time.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import without

ROUNDS = 10
#: For the registered queries and the pipeline over invented data only: anyone can read it, so what it hides is not hidden.
DEMO_KEY = b"replace with a secret of at least 16 bytes"
KINDS = ("email", "card", "iban", "phone", "ssn", "ip", "date", "secret")

#: How each kind is written.
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9_+-][\w.+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?i:\b(?:token|secret|api_?key|password)\b[\"']?\s*[:=]\s*[\"']?)[A-Za-z0-9_\-]{16,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?!\w)|(?<![\w+])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?!\w)|(?<![\w.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w.-]*[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "date": r"(?<![\w/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\w/-])",
    "ip": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{13,19})(?![0-9])",
}


def find_values(patterns=None) -> re.Pattern:
    p = dict(patterns or PATTERNS)
    p["card"] = p["card"].replace("([ -])", "(?P<gap>[ -])").replace(r"\1", "(?P=gap)")
    return re.compile("|".join(f"(?P<{k}>{v})" for k, v in p.items()))


class Feistel:
    """A keyed permutation of range(n): a balanced network on the next even number of bits, walked until inside."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = hashlib.sha256(key).digest(), rounds

    def _round(self, label: bytes, k: int, half: int, value: int) -> int:
        size = (half + 7) // 8
        data = b"%d|%s|" % (k, label) + value.to_bytes(size, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=min(64, size + 8)).digest(), "big") & ((1 << half) - 1)

    def _once(self, x: int, half: int, label: bytes, back: bool) -> int:
        mask = (1 << half) - 1
        a, b = x >> half, x & mask
        if back:
            for k in reversed(range(self.rounds)):
                a, b = b ^ self._round(label, k, half, a), a
        else:
            for k in range(self.rounds):
                a, b = b, a ^ self._round(label, k, half, b)
        return a << half | b

    def permute(self, x: int, n: int, label: str, back: bool = False) -> int:
        if n < 2:
            return x
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        if half > 448:
            raise ValueError("values of at most 896 bits")
        tag = b"%s|%d" % (label.encode(), n)
        x = self._once(x, half, tag, back)
        while x >= n:
            x = self._once(x, half, tag, back)
        return x


def luhn_digit(digits: str) -> str:
    """The check digit that makes digits + digit valid."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


_DAY0, _DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
_HEX = "0123456789abcdef"


class Pseudonyms:
    """Maps of single values; every map is a permutation of its format and has an inverse."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.feistel = Feistel(key, rounds)
        self.maps = {k: getattr(self, f"_{k}") for k in KINDS}

    def swap(self, kind: str, value: str, back: bool = False) -> str | None:
        """The pseudonym (or with back the original); None where the value isn't valid."""
        return self.maps[kind](value, back)

    def _digits(self, digits: str, label: str, back: bool) -> str:
        return str(self.feistel.permute(int(digits), 10 ** len(digits), label, back)).zfill(len(digits))

    @staticmethod
    def _refill(shape: str, chars: str) -> str:
        """Letters and digits of the shape replaced in order, everything else kept."""
        it = iter(chars)
        return "".join(next(it) if c.isdigit() else c for c in shape)

    def _by_class(self, value: str, label: str, back: bool, classes=_CLASSES) -> str:
        """Each character stays in its class; the value is one number in mixed radix, in pieces of at most 100 characters."""
        out = []
        for lo in range(0, len(value), 100):
            part = value[lo : lo + 100]
            own = [next((c for c in classes if x in c), None) for x in part]
            number, total = 0, 1
            for x, c in zip(part, own):
                if c:
                    number, total = number * len(c) + c.index(x), total * len(c)
            number = self.feistel.permute(number, total, f"{label}|{lo}|" + "".join("-" if c is None else str(classes.index(c)) for c in own), back)
            chars = []
            for x, c in zip(reversed(part), reversed(own)):
                if c:
                    number, k = divmod(number, len(c))
                    chars.append(c[k])
                else:
                    chars.append(x)
            out.append("".join(reversed(chars)))
        return "".join(out)

    def _email(self, value: str, back: bool) -> str:
        local, _, domain = value.rpartition("@")
        return f"{self._by_class(local, 'email|' + domain.lower(), back)}@{domain}"

    def _secret(self, value: str, back: bool) -> str | None:
        head = re.match(r".*?[:=]\s*[\"']?", value, re.S).group()
        body = value[len(head) :]
        if not any(c.isdigit() for c in body):
            return None
        of_hex = lambda x: all(c in _HEX for c in x)
        classes, own = ((_HEX,), lambda x: any(c.isdigit() for c in x)) if of_hex(body) else (_CLASSES, lambda x: not of_hex(x))
        # Walked until the form by which the inverse tells the two kinds, as a permutation allows.
        new = self._by_class(body, "secret", back, classes)
        while not own(new):
            new = self._by_class(new, "secret", back, classes)
        return head + new

    def _card(self, value: str, back: bool) -> str | None:
        digits = re.sub(r"\D", "", value)
        if luhn_digit(digits[:-1]) != digits[-1] or not digits.strip("0"):
            return None
        body = self._digits(digits[:-1], "card", back)
        while not body.strip("0"):  # no card, so the inverse wouldn't know it
            body = self._digits(body, "card", back)
        return self._refill(value, body + luhn_digit(body))

    def _iban(self, value: str, back: bool) -> str | None:
        flat = value.replace(" ", "")
        if not 15 <= len(flat) <= 34 or iban_rest(flat[4:] + flat[:4]) != 1:
            return None
        body = self._by_class(flat[4:], "iban|" + flat[:2], back, _CLASSES[1:])
        check = 98 - iban_rest(body + flat[:2] + "00")
        chars = iter(flat[:2] + f"{check:02d}" + body)
        return "".join(c if c == " " else next(chars) for c in value)

    def _phone(self, value: str, back: bool) -> str | None:
        prefix = re.match(r"\+\d{1,3}", value)
        head = prefix.group() if prefix else ""
        digits = re.sub(r"\D", "", value[len(head) :])
        if not 6 <= len(digits) <= 14:
            return None
        return head + self._refill(value[len(head) :], self._digits(digits, "phone|" + head, back))

    def _ssn(self, value: str, back: bool) -> str | None:
        digits = value.replace("-", "")
        if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000":
            return None
        area = [a for a in range(1, 900) if a != 666]
        x = (area.index(int(digits[:3])) * 99 + int(digits[3:5]) - 1) * 9999 + int(digits[5:]) - 1
        x = self.feistel.permute(x, len(area) * 99 * 9999, "ssn", back)
        x, serial = divmod(x, 9999)
        x, group = divmod(x, 99)
        return f"{area[x]:03d}-{group + 1:02d}-{serial + 1:04d}"

    def _ip(self, value: str, back: bool) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        x = self.feistel.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip", back)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _date(self, value: str, back: bool) -> str | None:
        shape = "%Y-%m-%d" if value[4] == "-" else "%d/%m/%Y" if value[2] == "/" else "%d.%m.%Y"
        try:
            day = (datetime.datetime.strptime(value, shape).date() - _DAY0).days
        except ValueError:
            return self._month_first(value, back) if value[2] == "/" else None
        if not 0 <= day < _DAYS:
            return None
        return (_DAY0 + datetime.timedelta(self.feistel.permute(day, _DAYS, "date", back))).strftime(shape)


    def _month_first(self, value: str, back: bool) -> str | None:
        """A date that only reads month first: the months, days from 13 on and years are numbered and permuted."""
        try:
            date = datetime.datetime.strptime(value, "%m/%d/%Y").date()
        except ValueError:
            return None
        days = _late_days()
        if date not in days[1]:
            return None
        return days[0][self.feistel.permute(days[1][date], len(days[0]), "date|month first", back)].strftime("%m/%d/%Y")


@lru_cache(maxsize=1)
def _late_days() -> tuple[list, dict]:
    """The dates after the 12th of their month, in order, and their numbers."""
    late = [d for k in range(_DAYS) if (d := _DAY0 + datetime.timedelta(k)).day > 12]
    return late, {d: k for k, d in enumerate(late)}


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


@lru_cache(maxsize=4)
def _pseudonyms(key: bytes, rounds: int) -> tuple[Pseudonyms, re.Pattern, re.Pattern]:
    return Pseudonyms(key, rounds), find_values(), re.compile("[0-9@]|[:=]")


def pseudonymise_text(text: str, key: bytes, rounds: int = ROUNDS, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with its valid values swapped, and how many of each kind were."""
    maps, values, hint = _pseudonyms(key, rounds)
    counts: dict[str, int] = {}
    if not hint.search(text):
        return text, counts

    def one(m: re.Match) -> str:
        kind = m.lastgroup if m.lastgroup != "gap" else "card"
        out = maps.swap(kind, m[0], back)
        if out is None:
            return m[0]
        counts[kind] = counts.get(kind, 0) + 1
        return out

    return values.sub(one, text), counts


def pseudonymise(docs: DataFrame, *, key: bytes, text_col: str = "text", rounds: int = ROUNDS, counts: bool = True) -> DataFrame:
    """docs with the text rewritten; with counts also n_pseudonyms and n_<kind>."""
    added = ["n_pseudonyms", *(f"n_{k}" for k in KINDS)] if counts else []
    kept = without(docs, *added).withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    schema = T.StructType([*kept.schema, *(T.StructField(a, T.LongType()) for a in added)])
    at = next(k for k, c in enumerate(kept.columns) if c.lower() == text_col.lower())

    def run(batches):
        for b in batches:
            done = [(None, {}) if not t.is_valid else pseudonymise_text(t.as_py(), key, rounds) for t in b.column(at)]
            cols = list(b.columns)
            cols[at] = pa.array([x for x, _ in done], b.column(at).type)
            if counts:
                cols += [pa.array([sum(c.values()) for _, c in done], pa.int64()), *(pa.array([c.get(k, 0) for _, c in done], pa.int64()) for k in KINDS)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return kept.mapInArrow(run, schema)
