"""Format-preserving pseudonyms for personal data.

Card numbers, account numbers, social security numbers, telephone numbers, network addresses and dates are found by
pattern and validated by their own rules (check digits, ranges, calendar). A value is then numbered within the set of
all valid values of its format, that number is permuted by a keyed Feistel network, and the value of the new number
takes its place. So a pseudonym is valid again, equal values get equal pseudonyms in every document and whatever the
layout that they are written in, and only who has the key can turn them back. Letters and digits of e-mail addresses and of secrets that are
given as such are permuted in the same way within their alphabets.

Layouts stay, but for what a pseudonym can't show: IPv6 addresses come out with all eight groups, days and months below 10 without a
zero where one of the two had none, and month names in the length of the value's own. There the value can be turned back, not its spelling.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Memo, exact

ROUNDS, MEMO_VALUES = 8, 100_000
#: Characters of a secret that are permuted together at most.
SECRET_BLOCK = 512
#: Dates that are permuted among themselves, first and last.
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


class Feistel:
    """Keyed permutations of range(n): a Feistel network over the next even number of bits, walked until it is below n."""

    def __init__(self, key: bytes):
        if not 16 <= len(key) <= 64:
            raise ValueError("a key has 16 to 64 bytes")
        self.key = key

    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        out, block = b"", 0
        while len(out) < size:
            out += hashlib.blake2b(b"%d|%d|%d|%s|" % (i, block, bits, tweak) + half.to_bytes(size, "big"), key=self.key).digest()
            block += 1
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        if not 0 <= x < n:
            raise ValueError("outside the domain")
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        mask, t = (1 << bits) - 1, f"{tweak}|{n}".encode()
        while True:
            left, right = x >> bits, x & mask
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    left, right = right ^ self._round(t, i, left, bits), left
                else:
                    left, right = right, left ^ self._round(t, i, right, bits)
            x = left << bits | right
            if x < n:
                return x


def luhn(digits: str) -> int:
    """The sum whose last digit is 0 for a valid number."""
    return sum(int(c) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for i, c in enumerate(reversed(digits)))


def relaid(value: str, digits: str) -> str:
    """value with its digits replaced in turn by others, and everything between them kept."""
    it = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(it), value)


def only(value: str) -> str:
    return re.sub(r"[^0-9]", "", value)


class Pseudonyms:
    """Finds personal data in a text and replaces it; with back=True turns pseudonyms into the values again."""

    def __init__(self, key: bytes, back: bool = False):
        self.net, self.back = Feistel(key), back
        self.known = Memo(lambda kv: getattr(self, kv[0])(kv[1]), MEMO_VALUES)

    def _p(self, x: int, n: int, tweak: str) -> int:
        return self.net.permute(x, n, tweak, self.back)

    def _digits(self, digits: str, tweak: str) -> str:
        return str(self._p(int(digits), 10 ** len(digits), tweak)).zfill(len(digits))

    # Each takes what its pattern found and returns the pseudonym, or None if the value isn't valid.

    def card(self, v: str) -> str | None:
        """13 to 19 digits with a right check digit, which the pseudonym has too."""
        d = only(v)
        if not 13 <= len(d) <= 19 or luhn(d) % 10 or len(set(d)) == 1:
            return None
        while True:  # values of one repeated digit are no card numbers, so they are walked past
            body = self._digits(d[:-1], "card")
            d = body + str(-luhn(body + "0") % 10)
            if len(set(d)) > 1:
                return relaid(v, d)

    def iban(self, v: str) -> str | None:
        """Country, check digits by 97, and the account: letters stay letters, digits stay digits."""
        s = v.replace(" ", "")
        number = lambda x: int("".join(str(int(c, 36)) for c in x))
        if not 15 <= len(s) <= 34 or number(s[4:] + s[:4]) % 97 != 1:
            return None
        body = self._alphabet(s[4:], "iban" + s[:2])
        s = s[:2] + str(98 - number(body + s[:2] + "00") % 97).zfill(2) + body
        it = iter(s)
        return "".join(c if c == " " else next(it) for c in v)

    def ssn(self, v: str) -> str | None:
        """Area not 000, 666 or from 900; group not 00; serial not 0000."""
        area, group, serial = int(v[:3]), int(v[4:6]), int(v[7:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(self._p(x, 898 * 99 * 9999, "ssn"), 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    @staticmethod
    def _american(d: str) -> bool:
        """Whether ten digits are a number of the North American plan: neither area nor exchange begins with 0 or 1."""
        return d[0] > "1" and d[3] > "1"

    def _ten(self, d: str) -> str:
        """Ten digits after the country code 1; valid ones are permuted among themselves, as are the others."""
        valid, x = self._american(d), d
        while True:
            x = self._digits(x, "phone1")
            if self._american(x) == valid:
                return x

    def phone(self, v: str) -> str | None:
        """An international number of 8 to 15 digits: the first digit stays, the rest is permuted."""
        d = only(v)
        if not 8 <= len(d) <= 15:
            return None
        return relaid(v, d[0] + (self._ten(d[1:]) if d[0] == "1" and len(d) == 11 else self._digits(d[1:], "phone" + d[0])))

    def local_phone(self, v: str) -> str | None:
        """A number without its country: three, three and four digits of the North American plan, the same as behind +1; or 9 to 12 digits from 0 on, which stays."""
        d = only(v)
        if d[0] == "0":
            if not 9 <= len(d) <= 12:
                return None
            n = len(d) - 2
            return relaid(v, "0" + str(self._p(int(d[1:]) - 10**n, 9 * 10**n, "trunk") + 10**n))
        lead = d[:-10]
        return relaid(v, lead + self._ten(d[-10:])) if self._american(d[-10:]) else None

    def ip(self, v: str) -> str | None:
        parts = v.split(".")
        if any(int(x) > 255 or x != str(int(x)) for x in parts):
            return None
        x = self._p(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
        return ".".join(map(str, x.to_bytes(4, "big")))

    def ip6(self, v: str) -> str | None:
        """A valid address of at least three groups that are given; the pseudonym has all eight."""
        groups = [x for x in v.split(":") if x]
        try:
            x = int(ipaddress.IPv6Address(v))
        except ValueError:
            return None
        if len(groups) < 3:
            return None
        x = f"{self._p(x, 1 << 128, 'ip6'):032x}"
        out = ":".join(x[i : i + 4].lstrip("0") or "0" for i in range(0, 32, 4))
        return out.upper() if v != v.lower() else out

    def _day(self, y: int, m: int, d: int) -> tuple[int, int, int] | None:
        """The pseudonym of a date, one for all layouts. Days after the 12th, by which a layout shows which part is the day, are permuted among themselves, as are the others."""
        try:
            x = date(y, m, d).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= x <= LAST_DAY:
            return None
        while True:
            x = FIRST_DAY + self._p(x - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date")
            out = date.fromordinal(x)
            if (out.day > 12) == (d > 12):
                return out.year, out.month, out.day

    def iso_date(self, v: str) -> str | None:
        y, m, d = re.split("[-/.]", v)
        out, wide = self._day(int(y), int(m), int(d)), 2 if len(m) == len(d) == 2 else 1
        return out and f"{out[0]:04d}{v[4]}{out[1]:0{wide}d}{v[4]}{out[2]:0{wide}d}"

    def short_date(self, v: str) -> str | None:
        """Day and month in some order, then the year: the month first after a slash unless it is over 12, else the day."""
        a, b, y = re.split("[-/.]", v)
        sep, wide, month_first = v[len(a)], 2 if len(a) == len(b) == 2 else 1, v[len(a)] == "/" and int(a) <= 12
        out = self._day(int(y), *((int(a), int(b)) if month_first else (int(b), int(a))))
        if not out:
            return None
        first, second = (out[1], out[2]) if month_first else (out[2], out[1])
        return f"{first:0{wide}d}{sep}{second:0{wide}d}{sep}{out[0]:04d}"

    def long_date(self, v: str) -> str | None:
        """Month by its English name, whole or its first three letters; an ordinal's ending follows the day."""
        name = re.search("[A-Za-z]{3,}", re.sub(r"(?<=[0-9])(?:st|nd|rd|th)|\bof\b", "", v)).group()
        month = [m[:3].lower() for m in MONTHS].index(name[:3].lower()) + 1
        day, year = re.findall("[0-9]+", v)
        out = self._day(int(year), month, int(day))
        if not out:
            return None
        new = MONTHS[out[1] - 1] if len(name) > 3 or name.lower() == "may" else MONTHS[out[1] - 1][:3]
        new = new.upper() if name.isupper() else new.lower() if name.islower() else new
        ends = "th" if 11 <= out[2] <= 13 else {1: "st", 2: "nd", 3: "rd"}.get(out[2] % 10, "th")
        put = iter((f"{out[2]:0{len(day) if day[0] == '0' else 1}d}", str(out[0])))
        out_ = re.sub(rf"\b{name}\b|[0-9]+", lambda x: new if x.group()[0].isalpha() else next(put), v)
        return re.sub("(?<=[0-9])(?:st|nd|rd|th)", ends, out_)

    def _alphabet(self, v: str, tweak: str) -> str:
        """Digits, small letters and capitals permuted together, each place within its own alphabet."""
        x, n, sets = 0, 1, []
        for c in v:
            of = next((a for a in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in a), c)
            sets.append(of)
            x, n = x * len(of) + of.index(c), n * len(of)
        x, out = self._p(x, n, tweak) if n > 1 else 0, []
        for of in reversed(sets):
            x, k = divmod(x, len(of))
            out.append(of[k])
        return "".join(reversed(out))

    def _pieces(self, v: str, tweak: str, one: Callable[[str, str], str]) -> str:
        """v in blocks of about equal length, so that none is a short rest."""
        n, out = -(-len(v) // SECRET_BLOCK), ""
        for i in range(n):
            out += one(v[len(v) * i // n : len(v) * (i + 1) // n], tweak + str(i) * (i > 0))
        return out

    def email(self, v: str) -> str | None:
        """The part before the at sign and every label of the domain but the last; case doesn't part equal addresses' owners."""
        user, _, host = v.partition("@")
        *labels, top = host.split(".")
        return self._pieces(user, "user", self._alphabet) + "@" + ".".join([*(self._alphabet(x, "host") for x in labels), top])

    def secret(self, v: str) -> str | None:
        name, value = re.fullmatch(SECRET, v, re.I).groups()
        if not re.fullmatch("[0-9a-f]+|[0-9A-F]+", value):
            return name + self._pieces(value, "secret", self._alphabet)
        out = self._pieces(value, "hex", lambda x, t: f"{self._p(int(x, 16), 16 ** len(x), t):x}".zfill(len(x)))
        return name + (out.upper() if value != value.lower() else out)

    def replace(self, text: str | None) -> tuple[str | None, dict[str, int]]:
        counts: dict[str, int] = {}
        if not text or not CANDIDATE.search(text):
            return text, counts

        def one(m: re.Match) -> str:
            v, kind = m.group(), m.lastgroup
            out = self.known[kind, v]
            if out is None:
                return v
            counts[kind] = counts.get(kind, 0) + 1
            return out

        return FOUND.sub(one, text), counts


SECRET = r"""((?:[a-z0-9]+[_-])?(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\x20\t]*[=:][\x20\t]*["']?)([A-Za-z0-9+/_=-]{16,})"""
_MONTH = "|".join(m if len(m) == 3 else f"{m[:3]}(?:{m[3:]})?" for m in MONTHS)
KINDS = {
    "secret": rf"(?<![A-Za-z0-9_-])(?i:{SECRET.replace('((?:[a', '(?:(?:[a', 1).replace(')([A-Za', ')(?:[A-Za', 1)})",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "ip6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{0,4}:)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:]|\.[0-9])",
    "iso_date": r"(?<![0-9A-Za-z/.-])[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}(?![0-9]|[/.-][0-9])",
    "short_date": r"(?<![0-9A-Za-z/.-])[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4}(?![0-9]|[/.-][0-9])",
    "long_date": rf"(?<![0-9A-Za-z])(?:(?i:{_MONTH})\.?\x20[0-9]{{1,2}}(?:st|nd|rd|th)?,?|[0-9]{{1,2}}(?:st|nd|rd|th)?\x20(?:of\x20)?(?i:{_MONTH})\.?,?)\x20[0-9]{{4}}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+])\+(?:1[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}|[1-9](?:[\x20.-]?\(?[0-9]{1,4}\)?){2,7})(?![0-9])",
    "local_phone": r"(?<![0-9A-Za-z+./-])(?<![0-9][\x20.-])(?:(?:1[\x20.-])?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}|\(?0[1-9][0-9]{1,4}\)?[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,5})(?![0-9A-Za-z]|[\x20.-][0-9])",
    "card": r"(?<![0-9A-Za-z+])(?<![0-9][.-])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){2}(?:[\x20-][0-9]{4}(?:[\x20-][0-9]{3})?|[\x20-][0-9]{1,3})|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9A-Za-z])",
}
#: Every pattern needs one of these, so a text without is passed over at once.
CANDIDATE = re.compile(r"[0-9@=:]")


def _joined() -> re.Pattern:
    parts = []
    for kind, p in KINDS.items():
        # Group numbers run over the whole alternation, so a pattern's own reference goes by name.
        own = re.sub(r"\\[12]", lambda _: rf"(?P=sep_{kind})", p).replace("([-/.])", rf"(?P<sep_{kind}>[-/.])")
        parts.append(f"(?P<{kind}>{own})")
    return re.compile("|".join(parts))


FOUND = _joined()


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", counts: str | None = None, back: bool = False) -> DataFrame:
    """docs with the personal data in every whole text replaced; all columns stay, in their order and type.

    counts names a column map<string,int> to add, which has the number of values replaced of each kind. A null
    text stays null and an empty one empty; repeated rows get equal texts; a table without rows stays one. Equal
    values of a kind get equal pseudonyms wherever they stand, as the key alone decides. What looks like a number of a
    kind but isn't valid stays as it is.
    """
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, *([T.StructField(counts, T.MapType(T.StringType(), T.IntegerType()))] if counts else [])])

    def run(batches):
        p = Pseudonyms(key, back)
        for batch in batches:
            found = [p.replace(x) for x in batch.column(at).to_pylist()]
            cols = list(batch.columns)
            cols[at] = pa.array([x[0] for x in found], batch.schema.types[at])
            names = list(batch.schema.names)
            if counts:
                cols.append(pa.array([list(x[1].items()) for x in found], pa.map_(pa.string(), pa.int32())))
                names.append(counts)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, schema)
