"""Format-preserving pseudonyms: validated numbers and dates are permuted within their format by a keyed Feistel network.

A value is read as a number below the size of its domain (all card numbers of 16 digits, all days of four
centuries, ...), permuted, and written in the form in which it was found, with the same separators and valid check
digits. What is permuted is the value and not its form: a date, a phone number or an address that is written in several
ways goes to one and the same value, in each of these ways. The permutation depends on the key, the kind and the domain
only, so equal values stay equal in all documents, whatever task reads them, and the holder of the key can go back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache, partial
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROUNDS = 10


class Feistel:
    """A keyed permutation of the numbers below any size."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def _round(self, tweak: bytes, turn: int, half: int, width: int) -> int:
        data = turn.to_bytes(1, "big") + half.to_bytes((width + 7) // 8, "big") + tweak
        return int.from_bytes(blake2b(data, key=self.key, digest_size=max(8, (width + 7) // 8)).digest(), "big") & ((1 << width) - 1)

    def _once(self, x: int, width: int, tweak: bytes, back: bool) -> int:
        mask = (1 << width) - 1
        left, right = x >> width, x & mask
        for turn in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(tweak, turn, left, width), left
            else:
                left, right = right, left ^ self._round(tweak, turn, right, width)
        return left << width | right

    def permute(self, x: int, size: int, tweak: bytes, fits: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        """Where x, below size and fitting, goes among such numbers: the network is applied until the result is one."""
        width = max(1, ((size - 1).bit_length() + 1) // 2)
        tweak = tweak + size.to_bytes((size.bit_length() + 7) // 8, "big")
        while True:
            x = self._once(x, width, tweak, back)
            if x < size and fits(x):
                return x


def luhn(digits: str) -> int:
    """The sum of the Luhn check, modulo 10; 0 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


#: Country codes of one and of two digits (ITU E.164); all others have three. Fixed values.
ONE_DIGIT = "1 7".split()
TWO_DIGITS = "20 27 28 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 83 84 86 89 90 91 92 93 94 95 98".split()


def country_code(digits: str) -> str:
    return digits[: 1 if digits[:1] in ONE_DIGIT else 2 if digits[:2] in TWO_DIGITS else 3]


def _fill(form: str, digits: str) -> str:
    """form with its digits replaced one by one."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


_FIRST, _LAST = date(1800, 1, 1), date(2199, 12, 31)
_DAYS = (_LAST - _FIRST).days + 1

#: Kinds in order of precedence. Fixed values.
_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}(?P<sep>[./-])[0-9]{1,2}(?P=sep)[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS.items()))
KINDS = tuple(_PATTERNS)


def prefixes(kind: str, value: str) -> list[str]:
    """What a match may stand for, in the order tried: patterns are greedy, and what follows a number (a CVV, a currency, a year) may look like its next group.

    For the way back, the choice must be the same for the result. A phone's validity follows from its form alone, so its longest
    prefix is best. With check digits, a prefix may be valid by chance; the shortest valid one counts, so that the choice depends
    on the value and not on what follows it, and _move keeps to values that have no valid shorter prefix.
    """
    if kind == "phone":
        return [value[: m.end()] for m in re.finditer(r"[0-9)](?=[ .-]|\Z)", value)][::-1]
    if kind == "card":
        return [p for m in re.finditer(r"[0-9]{3}(?=[ -])|\Z", value) if len(re.sub("[ -]", "", p := value[: m.end()])) >= 13]
    if kind == "iban":
        return [p for m in re.finditer(r"(?= )|\Z", value) if len((p := value[: m.end()]).replace(" ", "")) >= 15]
    return [value]


class Pseudonyms:
    """Replacements of found values, by kind; None for a value that isn't valid. back=True undoes them."""

    def __init__(self, key: bytes, back: bool = False) -> None:
        self.cipher, self.back = Feistel(key), back
        self.of = lru_cache(1 << 14)(self._of)

    def _of(self, kind: str, value: str) -> tuple[str, int] | None:
        """The replacement of the first valid one of the value's prefixes, and that one's length."""
        for own in prefixes(kind, value):
            new = getattr(self, f"_{kind}")(own)
            if new is not None:
                return new, len(own)
        return None

    def _move(self, x: int, size: int, tweak: str, fits: Callable[[int], bool] = lambda _: True) -> int:
        return self.cipher.permute(x, size, tweak.encode(), fits, self.back)

    def _digits(self, digits: str, kind: str, fits: Callable[[str], bool] = lambda _: True) -> str:
        n = len(digits)
        return f"{self._move(int(digits), 10**n, kind, lambda x: fits(f'{x:0{n}d}')):0{n}d}"

    def _card(self, value: str) -> str | None:
        digits = re.sub("[ -]", "", value)
        if luhn(digits) or digits[0] == "0":
            return None
        shorter = [len(re.sub("[ -]", "", p)) for p in prefixes("card", value)[:-1]]
        body = self._digits(digits[:-1], "card", lambda s: s[0] != "0" and all(luhn(s[:n]) for n in shorter))
        return _fill(value, body + str(-luhn(body + "0") % 10))

    def _phone(self, value: str) -> str | None:
        """The national number is permuted; the country's code stays, and so does a trunk zero in brackets after it."""
        digits = re.sub("[^0-9]", "", value)
        n = len(country_code(digits)) if value.startswith("+") else 0
        trunk = re.match(r"\+[0-9]{1,3}[ .-]?\(0\)", value)
        if trunk and n == len(re.sub("[^0-9]", "", trunk[0])) - 1:
            n += 1
        own = digits[n:]
        american = not value.startswith("+") or digits[:n] == "1"
        if not 8 <= len(digits) + 1 - bool(n) <= 15 or len(own) < 6 or american and len(own) != 10:
            return None
        # Numbers that aren't assigned (an area code 017, a trunk zero) are replaced too, by others of their class.
        kind = (lambda s: (s[0] > "1", s[3] > "1")) if american else (lambda s: s[0] != "0")
        if value[0].isdigit() and kind(own) != (True, True):  # neither + nor brackets: only the digits tell that it is a phone
            return None
        code = "1" if american else country_code(digits)
        return _fill(value, digits[:n] + self._digits(own, "phone" + code, lambda s: kind(s) == kind(own)))

    def _ssn(self, value: str) -> str | None:
        def fits(s: str) -> bool:
            return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"

        digits = value.replace("-", "")
        return _fill(value, self._digits(digits, "ssn", fits)) if fits(digits) else None

    def _ipv4(self, value: str) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
            return None
        x = self._move(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ipv4")
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        digits = re.sub("[^0-9]", "", plain[4:])
        if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1 or not digits:
            return None
        shorter = [len(p.replace(" ", "")) for p in prefixes("iban", value)[:-1]]

        def whole(s: str) -> str:
            body = _fill(plain[4:], s)
            return plain[:2] + f"{98 - iban_rest(plain[:2] + '00' + body):02d}" + body

        it = iter(whole(self._digits(digits, "iban" + re.sub("[0-9]", "0", plain[:2] + plain[4:]), lambda s: all(iban_rest(whole(s)[:n]) != 1 for n in shorter))))
        return "".join(c if c == " " else next(it) for c in value)

    def _date(self, value: str) -> str | None:
        """Year first, or day and month in the order that is valid, day first if both are.

        A day goes to one of its class: with as many digits in its day and month, and, as a month before a day can be told
        from the reverse only then, on the same side of the 12th. So the result has the form of the value, whatever that is.
        """
        parts = re.split("[./-]", value)
        for order in ["ymd"] if len(parts[0]) == 4 else ["dmy", "mdy"]:
            part = dict(zip(order, map(int, parts)))
            try:
                day = date(part["y"], part["m"], part["d"])
            except ValueError:
                continue
            if not _FIRST <= day <= _LAST:
                continue
            kind = lambda d: (d.day > 9, d.day > 12, d.month > 9)
            new = _FIRST + timedelta(days=self._move((day - _FIRST).days, _DAYS, "date", lambda x: kind(_FIRST + timedelta(days=x)) == kind(day)))
            own = dict(y=new.year, m=new.month, d=new.day)
            return _fill(value, "".join(f"{own[k]:0{len(p)}d}" for k, p in zip(order, parts)))
        return None

    def _email(self, value: str) -> str | None:
        """Letters and digits of the local part, each within its class; capitals stay where they are, and so does the domain."""
        local, _, domain = value.rpartition("@")
        digits, letters = "0123456789", "abcdefghijklmnopqrstuvwxyz"
        classes = [digits if c in digits else letters if c in letters else c for c in local.lower()]
        size, x = 1, 0
        for c, own in zip(local.lower(), classes):
            size, x = size * len(own), x * len(own) + own.index(c)
        if size == 1:
            return None
        x, out = self._move(x, size, "email" + "".join(k[0] for k in classes)), []
        for own in reversed(classes):
            x, at = divmod(x, len(own))
            out.append(own[at])
        return "".join(n.upper() if c.isupper() else n for n, c in zip(reversed(out), local)) + "@" + domain

    def text(self, text: str) -> tuple[str, list[str]]:
        """The text with its valid values replaced, and their kinds."""
        kinds: list[str] = []
        out, done, at = [], 0, 0
        while found := PATTERN.search(text, at):
            kind = next(k for k in KINDS if found[k] is not None)
            new = self.of(kind, found[0])
            at = found.end() if new is None else found.start() + new[1]
            if new is not None:
                kinds.append(kind)
                out += [text[done : found.start()], new[0]]
                done = at
        return "".join([*out, text[done:]]), kinds


_HINT = re.compile("[0-9@]")


def _replace(batches: Iterator[pa.RecordBatch], key: bytes, back: bool) -> Iterator[pa.RecordBatch]:
    own = Pseudonyms(key, back)
    for batch in batches:
        new, n, kinds = [], [], []
        for text in batch.column("text"):
            text = text.as_py()
            found: list[str] = []
            if text and _HINT.search(text):
                text, found = own.text(text)
            new.append(text)
            n.append(len(found))
            kinds.append(sorted(set(found)))
        columns = [pa.array(new, pa.string()) if name == "text" else batch.column(name) for name in batch.schema.names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(kinds, pa.list_(pa.string()))], names=[*batch.schema.names, "n_replaced", "kinds"])


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """docs with the personal values of text replaced, and n_replaced and kinds (sorted array) of what was.

    Replaced are card numbers with a right Luhn digit, phone numbers, social security numbers, IBANs with a right check,
    IPv4 addresses, dates from 1800 to 2199, and the local parts of e-mail addresses. A number that fails its check stays
    as it is, and so does a phone number with neither + nor brackets whose area code or exchange can't exist. Equal values
    get equal pseudonyms in whatever form they stand: dates in any order and with any separators or padding, phone numbers
    with or without +1, brackets or a trunk zero, cards and IBANs in groups or not, addresses in any case. Groups
    that follow a card or IBAN in one run stay if it is valid without them, those that follow a phone number if it is valid only
    without them. Digits right before a card are read as part of it, so that it may be missed. back=True gives the original again, if run on a result with the same key. Each row is treated alone, so
    ties and repeated rows don't matter; a null text stays null, an empty one empty; all other columns are kept, but for
    columns named n_replaced or kinds, which are replaced. An empty table gives an empty one.
    """
    docs = docs.drop("n_replaced", "kinds")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_replaced", T.LongType()), T.StructField("kinds", T.ArrayType(T.StringType()))])
    return docs.mapInArrow(partial(_replace, key=key, back=back), schema)
