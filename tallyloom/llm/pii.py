"""Format-preserving pseudonyms for personal data.

Values are found by pattern and kept only if they validate: card numbers by the Luhn sum, bank account
numbers by their remainder of 97, IPv4 addresses by their parts, dates by the calendar, US social
security numbers by their ranges, phone numbers by their length and signs, e-mail addresses by their form.
A value is turned into a number within its format (all cards of 16 digits, all days of two centuries, all
local parts with letters and digits in the same places, ...), permuted there by a keyed Feistel network
with cycle walking, and written back in the same format, check digits included.  The permutation depends
on key and format alone: equal values get equal pseudonyms in all documents, different ones stay different.

Nothing is gathered or shuffled: each row is rewritten in its task.

Values may stand beside other numbers or upper-case words, so cards, accounts and phones are tried from every
group of digits and to every end that their formats allow: cards in the lengths and groups of their scheme,
accounts in the length of their country, phones in the lengths of their country or with one kind of sign.
Values of certain form are taken first, then phones of known length, then cards in odd groups, then other
phones, each from what is left.  A phone of no known length takes in a further number that the same sign joins.

Edge cases: a null text stays null and has no values, an empty one none; an empty table gives none; very long texts cost time in
proportion and come in batches bounded in bytes; a column ``pii`` of the input is replaced, all others stay; values that do not validate stay as they are; of
overlapping values of one such step the one that begins first is taken, then the kind listed first; repeated
rows give repeated results.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import hidden, small_batches, table

ROUNDS = 8
#: The query takes its key from this setting of the session; only where it is unset, as on test tables, from the example, which
#: protects nothing.  ``pseudonymize`` has no default.
KEY_SETTING = "spark.tallyloom.pii.key"
EXAMPLE_KEY = b"tallyloom example key"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: Most pseudonyms that a worker remembers.
MAX_KNOWN = 200_000

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CLASS = {c: s for s in (_DIGITS, _LOWER, _UPPER) for c in s}


class Permuter:
    """A keyed permutation of range(size) for every (kind, size)."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def __call__(self, value: int, size: int, kind: str) -> int:
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask, octets = (1 << half) - 1, (half + 7) // 8
        prefix = f"{kind}/{size}/".encode()
        while True:
            left, right = value >> half, value & mask
            for r in range(ROUNDS):
                data = prefix + bytes([r]) + right.to_bytes(octets, "big")
                left, right = right, left ^ int.from_bytes(self._stream(data, octets), "big") & mask
            value = left << half | right
            if value < size:  # else walk on along the cycle, which ends within the range
                return value

    def _stream(self, data: bytes, octets: int) -> bytes:
        out = b""
        while len(out) < octets:
            out += hashlib.blake2b(data + len(out).to_bytes(4, "big"), digest_size=min(64, octets), key=self.key).digest()
        return out[:octets]

    def letters(self, text: str, kind: str) -> str:
        """Permutes the ASCII letters and digits of a text, each within its class; the rest stays."""
        value, size = 0, 1
        for c in text:
            if c in _CLASS:
                value, size = value * len(_CLASS[c]) + _CLASS[c].index(c), size * len(_CLASS[c])
        if size == 1:
            return text
        value = self(value, size, f"{kind}/{''.join(_CLASS[c][0] for c in text if c in _CLASS)}")
        out = []
        for c in reversed(text):
            if c in _CLASS:
                value, at = divmod(value, len(_CLASS[c]))
                c = _CLASS[c][at]
            out.append(c)
        return "".join(reversed(out))


def refill(template: str, digits: str) -> str:
    """``template`` with its ASCII digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in _DIGITS else c for c in template)


def luhn_sum(digits: str) -> int:
    d = [int(c) for c in reversed(digits)]
    return sum(d[0::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])


def _card(value: str, p: Permuter) -> str | None:
    digits = re.sub(r"\D", "", value)
    if luhn_sum(digits) % 10 or len(set(digits)) == 1:
        return None
    body = p.letters(digits[:-1], "card")
    return refill(value, body + str(-luhn_sum(body + "0") % 10))


def _account_rest(country: str, rest: str) -> int:
    return int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _account(value: str, p: Permuter) -> str | None:
    plain = value.replace(" ", "")
    if len(plain) < 15 or int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
        return None
    rest = p.letters(plain[4:], f"account{plain[:2]}")
    new = iter(f"{plain[:2]}{98 - _account_rest(plain[:2], rest):02d}{rest}")
    return "".join(c if c == " " else next(new) for c in value)


def _address(value: str, p: Permuter) -> str | None:
    parts = value.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    n = p(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
    return ".".join(map(str, n.to_bytes(4, "big")))


def _date(value: str, p: Permuter) -> str | None:
    a, sign, b, c = re.fullmatch(r"(\d+)([-/.])(\d+)[-/.](\d+)", value).groups()
    # year first; else day first where both could be; else month first
    for year, month, day, order in ((a, b, c, "ymd"), (c, b, a, "dmy"), (c, a, b, "mdy")):
        try:
            if len(year) == 4 and FIRST_DAY <= (n := datetime.date(int(year), int(month), int(day)).toordinal()) <= LAST_DAY:
                break
        except ValueError:
            pass
    else:
        return None
    new = datetime.date.fromordinal(FIRST_DAY + p(n - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date"))
    return sign.join({"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}[k] for k in order)


def _social(value: str, p: Permuter) -> str | None:
    area, group, serial = (int(value[i:j]) for i, j in ((0, 3), (4, 6), (7, 11)))
    areas = [x for x in range(1, 900) if x != 666]
    if area not in areas or not group or not serial:
        return None
    n = p((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, "social")
    n, serial = divmod(n, 9999)
    area, group = divmod(n, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(value: str, p: Permuter) -> str | None:
    digits = re.sub(r"\D", "", value)
    if not 9 <= len(digits) <= 15 or not (value[0] == "+" or re.search(r"\d[-. )]+\(?\d", value)):
        return None
    keep = 1 if value[0] == "+" else 0  # the first digit of a country code
    return refill(value, digits[:keep] + p.letters(digits[keep:], "phone"))


def _email(value: str, p: Permuter) -> str:
    local, _, domain = value.rpartition("@")
    return p.letters(local, "email") + "@" + domain


#: Kind -> (pattern, rewriter or None); patterns are fixed values.
KINDS: dict[str, tuple[str, Callable[[str, Permuter], str | None]]] = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),
    "account": (r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", _account),
    "ip": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)", _address),
    "date": (r"(?<![\w.-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?:(?=[Tt]\d{2}(?!\d))|(?![\w]|-\d))", _date),
    "social": (r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)", _social),
    "card": (r"(?<![\w])\d(?:[ -]?\d){12,18}(?![\w])", _card),
    "phone": (r"(?<![\w.])\+?\(?\d(?:[ .()-]{0,2}\d){8,14}(?![\w])", _phone),
}
_COMPILED = {k: re.compile(p, re.ASCII) for k, (p, _) in KINDS.items()}
_DIGIT_PAIR = re.compile(r"\d\D?\d", re.ASCII)

#: Lengths of account numbers by country.
ACCOUNT_LENGTHS = {
    **dict.fromkeys(["NO"], 15), **dict.fromkeys(["BE"], 16), **dict.fromkeys("DK FI FK FO GL NL SD".split(), 18), **dict.fromkeys("MK SI".split(), 19),
    **dict.fromkeys("AT BA EE KZ LT LU MN XK".split(), 20), **dict.fromkeys("CH HR LI LV".split(), 21), **dict.fromkeys("BG BH CR DE GB GE IE ME RS VA".split(), 22),
    **dict.fromkeys("AE GI IL IQ OM SO TL".split(), 23), **dict.fromkeys("AD CZ ES MD PK RO SA SE SK TN VG".split(), 24), **dict.fromkeys("LY PT ST".split(), 25),
    **dict.fromkeys("IS TR".split(), 26), **dict.fromkeys("BI DJ FR GR IT MC MR SM".split(), 27), **dict.fromkeys("AL AZ BY CY DO GT HN HU LB NI PL SV".split(), 28),
    **dict.fromkeys("BR EG PS QA UA".split(), 29), **dict.fromkeys("JO KW MU".split(), 30), **dict.fromkeys("MT SC".split(), 31), **dict.fromkeys(["LC"], 32), **dict.fromkeys(["RU"], 33),
}
#: Groups that cards are written in, and lengths by scheme, the usual one first.
CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 4, 4, 1), (6, 13)} | {(n,) for n in range(13, 20)}
CARD_LENGTHS = [(re.compile(p), n) for p, n in (("3[47]", (15,)), ("3(?:0|6|8|9)", (14, 16, 17, 18, 19)), ("35", (16, 17, 18, 19)), ("4", (16, 19, 13)), ("5[1-5]|2[2-7]", (16,)), ("6|5[06-8]", (16, 19, 18, 17, 15, 14, 13)))]
#: Digits of phones, country code included, where a country has but one length.
PHONE_LENGTHS = {"1": 11, "7": 11, "30": 12, "31": 11, "33": 11, "34": 11, "41": 11, "44": 12, "45": 10, "47": 10, "48": 11, "61": 11, "65": 10, "90": 12, "91": 12, "351": 12, "420": 12, "421": 12}

_CARD_RUN = re.compile(r"(?<!\w)\d+(?:[ -]\d+)*", re.ASCII)
_GROUP = re.compile(r"\d+", re.ASCII)
#: North American and French phones; the lengths of others with a country code are looked up.
_KNOWN_PHONE = re.compile(
    r"(?<![\w.])(?:(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}([ .-]))\d{3}[ .-]\d{4}|0[1-9](?:([ .-])\d{2})(?:\2\d{2}){3})(?![\w])|(?<![\w.])\+\d(?:[ .()-]{0,2}\d){8,14}(?![\w])", re.ASCII
)

Found = tuple[int, int, int, str, str]  # start, rank, end, kind, pseudonym


def card_ends(run: str, groups: list[tuple[int, int]], i: int, odd: bool) -> list[int]:
    """Ends within ``run`` of what may be a card from the i-th group on: the scheme's lengths in usual groups, or
    (``odd``) all lengths in any groups, longest first."""
    ends, shape, signs, n = {}, [], set(), 0
    for j in range(i, len(groups)):
        if j > i:
            signs.add(run[groups[j][0] - 1])
        shape.append(groups[j][1] - groups[j][0])
        n += shape[-1]
        if n > 19:
            break
        if n >= 13 and (odd or (len(signs) < 2 and tuple(shape) in CARD_GROUPS)):
            ends[n] = groups[j][1]
    if odd:
        return [ends[n] for n in sorted(ends, reverse=True)]
    if not ends:
        return []
    first = run[groups[i][0] : groups[i][1]]
    return [ends[n] for p, lengths in CARD_LENGTHS if p.match(first) for n in lengths if n in ends]


def phone_end(value: str) -> int:
    """Where the phone ends in ``value``, which may run on into a further number: at its country's length; else
    before a space that follows nine digits at least which other signs join."""
    digits, known = 0, None
    if value[0] == "+":
        plain = re.sub(r"\D", "", value)
        known = next((PHONE_LENGTHS[plain[:k]] for k in (1, 2, 3) if plain[:k] in PHONE_LENGTHS), None)
    sign = ""
    cut = len(value)
    for m in _GROUP.finditer(value):
        between = value[at : m.start()] if digits else ""
        if digits >= 9 and cut == len(value) and between == " " and sign in ("-", "."):
            cut = at
        digits, at, sign = digits + m.end() - m.start(), m.end(), between
        if digits == known:
            return at
    return cut


class Pseudonyms:
    def __init__(self, key: bytes):
        self.permuter = Permuter(key)
        self.known: dict[tuple[str, str], str | None] = {}

    def of(self, kind: str, value: str) -> str | None:
        """None if the value does not validate."""
        at = (kind, value)
        if at not in self.known:
            if len(self.known) >= MAX_KNOWN:
                self.known.clear()
            self.known[at] = KINDS[kind][1](value, self.permuter)
        return self.known[at]

    def rewrite(self, text: str | None) -> tuple[str | None, dict[str, int]]:
        counts = dict.fromkeys(KINDS, 0)
        if not text:
            return text, counts
        numbers = _DIGIT_PAIR.search(text) is not None
        steps = [self._certain, self._known_phones, self._odd_cards, self._phones] if numbers else [self._emails]
        rest, taken = text, []
        for step in steps:
            at, new = 0, []
            for found in sorted(step(rest)):
                if found[0] >= at:
                    new.append(found)
                    at = found[2]
            if new:
                taken += new
                parts, at = [], 0
                for start, _, end, _, _ in new:
                    parts += [rest[at:start], "\x00" * (end - start)]
                    at = end
                rest = "".join(parts) + rest[at:]
        if not taken:
            return text, counts
        out, at = [], 0
        for start, _, end, kind, new in sorted(taken):
            out += [text[at:start], new]
            at = end
            counts[kind] += 1
        return "".join(out) + text[at:], counts

    def _emails(self, text: str) -> list[Found]:
        return [(m.start(), 0, m.end(), "email", new) for m in _COMPILED["email"].finditer(text) if (new := self.of("email", m.group())) is not None] if "@" in text else []

    def _certain(self, text: str) -> list[Found]:
        found = self._emails(text) + self._accounts(text) + self._cards(text, False)
        for rank, (kind, pattern) in enumerate(_COMPILED.items()):
            if kind in ("ip", "date", "social"):
                found += [(m.start(), rank, m.end(), kind, new) for m in pattern.finditer(text) if (new := self.of(kind, m.group())) is not None]
        return found

    def _accounts(self, text: str) -> list[Found]:
        found, at = [], 0
        while m := _COMPILED["account"].search(text, at):
            at = m.start() + 1
            value, n, ends = m.group(), 0, {}
            for i, c in enumerate(value, 1):
                n += c != " "
                if c != " " and n >= 15 and not value[i : i + 1].isalnum():
                    ends[n] = i
            usual = ACCOUNT_LENGTHS.get(value[:2])
            for n in sorted(ends, key=lambda n: (n != usual, -n)):
                if (new := self.of("account", value[: ends[n]])) is not None:
                    found.append((m.start(), 1, m.start() + ends[n], "account", new))
                    at = m.start() + ends[n]
                    break
        return found

    def _cards(self, text: str, odd: bool) -> list[Found]:
        found = []
        for m in _CARD_RUN.finditer(text):
            run = m.group()
            if len(run) < 13:
                continue
            groups = [g.span() for g in _GROUP.finditer(run)]
            if m.end() < len(text) and (text[m.end()] == "_" or text[m.end()].isascii() and text[m.end()].isalnum()):
                groups.pop()  # part of a word
            i = 0
            while i < len(groups):
                start = groups[i][0]
                plus = i == 0 and m.start() > 0 and text[m.start() - 1] == "+"  # a phone, if not too long
                for end in card_ends(run, groups, i, odd):
                    if plus and end - start < 16:
                        continue
                    if (new := self.of("card", run[start:end])) is not None:
                        found.append((m.start() + start, 5, m.start() + end, "card", new))
                        i = next(j for j in range(i, len(groups)) if groups[j][1] == end)
                        break
                i += 1
        return found

    def _odd_cards(self, text: str) -> list[Found]:
        return self._cards(text, True)

    def _known_phones(self, text: str) -> list[Found]:
        return self._phones(text, _KNOWN_PHONE)

    def _phones(self, text: str, pattern: re.Pattern = _COMPILED["phone"]) -> list[Found]:
        found, at = [], 0
        while m := pattern.search(text, at):
            end = phone_end(m.group())
            new = self.of("phone", m.group()[:end])
            if new is None and end < len(m.group()):
                new, end = self.of("phone", m.group()), len(m.group())
            if new is not None:
                found.append((m.start(), 6, m.start() + end, "phone", new))
                at = m.start() + end
            else:  # from the next group of digits
                first = _GROUP.search(text, m.start())
                at = first.end()
        return found


def pseudonymize(docs: DataFrame, *, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with the text rewritten and ``pii``, a struct of counts by kind, in place of any such column."""
    small_batches(docs.sparkSession)
    schema = "text string, pii struct<" + ", ".join(f"{k}:bigint" for k in KINDS) + ">"

    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pseudonyms = Pseudonyms(key)
        for texts in batches:
            done = [pseudonyms.rewrite(t) for t in texts]
            yield pd.DataFrame({"text": pd.Series([d[0] for d in done], dtype=object), "pii": pd.Series([d[1] for d in done], dtype=object)})

    (name,) = hidden(docs, "new")
    new = docs.withColumn(name, F.pandas_udf(rewrite, schema)(F.col(text_col).cast("string")))
    return new.select(*[F.col(f"{name}.text").alias(c) if c == text_col else F.col(c) for c in docs.columns if c != "pii"], F.col(f"{name}.pii").alias("pii"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, None)
    done = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key=key.encode() if key else EXAMPLE_KEY)
    return done.select("doc_id", "text", *[F.col(f"pii.{k}").alias(f"n_{k}") for k in KINDS])
