"""Personal data: format-preserving Feistel pseudonyms, in DataFrame operations only.

One pattern finds the candidates that begin at each place of a text; each is validated by
its kind (check digits, ranges, the calendar), and what fails stays as it is. Of valid ones
that overlap the first stands. A candidate ends with its kind's own groups, so a number
next to a value isn't part of it; only a phone number whose country code isn't in
``LENGTHS`` takes groups of digits that follow, to 15 digits in all. Every repetition in
the patterns is bounded or possessive, so matching takes time in proportion to the text
and no stack.

A valid value is permuted within its format by a keyed, balanced or unbalanced Feistel
network over exactly the values of that format, so no two values share a pseudonym and
equal values keep theirs in every document, however they are punctuated. Numbers,
addresses and dates are permuted as pairs of residues (dates over the 146097 = 189 * 773
days of a Gregorian cycle of 400 years); digits and letters of longer identifiers are
shifted by keyed hashes of the other half, each within its own class of characters. A
format that isn't a whole network's range (cards but for all zeros, dates that only read
day first) is kept by walking the network's cycle until it is met again. The network is a
fold whose state is a struct, so its plan stays small.

The key comes from an argument or from the setting ``spark.hyperslice.pii.secret``
(Spark's own rule hides settings with "secret" in their names). Plans hold the key as a
literal: set ``spark.sql.redaction.string.regex`` where others may read plans.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, read

#: The setting that names the key, and the public key of the registered queries over synthetic tables.
SETTING = "spark.hyperslice.pii.secret"
SYNTHETIC_KEY = "a public key for synthetic tables"
ROUNDS = 8
#: Steps of a walk along a network's cycle. Each misses its format with a chance of under a half.
WALK = 64
#: Candidates that are put in place by one inner fold.
PLACES = 256

DATE = r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?=T[0-9]{2}|(?![0-9A-Za-z/-]|\.[0-9]))"
ADDRESS = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
ADDRESS6 = r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:]|\.[0-9])"
SOCIAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
NATIONAL = r"(?<![0-9A-Za-z])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z]|-[0-9])"
#: A card's own groups: none, fours with up to 3 more digits, or 4-6-4 and 4-6-5.
FOURS = r"[0-9]{4}(?:[ -][0-9]{4}){3}"
GROUPED = rf"(?:[0-9]{{13,19}}|{FOURS}(?:[ -](?!{DATE}|{ADDRESS}|{SOCIAL}|{NATIONAL})[0-9]{{1,3}})?|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{4,5}})(?![0-9A-Za-z])"
#: What a longer number never runs into.
APART = f"(?!{DATE}|{ADDRESS}|{SOCIAL}|(?<![0-9A-Za-z]){GROUPED})"
#: A card in other groups: a whole run of digits, from its start or behind another value.
UNGROUPED = rf"(?:(?<![0-9][ -])|(?<=[./-][0-9]{{1,4}} )|(?<=[0-9]{{13}}[ -]))[0-9](?:[ -]?(?!{DATE}|{ADDRESS}|{SOCIAL}|{NATIONAL})[0-9]){{12,18}}(?![0-9A-Za-z])(?![ -](?!{DATE}|{ADDRESS}|{SOCIAL}|{NATIONAL})[0-9])"
#: Digits after country codes whose numbers have one length; others have 8 to 15 digits with the code.
LENGTHS = {10: "1|7|44|91", 9: "31|33|34|41|48|61|351"}
#: The country codes of two digits (ITU-T E.164). 1 and 7 have one digit, all others three.
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
_DIGIT = rf"[ .-]?{APART}\(?[0-9]\)?"
ABROAD = "|".join([*(rf"\+(?:{codes})(?:[ .-]?\(0\))?(?:{_DIGIT}){{{n}}}(?![0-9A-Za-z])" for n, codes in LENGTHS.items()), rf"\+[0-9](?:{_DIGIT}){{7}}(?:[ .-]?(?!{NATIONAL}){_DIGIT[6:]}){{0,7}}(?![0-9A-Za-z])"])
#: What stands before a secret's value: the prefixes of public formats, and names with a sign.
PREFIXES = r"(?<![A-Za-z0-9])(?:AKIA(?=[A-Z0-9]{16}(?![A-Za-z0-9]))|ASIA(?=[A-Z0-9]{16}(?![A-Za-z0-9]))|gh[pousr]_(?=[A-Za-z0-9]{36})|sk_live_(?=[A-Za-z0-9]{16})|AIza(?=[A-Za-z0-9]{35}))"
NAMED = r"(?i:password|passwd|secret|token|api_?key)[ ]?[=:][ ]?\"?(?=[A-Za-z0-9]{12})"

#: Kinds in the order in which they are tried, each with its pattern. Word characters never touch a match of digits.
KINDS = {
    "secret": rf"(?:{PREFIXES}|{NAMED})[A-Za-z0-9]{{12,4096}}+(?![A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,60}[A-Za-z]{2,63}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": DATE,
    "address": ADDRESS,
    "social": SOCIAL,
    "phone": rf"(?<![0-9A-Za-z])(?:{ABROAD})|{NATIONAL}",
    "card": rf"(?<![0-9A-Za-z])(?:{GROUPED}|{UNGROUPED})",
    "address6": ADDRESS6,
}
#: Found at every place, so that a candidate which isn't valid hides no other that begins within it.
ANY = f"(?=({'|'.join(KINDS.values())}))"
#: A text without one of these holds no candidate.
HINT = r"[0-9@]|AKIA|ASIA|AIza|gh[pousr]_|sk_live_|[=:][ ]?\"?[A-Za-z0-9]{12}"

EPOCH, DAYS, LEFT_DAYS, RIGHT_DAYS = "1800-01-01", 146097, 189, 773
#: Years of whole cycles of 400 years, written with four digits.
YEARS = (200, 9799)
AREAS, GROUPS, SERIALS = 898, 99, 9999

#: Classes that a character of a text stays in: (first, last) code points. Those of secrets keep hexadecimal text hexadecimal.
WORDS = (("0", "9"), ("A", "Z"), ("a", "z"))
HEXADECIMAL = (("0", "9"), ("A", "F"), ("G", "Z"), ("a", "f"), ("g", "z"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def key_of(spark: SparkSession, key: str | None = None) -> str:
    """``key``, or what the setting names. Without either no pseudonyms are made."""
    found = key or spark.conf.get(SETTING, None)
    if not found:
        raise ValueError(f"pseudonyms need a key: pass one, or set {SETTING}")
    return found


def synthetic_key(spark: SparkSession) -> str:
    """The setting's key; without one the public key, which protects nothing and serves synthetic tables only."""
    found = spark.conf.get(SETTING, None)
    if not found:
        warnings.warn(f"{SETTING} is not set: pseudonyms are made with a public key, for synthetic tables only", stacklevel=2)
    return found or SYNTHETIC_KEY


def _characters(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def walked(value: Column, network: Callable[[Column], Column], valid: Callable[[Column], Column], steps: int = WALK) -> Column:
    """``value`` moved along its cycle of ``network`` to the next valid value: a permutation of the valid ones."""
    start = F.struct(value.alias("v"), F.lit(False).alias("moved"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: F.when(s["moved"] & valid(s["v"]), s).otherwise(F.struct(network(s["v"]).alias("v"), F.lit(True).alias("moved"))), lambda s: s["v"])


class Cipher:
    """The networks under one key."""

    def __init__(self, key: str) -> None:
        self.key = key

    def bits(self, *parts: Column) -> Column:
        """60 keyed bits."""
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(self.key), *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("bigint")

    def pair(self, left: Column, right: Column, lefts: Column, rights: Column, kind: str) -> Column:
        """A struct (a, b): the pair of residues modulo ``lefts`` and ``rights`` after an even number of rounds."""
        start = F.struct(left.cast("bigint").alias("a"), right.cast("bigint").alias("b"))

        def mix(s: Column, r: Column) -> Column:
            size = F.when(r % 2 == 0, lefts).otherwise(rights).cast("bigint")
            return F.struct(s["b"].alias("a"), F.pmod(s["a"] + self.bits(F.lit(kind), r, s["b"]) % size, size).alias("b"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, mix)

    def text(self, text: Column, kind: str, classes: tuple[tuple[str, str], ...] = WORDS) -> Column:
        """``text`` with its letters and digits permuted, each within its class; other characters stay. Time in proportion to the length."""

        def network(whole: Column) -> Column:
            half = F.floor(F.length(whole) / 2).cast("int")
            start = F.struct(F.substring(whole, F.lit(1), half).alias("a"), F.substring(whole, half + 1, F.length(whole)).alias("b"))

            def mix(s: Column, r: Column) -> Column:
                def shifted(seed: Column) -> Column:
                    def one(c: Column, i: Column) -> Column:
                        which = [c.between(first, last) for first, last in classes]
                        start, size = (F.coalesce(*[F.when(w, v(first, last)) for w, (first, last) in zip(which, classes, strict=True)]) for v in (lambda a, _: ord(a), lambda a, z: ord(z) - ord(a) + 1))
                        return F.coalesce(F.char((start + (F.ascii(c) - start + self.bits(seed, i) % size) % size).cast("bigint")), c)

                    return F.array_join(F.transform(_characters(s["a"]), one), "")

                seed = F.sha2(F.concat_ws("|", F.lit(self.key), F.lit(kind), r.cast("string"), s["b"]), 256)
                return F.struct(s["b"].alias("a"), let(seed, shifted).alias("b"))

            return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, mix, lambda s: F.concat(s["a"], s["b"]))

        return let(text, network)

    def digits(self, digits: Column, kind: str) -> Column:
        """A string of 2 to 36 digits, permuted among those of its length."""

        def network(d: Column) -> Column:
            left = F.floor(F.length(d) / 2).cast("int")
            right = F.length(d) - left
            lefts, rights = F.pow(F.lit(10.0), left).cast("bigint"), F.pow(F.lit(10.0), right).cast("bigint")
            pair = self.pair(F.substring(d, F.lit(1), left), F.substring(d, left + 1, right), lefts, rights, kind)
            return let(pair, lambda p: F.concat(F.lpad(p["a"].cast("string"), left, "0"), F.lpad(p["b"].cast("string"), right, "0")))

        return let(digits, network)

    # Pseudonyms of candidates, by kind; null where a candidate isn't valid.

    def card(self, x: Column) -> Column:
        def made(digits: Column) -> Column:
            body = walked(F.substring(digits, F.lit(1), F.length(digits) - 1), lambda b: self.digits(b, "card"), lambda b: ~b.rlike("^0+$"), 2)
            whole = let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
            return F.when((luhn_sum(digits) % 10 == 0) & ~digits.rlike("^0+$"), _spread(x, whole))

        return let(_digits(x), made)

    def iban(self, x: Column) -> Column:
        def made(bare: Column) -> Column:
            country = F.substring(bare, 1, 2)
            body = self.text(F.substring(bare, F.lit(5), F.length(bare)), "iban")
            whole = let(body, lambda b: F.concat(country, F.lpad((98 - _remainder97(F.concat(country, F.lit("00"), b))).cast("string"), 2, "0"), b))
            return F.when(_is_iban(bare), _spread(x, whole, lambda c: c != " "))

        return let(F.replace(x, F.lit(" "), F.lit("")), made)

    def phone(self, x: Column) -> Column:
        """The country code stays, a trunk zero in brackets too; the rest is permuted, so all ways to write a number agree."""
        shown = F.replace(x, F.lit("(0)"), F.lit("(o)"))

        def made(digits: Column) -> Column:
            code = F.when(~x.startswith("+"), 0).when(digits.rlike("^[17]"), 1).when(F.substring(digits, 1, 2).isin(TWO_DIGIT_CODES), 2).otherwise(3)
            rest = F.substring(digits, code + 1, F.length(digits))
            whole = F.concat(F.substring(digits, F.lit(1), code), self.digits(rest, "phone"))
            return F.when(F.length(digits).between(8, 15) & (F.length(rest) >= 6), F.replace(_spread(shown, whole), F.lit("(o)"), F.lit("(0)")))

        return let(_digits(shown), made)

    def address(self, x: Column) -> Column:
        parts = F.split(x, r"\.")
        byte = [F.element_at(parts, i).cast("int") for i in (1, 2, 3, 4)]
        pair = self.pair(byte[0] * 256 + byte[1], byte[2] * 256 + byte[3], F.lit(65536), F.lit(65536), "address")
        shown = let(pair, lambda p: F.concat_ws(".", F.shiftright(p["a"], 8), p["a"] % 256, F.shiftright(p["b"], 8), p["b"] % 256))
        return F.when(F.forall(parts, lambda p: p.cast("int") <= 255), shown)

    def address6(self, x: Column) -> Column:
        """Eight groups, or one gap and at least two groups; a digit somewhere. The pseudonym is written in full, in small letters."""
        halves = F.split(x, "::")
        groups = F.transform(halves, lambda h: F.filter(F.split(h, ":"), lambda g: g != ""))
        count = F.aggregate(groups, F.lit(0), lambda n, g: n + F.size(g))
        gap = F.size(halves) == 2
        sound = ~x.contains(":::") & ~x.rlike("^:[^:]|[^:]:$") & x.rlike("[0-9]") & F.when(gap, count.between(2, 7)).otherwise((F.size(halves) == 1) & (count == 8))
        wide = F.transform(F.flatten(F.transform(groups, lambda g, i: F.when((i == 1) | (F.size(halves) == 1), g).otherwise(F.concat(g, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - count)))))), lambda g: F.lpad(F.lower(g), 4, "0"))

        def shown(whole: Column) -> Column:
            numbers = [F.conv(F.substring(whole, a, 8), 16, 10).cast("bigint") for a in (1, 9, 17, 25)]
            size = 1 << 32  # the halves are of 64 bits, each two residues
            start = F.struct(*[n.alias(k) for n, k in zip(numbers, "abcd", strict=True)])

            def mix(s: Column, r: Column) -> Column:
                moved = [F.pmod(s[k] + self.bits(F.lit(f"address6 {k}"), r, s["c"], s["d"]) % size, F.lit(size)) for k in "ab"]
                return F.struct(s["c"].alias("a"), s["d"].alias("b"), moved[0].alias("c"), moved[1].alias("d"))

            done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, mix)
            text = let(done, lambda p: F.lower(F.concat(*[F.lpad(F.hex(p[k]), 8, "0") for k in "abcd"])))
            return let(text, lambda t: F.concat_ws(":", *[F.substring(t, a, 4) for a in range(1, 33, 4)]))

        return F.when(sound, let(F.array_join(wide, ""), shown))

    def social(self, x: Column) -> Column:
        area, group, serial = (F.substring(x, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        place = F.when(area > 666, area - 2).otherwise(area - 1)
        pair = self.pair(place * GROUPS + group - 1, serial - 1, F.lit(AREAS * GROUPS), F.lit(SERIALS), "social")

        def shown(p: Column) -> Column:
            at = F.floor(p["a"] / GROUPS)
            number = F.when(at >= 665, at + 2).otherwise(at + 1)
            padded = [F.lpad(v.cast("string"), n, "0") for v, n in ((number, 3), (p["a"] % GROUPS + 1, 2), (p["b"] + 1, 4))]
            return F.concat_ws("-", *padded)

        return F.when(valid, let(pair, shown))

    def date(self, x: Column) -> Column:
        """Written year first, with points day first, or with slashes month first, else (where that is no date) day first."""

        def read_parts(parts: Column) -> Column:
            one, two, last = (F.element_at(parts, i) for i in (1, 2, 3))
            first = F.length(one) == 4
            by_day = ~first & (x.contains(".") | ((one.cast("int") > 12) & (two.cast("int") <= 12)))
            year = F.when(first, one).otherwise(last).cast("int")
            month = F.when(first | by_day, two).otherwise(one).cast("int")
            day = F.when(first, last).when(by_day, one).otherwise(two).cast("int")
            return F.struct(first.alias("first"), by_day.alias("by_day"), year.alias("y"), month.alias("m"), day.alias("d"), F.exists(parts, lambda p: F.length(p) == 1).alias("short"))

        def made(q: Column) -> Column:
            in_range = q["y"].between(*YEARS) & q["m"].between(1, 12) & (q["d"] >= 1)
            valid = in_range & (q["d"] <= F.when(in_range, F.day(F.last_day(F.make_date(q["y"], q["m"], F.lit(1))))))
            return F.when(valid, let(F.datediff(F.make_date(q["y"], q["m"], q["d"]), F.lit(EPOCH).cast("date")), lambda at: permuted(q, at)))

        def network(d: Column) -> Column:
            pair = self.pair(F.floor(d / RIGHT_DAYS), d % RIGHT_DAYS, F.lit(LEFT_DAYS), F.lit(RIGHT_DAYS), "date")
            return let(pair, lambda p: p["a"] * RIGHT_DAYS + p["b"])

        def permuted(q: Column, at: Column) -> Column:
            before = F.floor(at / DAYS) * DAYS  # of the cycle that the date lies in

            def on(d: Column) -> Column:
                return F.date_add(F.lit(EPOCH).cast("date"), (before + d).cast("int"))

            only_by_day = q["by_day"] & x.contains("/")
            return let(on(walked(at - before, network, lambda d: ~only_by_day | (F.day(on(d)) > 12))), lambda d: shown(q, d))

        def shown(q: Column, d: Column) -> Column:
            mark = F.regexp_extract(x, "[./-]", 0)
            y = F.lpad(F.year(d).cast("string"), 4, "0")
            m, n = (F.when(q["short"], v.cast("string")).otherwise(F.lpad(v.cast("string"), 2, "0")) for v in (F.month(d), F.day(d)))
            return F.when(q["first"], F.concat(y, mark, m, mark, n)).when(q["by_day"], F.concat(n, mark, m, mark, y)).otherwise(F.concat(m, mark, n, mark, y))

        return let(let(F.split(x, "[./-]"), read_parts), made)

    def email(self, x: Column) -> Column:
        """The local part, and the domain (in small letters) but for its last label, each permuted: equal domains stay linked."""
        at = F.instr(x, "@")
        domain = F.lower(F.substring(x, at + 1, F.length(x)))
        last = F.regexp_extract(domain, r"\.[a-z]+$", 0)
        return F.concat(self.text(F.substring(x, F.lit(1), at - 1), "email"), F.lit("@"), self.text(F.substring(domain, F.lit(1), F.length(domain) - F.length(last)), "domain"), last)

    def secret(self, x: Column) -> Column:
        head = F.regexp_extract(x, f"^(?:{PREFIXES}|{NAMED})", 0)
        return F.concat(head, self.text(F.substring(x, F.length(head) + 1, F.length(x)), "secret", HEXADECIMAL))

    def pseudonym(self, x: Column) -> Column:
        """A struct (kind, original, value) for a candidate; value is null where it isn't valid."""

        def found(name: str) -> Column:
            make = getattr(self, name)
            return let(WITHIN[name](x) if name in WITHIN else x, lambda part: F.struct(F.lit(name).alias("kind"), part.alias("original"), make(part).alias("value")))

        made = None
        for name, pattern in KINDS.items():
            whole = x.rlike(f"^(?:{pattern})$")
            made = F.when(whole, found(name)) if made is None else made.when(whole, found(name))
        return made


def _spread(text: Column, digits: Column, taken: Callable[[Column], Column] = lambda c: c.between("0", "9")) -> Column:
    """``text`` with its digits (or what ``taken`` says) replaced, in order, by the characters of ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("n"))

    def place(made: Column) -> Column:
        def put(s: Column, c: Column) -> Column:
            return F.struct(F.concat(s["out"], F.when(taken(c), F.substring(made, s["n"], F.lit(1))).otherwise(c)).alias("out"), (s["n"] + taken(c).cast("int")).alias("n"))

        return F.aggregate(_characters(text), start, put, lambda s: s["out"])

    return let(digits, place)


def luhn_sum(digits: Column) -> Column:
    """The sum by Luhn's rule: every second digit from the right, the last left out, counts doubled."""

    def total(text: Column) -> Column:
        n = F.length(text)

        def add(s: Column, i: Column) -> Column:
            d = F.substring(text, i, F.lit(1)).cast("int")
            twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
            return s + F.when((n - i) % 2 == 1, twice).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)

    return let(digits, total)


def _remainder97(text: Column) -> Column:
    """An IBAN's characters, moved and read as a number, modulo 97."""
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))

    def add(s: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (s * 10 + code - 48) % 97).otherwise((s * 100 + code - 55) % 97)

    return F.aggregate(_characters(moved), F.lit(0), add)


def _is_iban(bare: Column) -> Column:
    """15 to 34 characters, check digits 02 to 98 that fit."""
    return F.length(bare).between(15, 34) & F.substring(bare, 3, 2).between("02", "98") & (_remainder97(bare) == 1)


def _iban_within(x: Column) -> Column:
    """The longest run of leading groups that is an IBAN: words may follow that look like groups."""

    def longest(groups: Column) -> Column:
        heads = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))
        return F.get(F.filter(heads, lambda h: let(F.replace(h, F.lit(" "), F.lit("")), _is_iban)), F.lit(0))

    return let(F.split(x, " "), longest)


def _passes(x: Column) -> Column:
    return luhn_sum(_digits(x)) % 10 == 0


def _card_within(x: Column) -> Column:
    """Four fours before what may follow them; nothing where a card in groups of its own stands behind the first digits."""
    fours = F.regexp_extract(x, f"^{FOURS}", 0)
    behind = F.filter(F.regexp_extract_all(x, F.lit(f"(?<=[ -])(?=({GROUPED}))"), 1), _passes)
    own = x.rlike(f"^{GROUPED}$")
    return F.when((F.length(fours) > 0) & _passes(fours), fours).when(own | (F.size(behind) == 0), x)


#: Where a candidate can be longer than its value: the part that is the value.
WITHIN = {"iban": _iban_within, "card": _card_within}


def _in_place(pieces: Column, made: Column) -> Column:
    """A struct (text, private): the pieces that begin at candidates, with the values of ``made`` put in.

    A fold over the candidates keeps ``ahead``, the characters of the next pieces that belong to a
    replaced value. It goes in blocks of ``PLACES``, so its arrays stay short however many there are.
    """
    private = "array<struct<kind:string,original:string,value:string>>"

    def put(s: Column, at: Column) -> Column:
        piece, made = at["piece"], at["made"]
        taken = (s["ahead"] == 0) & made["value"].isNotNull()
        gone = F.when(taken, F.length(made["original"])).otherwise(s["ahead"])
        rest = F.substring(piece, gone + 1, F.length(piece))
        return F.struct(
            F.concat(s["parts"], F.array(F.when(taken, F.concat(made["value"], rest)).otherwise(rest))).alias("parts"),
            F.when(taken, F.concat(s["private"], F.array(made))).otherwise(s["private"]).alias("private"),
            F.greatest(F.lit(0), gone - F.length(piece)).alias("ahead"),
        )

    def block(s: Column, places: Column) -> Column:
        begin = F.struct(F.array().cast("array<string>").alias("parts"), F.array().cast(private).alias("private"), s["ahead"].alias("ahead"))

        def add(done: Column) -> Column:
            return F.struct(F.concat(s["parts"], F.array(F.array_join(done["parts"], ""))).alias("parts"), F.concat(s["private"], F.array(done["private"])).alias("private"), done["ahead"].alias("ahead"))

        return let(F.aggregate(places, begin, put), add)

    def blocks(places: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(places) - 1) / PLACES)), lambda k: F.slice(places, (k * PLACES + 1).cast("int"), F.lit(PLACES)))
        begin = F.struct(F.array().cast("array<string>").alias("parts"), F.array().cast(f"array<{private}>").alias("private"), F.lit(0).alias("ahead"))
        return F.aggregate(cut, begin, block, lambda s: F.struct(F.array_join(s["parts"], "").alias("text"), F.flatten(s["private"]).alias("private")))

    places = F.zip_with(F.slice(pieces, F.lit(2), F.size(made)), made, lambda p, m: F.struct(p.alias("piece"), m.alias("made")))
    return let(places, blocks)


def pseudonymise(docs: DataFrame, text: str = "text", out: str = "private", key: str | None = None) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced, and a column ``out``: (kind, original, value) of each replaced value in order.

    ``key`` or the setting ``SETTING`` is needed. A null text stays null and an empty one
    empty, both with no private values; texts of any length take time in proportion to it.
    Only addresses can change a text's length. Repeated rows give repeated results, an empty
    table an empty one. Other columns stay as they are, whatever their names; a column ``out``
    of the input is replaced. Not found: dates in words or with two-digit years, local parts
    of over 64 characters, secrets without a known prefix or name or of over 4096 characters.
    """
    cipher = Cipher(key_of(docs.sparkSession, key))
    found, made, pieces, done = (fresh(docs, n) for n in ("found", "made", "pieces", "done"))
    source = F.col(text)
    started = F.concat(F.lit("\n"), source)  # so that the first piece holds no candidate
    none = F.array().cast("array<string>")
    empty = F.array().cast("array<struct<kind:string,original:string,value:string>>")
    candidates = F.when(source.rlike(HINT), F.regexp_extract_all(started, F.lit(ANY), 1)).otherwise(none)
    marked = docs.withColumn(found, F.coalesce(candidates, none))
    marked = marked.withColumn(made, F.transform(found, cipher.pseudonym))
    marked = marked.withColumn(pieces, F.when(F.size(found) > 0, F.split(started, ANY, -1)))
    marked = marked.withColumn(done, F.when(F.size(found) > 0, _in_place(F.col(pieces), F.col(made))))
    head = F.element_at(F.col(pieces), 1)
    joined = F.concat(F.substring(head, F.lit(2), F.length(head)), F.col(done)["text"])
    replaced = marked.withColumn(out, F.coalesce(F.col(done)["private"], empty)).withColumn(text, F.when(F.col(done).isNotNull(), joined).otherwise(source))
    return replaced.drop(found, made, pieces, done)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms in place of personal data, and how many of each kind; null and empty texts have none.

    A row for each row of ``documents``, repeated ones too; an empty table gives no rows.
    """
    docs = pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), key=synthetic_key(spark))

    def count(kind: str) -> Column:
        return F.size(F.filter("private", lambda p: p["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return docs.select("doc_id", "text", F.size("private").cast("bigint").alias("n_private"), *map(count, KINDS))
