"""Personal data to format-preserving pseudonyms: a keyed Feistel permutation within each value's own format.

E-mail, IPv4 and IPv6 addresses, phone numbers (in one piece or with spaces where a word such as tel or call stands before),
card numbers, IBANs (in one piece or in groups of four), social security numbers, dates, access keys, web tokens, private keys,
passwords and secrets after a word for them, and hexadecimal secrets are found by one pattern, validated, and replaced by other values of
the same kind and shape. Each round adds, modulo the size of one half's domain, a number drawn from SHA-256 of the key and
the other half; so each format is permuted: unlike values stay unlike, equal values become equal everywhere, and whoever has
the key can undo it. What validation says stays as it was: card numbers pass their Luhn test after as before, dates stay
dates, an IBAN's check digits are computed anew. Numbers of 13 to 19 digits that fail the Luhn test, days that no calendar
has, and what else fails its kind's validation, stay as they are, unless they follow ``password=`` or its like.

All of it is DataFrame functions: a text is split at the matches and put together again with the replaced ones. Texts of any
length are searched whole, but for those without a digit, an @, an equals sign, a quoted colon and the starts of keys, in which no
kind can stand; and secrets, passwords and addresses have no longest length.

Null texts stay null and empty ones empty. Rows are only mapped, so repeated rows, rows with a null or repeated id and extra
columns come out as they went in, and an empty table stays empty. The key stands in the query's plan: keep event logs as you
keep the key.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import by_place, columns_kept, read

ROUNDS = 10
#: The setting that names the key, and a key for where it is unset. That one is public: it hides nothing from its readers.
KEY_SETTING, PUBLIC_KEY = "spark.granary.pii.key", "granary"
FIRST_YEAR, YEARS = 1900, 200
_MONTHS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LOCAL = "A-Za-z0-9À-ɏ._%+-"
#: What stands before a password or a secret: a word for it and an equals sign, or a colon between quotes; or a colon alone,
#: where a value of six characters or more with a digit follows, as prose has colons too.
_WORD = r"(?i:pass(?:word|wd|phrase)?|pwd|secret(?:[_-]?(?:access[_-]?)?key)?|token|(?:api|access|private|auth)[_-]?key)"
_PASSWORD = rf"{_WORD}(?:[\"']?\s?=\s?[\"']?|[\"']\s?:\s?[\"']|\s?:\s?(?=[^\s\"'<>,;&]{{6}})(?=[^\s\"'<>,;&0-9]*[0-9]))"
#: Every match holds one of these; texts without are not searched.
_HINT = "[0-9@=]|[\"']\\s?:\\s?[\"']|AKIA|eyJ|PRIVATE KEY"
#: Each alternative starts where no longer token of its kind can have begun and repeats single classes only, so no text is
#: searched twice and no long one exhausts the stack.
PATTERNS = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++@[\p{{L}}0-9][\p{{L}}0-9.-]*(?<![.-])\.\p{{L}}{{2,}}(?![\p{{L}}0-9-])(?!(?<=(?i:password|passwd|pwd))[\"']?\s?[=:])",
    "pem": r"-----BEGIN (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----(?:\s{1,4}[A-Za-z0-9+/=]{16,}+){1,400}(?:\s{1,4}[A-Za-z0-9+/=]{1,15}(?=\s{1,4}-----END))?",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "iban_groups": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: (?![A-Z]{2}[0-9]{2} )[A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{26,}+(?![A-Za-z0-9])",
    "access_key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "password": rf"{_PASSWORD}[^\s\"'<>,;&]+(?<![.:!?)])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]{0,39}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])|(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}|00[1-9][0-9]{0,2}(?=[ .-]))(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
    "said_phone": r"(?<=(?i:tel|phone|call|mobile|cell|fax)(?i: number| no\.?| me| us)?(?i: is| at| on)?[.:]?\s{1,2})[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    "number": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
#: How a match looks by itself, where its pattern also asks for what stands around it.
_ALONE = PATTERNS | {"said_phone": "[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}", "pem": r"(?s)-----BEGIN .*PRIVATE KEY-----\s.*"}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _drawn(key: str, tag: str, r: Column, x: Column) -> Column:
    """A number of 60 bits from the key, the format, the round and the other half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), r.cast("string"), x.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, tag: str) -> Column:
    """struct(a, b) after ROUNDS rounds: odd rounds move ``a`` within its domain by ``b``, even ones the other way."""

    def one(s: Column, r: Column) -> Column:
        odd = r % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(s["a"] + F.pmod(_drawn(key, tag, r, s["b"]), size_a), size_a)).otherwise(s["a"]).alias("a"),
            F.when(odd, s["b"]).otherwise(F.pmod(s["b"] + F.pmod(_drawn(key, tag, r, s["a"]), size_b), size_b)).alias("b"),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permute_digits(digits: Column, key: str, tag: str) -> Column:
    """A string of up to 36 digits to another of the same length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    left, right = F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, n - u)
    moved = feistel(F.coalesce(left.try_cast("long"), F.lit(0)), F.coalesce(right.try_cast("long"), F.lit(0)), _power(u), _power(n - u), key, f"{tag}")
    return _let(moved, lambda s: F.concat(F.when(u > 0, F.lpad(s["a"].cast("string"), u, "0")).otherwise(""), F.lpad(s["b"].cast("string"), n - u, "0")))


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX_CLASSES = ("0123456789", "abcdef", "ABCDEF")


def permute_text(text: Column, key: str, tag: str, classes: tuple[str, ...] = _CLASSES) -> Column:
    """A string to another whose characters are of the same classes, place by place; others stay.

    A Feistel scheme on the halves of the string: a half's characters move within their classes by amounts drawn from
    the other half. 64 amounts of eight bits are drawn for a half; longer halves use them again.
    """

    def moved(half: Column, other: Column, r: Column) -> Column:
        draw = lambda k: F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), r.cast("string"), F.lit(k), other), 256)

        def shift(c: Column, amount: Column) -> Column:
            out = c
            for cls in classes:
                place = F.instr(F.lit(cls), c)
                out = F.when(place > 0, F.substring(F.lit(cls), F.pmod(place - 1 + amount, F.lit(len(cls))) + 1, F.lit(1))).otherwise(out)
            return out

        def all_of(stream: Column) -> Column:
            amount = lambda i: F.conv(F.substring(stream, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            return F.array_join(F.transform(F.split(half, ""), lambda c, i: F.when(c == "", c).otherwise(shift(c, amount(i)))), "")

        return _let(F.concat(draw("0"), draw("1")), all_of)

    def one(s: Column, r: Column) -> Column:
        odd = r % 2 == 1
        return F.struct(F.when(odd, moved(s["a"], s["b"], r)).otherwise(s["a"]).alias("a"), F.when(odd, s["b"]).otherwise(moved(s["b"], s["a"], r)).alias("b"))

    n = F.length(text)
    u = F.floor(n / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), u).alias("a"), F.substring(text, u + 1, n - u).alias("b"))
    return _let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one), lambda s: F.concat(s["a"], s["b"]))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order."""
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("i"))
    step = lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["o"], F.substring(digits, s["i"], F.lit(1))).alias("o"), (s["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(s["o"], c).alias("o"), s["i"].alias("i")))
    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["o"])


def luhn_sum(payload: Column) -> Column:
    """The Luhn sum, modulo 10, of the digits before a check digit."""
    each = lambda c, i: _let(c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda x: x - F.when(x > 9, 9).otherwise(0))
    return F.aggregate(F.transform(F.split(F.reverse(payload), ""), each), F.lit(0), lambda a, x: (a + x)) % 10


def _number(v: Column, key: str) -> Column:
    """Of numbers that pass the Luhn test the digits before the last are permuted; the last is the check digit."""

    def out(d: Column) -> Column:
        n = F.length(d)
        old = F.substring(d, F.lit(1), n - 1)
        valid = F.pmod(F.substring(d, n, F.lit(1)).cast("int") + luhn_sum(old), F.lit(10)) == 0
        return F.when(valid, _let(permute_digits(old, key, "number"), lambda new: _refill(v, F.concat(new, F.pmod(-luhn_sum(new), F.lit(10)).cast("string")))))

    return _let(_digits(v), out)


def _phone(v: Column, key: str) -> Column:
    """The country code stays."""

    def out(code: Column) -> Column:
        rest = F.substring(v, F.length(code) + 1, F.length(v))
        return F.concat(code, _let(_digits(rest), lambda d: _refill(rest, permute_digits(d, key, "phone"))))

    return _let(F.regexp_extract(v, r"^((?:\+|00)[0-9]{1,3}(?=[ .(-]))?", 0), out)


def _email(v: Column, key: str) -> Column:
    """The top-level domain and all punctuation stay; what stands before the first letter or digit is no part of it."""
    parts = r"^([._%+-]*)(.*)(\.\p{L}+)$"
    return F.concat(F.regexp_extract(v, parts, 1), permute_text(F.regexp_extract(v, parts, 2), key, "email"), F.regexp_extract(v, parts, 3))


def _ip(v: Column, key: str) -> Column:
    def out(p: Column) -> Column:
        n = [p[i].cast("long") for i in range(4)]
        size = F.lit(65536)
        moved = feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], size, size, key, "ip")
        return _let(moved, lambda s: F.concat_ws(".", *[x.cast("string") for x in (F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)]))

    return _let(F.split(v, r"\."), out)


def _ssn(v: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups from 01, serials from 0001; others are no such number."""
    area, group, serial = (F.substring(v, p, n).cast("long") for p, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    moved = feistel(place, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    show = lambda s: F.format_string("%03d-%02d-%04d", s["a"] + 1 + F.when(s["a"] >= 665, 1).otherwise(0), F.floor(s["b"] / 9999) + 1, s["b"] % 9999 + 1)
    return F.when(valid, _let(moved, show))


def _date(v: Column, key: str) -> Column:
    """Years from 1900 to 2099. Years and the 365 days of a common year are permuted with each other, and the 49 leap days
    among themselves. With slashes the month comes first; dates where only the day can come first, 221 in a common year,
    are permuted among themselves."""
    year_first = v.rlike("^[0-9]{4}")
    sep = F.when(year_first, F.substring(v, 5, 1)).otherwise(F.substring(v, 3, 1))
    year = F.when(year_first, F.substring(v, 1, 4)).otherwise(F.substring(v, 7, 4)).cast("long")
    one = F.when(year_first, F.substring(v, 6, 2)).otherwise(F.substring(v, 1, 2)).cast("int")
    two = F.when(year_first, F.substring(v, 9, 2)).otherwise(F.substring(v, 4, 2)).cast("int")
    month_first = year_first | (sep == "/")
    month, day = F.when(month_first, one).otherwise(two), F.when(month_first, two).otherwise(one)
    known = year.between(FIRST_YEAR, FIRST_YEAR + YEARS - 1)
    real = lambda m, d: m.between(1, 12) & d.between(1, 31) & F.try_to_date(F.format_string("%04d-%02d-%02d", year, m, d), "yyyy-MM-dd").isNotNull()
    swapped = ~year_first & (sep == "/") & (month > 12)

    def show(y: Column, m: Column, d: Column) -> Column:
        first = F.format_string("%04d%s%02d%s%02d", y, sep, m, sep, d)
        a, b = F.when(month_first, m).otherwise(d), F.when(month_first, d).otherwise(m)
        return F.when(year_first, first).otherwise(F.format_string("%02d%s%02d%s%04d", a, sep, b, sep, y))

    common = F.dayofyear(F.try_to_date(F.format_string("2001-%02d-%02d", month, day), "yyyy-MM-dd")) - 1

    def from_place(s: Column) -> Column:
        return _let(F.date_add(F.to_date(F.lit("2001-01-01")), s["b"].cast("int")), lambda t: show(s["a"] + FIRST_YEAR, F.month(t), F.dayofmonth(t)))

    moved = _let(feistel(year - FIRST_YEAR, common, F.lit(YEARS), F.lit(365), key, "date"), from_place)
    leap = F.floor((year - 1904) / 4)  # 49 leap years, from 1904 to 2096
    leaping = _let(feistel(F.floor(leap / 7), leap % 7, F.lit(7), F.lit(7), key, "leap"), lambda s: s["a"] * 7 + s["b"])
    # Days from the 13th on of a common year, in order: the months' first places, and 0 to 220.
    before = [sum(n - 12 for n in _MONTHS[:k]) for k in range(12)]
    firsts = F.array(*map(F.lit, before))

    def from_late(s: Column) -> Column:
        return _let(F.size(F.filter(firsts, lambda x: x <= s["b"])), lambda m: shown_late(s["a"] + FIRST_YEAR, m, s["b"] - F.element_at(firsts, m) + 13))

    shown_late = lambda y, m, d: F.format_string("%02d%s%02d%s%04d", d, sep, m, sep, y)
    # Where only the day can come first, ``month`` holds the day and ``day`` the month.
    late = _let(feistel(year - FIRST_YEAR, F.element_at(firsts, F.greatest(F.lit(1), F.least(F.lit(12), day))) + month - 13, F.lit(YEARS), F.lit(before[-1] + 19), key, "day first"), from_late)
    leaps = lambda m, d: (m == 2) & (d == 29)
    usual = F.when(leaps(month, day), _let(leaping, lambda x: show(1904 + 4 * x, F.lit(2), F.lit(29)))).otherwise(moved)
    turned = F.when(leaps(day, month), _let(leaping, lambda x: shown_late(1904 + 4 * x, F.lit(2), F.lit(29)))).otherwise(late)
    return F.when(known & swapped & real(day, month), turned).when(known & ~swapped & real(month, day), usual)


def _mod97(text: Column) -> Column:
    """The remainder by 97 of digits and capital letters read as 10 to 35."""
    step = lambda a, c: _let(F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1, lambda x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _iban_valid(v: Column) -> Column:
    return _mod97(F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))) == 1


def _iban(v: Column, key: str) -> Column:
    country, rest = F.substring(v, 1, 2), F.substring(v, F.lit(5), F.length(v))
    new = lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b)
    return F.when(_iban_valid(v), _let(permute_text(rest, key, "iban"), new))


def _iban_groups(v: Column, key: str) -> Column:
    """An IBAN in groups of four, or the most groups that make one; spaces stay where they were. In what is no IBAN, card
    numbers are looked for."""
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    groups = F.split(v, " ")
    tries = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(groups, F.lit(1), k), " "))
    found = F.filter(tries, lambda x: (F.length(bare(x)) >= 15) & _iban_valid(bare(x)))
    spaced = lambda x: F.trim(F.regexp_replace(x, "(.{4})", "$1 "))
    whole = _let(F.get(found, 0), lambda x: F.concat(spaced(_iban(bare(x), key)), F.substring(v, F.length(x) + 1, F.length(v))))
    numbers = F.regexp_extract_all(v, F.lit(PATTERNS["number"]), F.lit(0))
    inner = _joined(F.split(v, PATTERNS["number"], -1), F.transform(numbers, lambda x: F.coalesce(_number(x, key), x)))
    return F.when(F.size(found) > 0, whole).when(F.size(numbers) > 0, inner)


def _joined(between: Column, values: Column) -> Column:
    """Texts with values between them."""
    return F.array_join(F.flatten(F.zip_with(between, F.array_append(values, F.lit("")), lambda p, x: F.array(p, x))), "")


def _secret(v: Column, key: str) -> Column:
    return permute_text(v, key, "secret", _HEX_CLASSES)


def _access_key(v: Column, key: str) -> Column:
    return F.concat(F.substring(v, 1, 4), permute_text(F.substring(v, 5, 16), key, "access_key"))


def _jwt(v: Column, key: str) -> Column:
    return F.concat(F.substring(v, 1, 3), permute_text(F.substring(v, F.lit(4), F.length(v)), key, "jwt"))


def _ipv6(v: Column, key: str) -> Column:
    return permute_text(v, key, "ipv6", _HEX_CLASSES)


def _pem(v: Column, key: str) -> Column:
    """The header stays, of the key itself each character is permuted within its class."""
    head = F.regexp_extract(v, r"^-----BEGIN [A-Z ]*-----", 0)
    return _let(head, lambda h: F.concat(h, permute_text(F.substring(v, F.length(h) + 1, F.length(v)), key, "pem")))


def pseudonym(match: Column, key: str) -> Column:
    """The pseudonym of one match, by the first kind that its shape and its validation allow. A match that none allows
    stays as it is, but for what follows ``password=``."""
    kinds: dict[str, Callable[[Column, str], Column]] = {"email": _email, "pem": _pem, "jwt": _jwt, "iban": _iban, "iban_groups": _iban_groups, "secret": _secret, "access_key": _access_key, "ip": _ip, "ipv6": _ipv6, "date": _date, "ssn": _ssn, "phone": _phone, "said_phone": _phone, "number": _number}

    def made(v: Column, otherwise: Column) -> Column:
        return F.coalesce(*[F.when(v.rlike(f"^(?:{_ALONE[kind]})$"), one(v, key)) for kind, one in kinds.items()], otherwise)

    def after(said: Column) -> Column:
        """Of ``password=`` and a value, the value is replaced."""
        value = F.substring(match, F.length(said) + 1, F.length(match))
        return F.concat(said, _let(value, lambda v: made(v, F.when(said == "", v).otherwise(permute_text(v, key, "password")))))

    return _let(F.regexp_extract(match, f"^{_PASSWORD}", 0), after)


def pseudonymised(text: Column, key: str) -> Column:
    """struct(text, found): the text with all matches replaced, and the number of values that changed. A null text stays null."""

    def replaced(found: Column) -> Column:
        def whole(between: Column) -> Column:
            values = F.transform(found, lambda v: pseudonym(v, key))
            changed = lambda new: F.aggregate(F.zip_with(found, new, lambda a, b: (a != b).cast("long")), F.lit(0).cast("long"), lambda n, x: n + x)
            return _let(values, lambda new: F.struct(_joined(between, new).alias("text"), changed(new).alias("found")))

        return F.when(F.size(found) > 0, _let(F.split(text, _ANY, -1), whole)).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("found")))

    return _let(F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(F.array().cast("array<string>")), replaced)


def key_of(spark: SparkSession) -> str:
    """The key that ``KEY_SETTING`` holds; where it is unset, the public one, with a warning."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with a key that everyone has, and so can be undone", stacklevel=2)
    return key or PUBLIC_KEY


def pseudonymise(docs: DataFrame, *, key: str, text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """``docs`` with the texts' personal data replaced; with ``found_col``, also the number of values that changed. Rows are
    only mapped: none is lost, and repeated rows stay equal."""
    if not key:
        raise ValueError("the key is empty")
    own, at = by_place(docs)
    made = own.withColumn("pii", pseudonymised(F.col(at(text_col)), key))
    columns = [F.col("pii.text").alias(c) if c == at(text_col) else F.col(c) for c in own.columns]
    return made.select(*columns, *([F.col("pii.found")] if found_col else [])).toDF(*docs.columns, *([found_col] if found_col else []))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns_kept(read(spark, sf_dir, "documents"), {"doc_id": "doc_id", "text": "text"})
    return pseudonymise(docs, key=key_of(spark), found_col="n_found").select("doc_id", "text", "n_found")
