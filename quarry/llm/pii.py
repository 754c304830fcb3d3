"""Personal data replaced by format-preserving pseudonyms (DataFrame functions only).

Candidates are found by one pattern and then validated: payment cards (Luhn),
IBANs (remainder 97; in small letters also the country's length), social security
numbers (issued ranges), phone numbers (8 to 15 digits; in the American grouping
no area or exchange 000, and with blanks alone none that begins with 0 or 1), IPv4
addresses (octets), calendar dates, mail addresses. What fails its check is left alone.

A valid value becomes a list of symbols with a radix each and is permuted by a
keyed Feistel network: in turn, the symbols at even and at odd places are
shifted by 32 bits each of a digest of the others, modulo their radix. That is a
permutation of the format's values, so equal values get equal pseudonyms in every document,
different values different ones, and who holds the key can invert it. Check
digits are computed anew, so a pseudonym passes the same validation:

- cards: all digits but the check digit; separators stay
- IBANs: country and length stay, letters stay letters
- phones: the country code (up to a separator, else one digit; a leading 1-) stays
- dates: the day number within the 400 years 1700 to 2099 (27 * 5411 days), so
  one date written in two ways stays one date; the way it is written stays. With
  slashes or hyphens the month comes first where that is a date, with dots the day
- mail addresses: letters and digits of the local part; the domain stays

The work is per row: no shuffle, no Python. Defined results: a null text stays
null (nothing found); an empty one stays empty. Repeated rows get equal texts.
Other columns pass through; ``n_replaced`` of the input is replaced. Empty
tables give empty results.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"

DATE = r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4}"
IPV4 = r"(?:\d{1,3}\.){3}\d{1,3}"
SSN = r"\d{3}-\d{2}-\d{4}"
CARD = r"\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}"
IBAN = r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"
#: in small letters without blanks only, where words and digests would look alike
SMALL_IBAN = r"[a-z]{2}\d{2}[a-z0-9]{11,30}"
#: fixed values: the length of an IBAN by country, from the public register
IBAN_LENGTHS = """
ad24 ae23 al28 at20 az28 ba20 be16 bg22 bh22 br29 ch21 cr22 cy28 cz24 de22 dk18 do28 ee20 es24 fi18 fo18 fr27 gb22 ge22
gi23 gl18 gr27 gt28 hr21 hu28 ie22 il23 is26 it27 jo30 kw30 kz20 lb28 li21 lt20 lu20 lv21 mc27 md24 me22 mk19 mr27 mt31
mu30 nl18 no15 pk24 pl28 ps29 pt25 qa29 ro24 rs22 sa24 se24 si19 sk24 sm27 tn24 tr26 ua29 vg24 xk20""".split()
PHONE = r"(?:1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}|(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}"
#: at most 15 digits, so that numbers after a phone do not make it too long
WORLD = r"\+\d{1,3}[ .-]?(?:\(\d{1,5}\)|\d{1,5})(?:[ .-]?\d{2,5}){1,4}(?<!" + r"\d[ .()-]{0,2}" * 15 + r"\d)"
#: 64 characters before the @ and 255 behind it at most, as mail has it; loops
#: over one character class only, which Java's matcher runs without recursion
MAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-][A-Za-z0-9.-]{0,252}\.[A-Za-z]{2,63}"


def _alone(pattern: str, joins: str = "") -> str:
    """``pattern`` where no letter or digit touches it, and no digit beyond one
    of the characters ``joins``, which would make it part of a longer value."""
    before, after = (rf"|\d[{joins}]", rf"|[{joins}]\d") if joins else ("", "")
    return rf"(?<![\p{{L}}\p{{N}}+]{before})(?:{pattern})(?![\p{{L}}\p{{N}}]{after})"


#: a value must not be part of a longer number or word; only what its own
#: format is joined by counts, so a comma never hides a field's value
CANDIDATE = "|".join([
    rf"(?<![\p{{L}}\p{{N}}_.%+@-]){MAIL}(?![\p{{L}}\p{{N}}_-])",
    rf"(?<![\p{{L}}\p{{N}}+])(?:{WORLD})(?![\p{{L}}\p{{N}}]|[.-]\d)",
    rf"(?<![\p{{L}}\p{{N}}])(?:{IBAN})(?![\p{{L}}\p{{N}}])",
    rf"(?<![\p{{L}}\p{{N}}])(?:{SMALL_IBAN})(?![\p{{L}}\p{{N}}])",
    *(_alone(p, sep) for p, sep in zip(DATE.split("|"), "-/./-")),
    _alone(IPV4, "."), _alone(SSN, "-"),
    _alone(r"\d{13,19}", "."),                                  # a dot makes it a decimal number
    _alone(r"\d{4} \d{4} \d{4} \d{1,7}|\d{4} \d{6} \d{5}"),
    _alone(CARD.partition("|")[2], "-"), _alone(PHONE, ".-")])


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, "", -1), lambda c: c != "")


def _letters(s: Column) -> Column:
    """The letters and digits of a string."""
    return F.regexp_replace(s, "[^0-9A-Za-z]", "")


def _digits(s: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(s, "[^0-9]", "")), lambda c: c.cast("int"))


def _place(c: Column) -> Column:
    """0..61 for a letter or digit."""
    return F.instr(F.lit(ALPHABET), c) - 1


def _base(place: Column) -> Column:
    return F.when(place < 10, 0).when(place < 36, 10).otherwise(36)


def feistel(symbols: Column, radix: Column, key: str, kind: str) -> Column:
    """The keyed permutation of a list of whole numbers, each below its radix."""
    def turn(x: Column, r: Column) -> Column:
        others = F.concat_ws(",", F.transform(F.filter(x, lambda v, i: i % 2 != r % 2), lambda v: v.cast("string")))
        # a digest has 16 words of 32 bits, enough for 32 symbols of which half are shifted
        blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(x) - 1, F.lit(0)) / 32).cast("int"))
        digest = F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat(
            F.lit(f"{key}|{kind}|"), F.size(x).cast("string"), F.lit("|"), r.cast("string"), F.lit("|"), b.cast("string"), F.lit("|"),
            others), 512)), "")
        word = lambda d, i: F.conv(d.substr(1 + 8 * F.floor(i / 2).cast("int"), F.lit(8)), 16, 10).cast("bigint")
        return F.get(F.transform(F.array(digest), lambda d: F.transform(x, lambda v, i: F.when(
            i % 2 == r % 2, F.pmod(v + word(d, i), F.get(radix, i)).cast("int")).otherwise(v))), F.lit(0))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), symbols.cast("array<int>"), turn)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _permuted(s: Column, key: str, kind: str) -> Column:
    """Letters and digits of ``s`` permuted within their classes; all other
    characters stay where they are."""
    places = F.transform(_chars(_letters(s)), _place)
    old = F.transform(places, lambda p: p - _base(p))
    radix = F.transform(places, lambda p: F.when(p < 10, 10).otherwise(26))

    def fill(new: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            k = F.length(_letters(F.substring(s, 1, i)))
            return F.when(c.rlike("[0-9A-Za-z]"), F.substring(
                F.lit(ALPHABET), _base(_place(c)) + F.get(new, k) + 1, 1)).otherwise(c)
        return F.array_join(F.transform(_chars(s), one), "")

    return _let(feistel(old, radix, key, kind), fill)


def _luhn(digits: Column, shift: int) -> Column:
    """Luhn sum of a list of digits; ``shift`` 0 if the last one is the check
    digit, 1 if it has yet to come."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - i + shift) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def _card(m: Column, key: str) -> Column:
    head = m.substr(F.lit(1), F.length(m) - 1)
    new = _let(_permuted(head, key, "card"), lambda h: F.concat(
        h, F.pmod(-_luhn(_digits(h), 1), F.lit(10)).cast("string")))
    return F.when(_luhn(_digits(m), 0) % 10 == 0, new)


def _remainder97(s: Column) -> Column:
    """Remainder of an IBAN whose first four characters already stand last."""
    places = F.transform(_chars(F.upper(_letters(s))), _place)
    value = lambda p: F.when(p < 10, p).otherwise(p - 26)  # noqa: E731   A = 10
    return F.aggregate(places, F.lit(0), lambda a, p: (a * F.when(p < 10, 10).otherwise(100) + value(p)) % 97)


def _iban(m: Column, key: str) -> Column:
    land, body = m.substr(1, 2), m.substr(F.lit(5), F.length(m))
    new = _let(_permuted(body, key, "iban"), lambda b: F.concat(
        land, F.lpad((98 - _remainder97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b))
    known = F.array_contains(F.array(*map(F.lit, IBAN_LENGTHS)), F.concat(land, F.length(m).cast("string")))
    return F.when((_remainder97(F.concat(body, m.substr(1, 4))) == 1) & (m.rlike("^[A-Z]") | known), new)


def _phone(m: Column, key: str) -> Column:
    kept = F.coalesce(F.nullif(F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])", 0), F.lit("")),
                      F.regexp_extract(m, r"^(?:\+\d|1[ .-]|1(?=\())", 0))
    rest = m.substr(F.length(kept) + 1, F.length(m))
    american = rest.rlike(r"^[ (]*\d{3}\D{1,2}\d{3}\D\d{4}$") & ~m.startswith("+")
    digits = _letters(rest)
    none = (digits.substr(1, 3) == "000") | (digits.substr(4, 3) == "000") | (rest.rlike(r"^[\d ]+$") & digits.rlike("^(?:[01]|...[01])"))
    return F.when(F.size(_digits(m)).between(8, 15) & ~(american & none), F.concat(kept, _permuted(rest, key, "phone")))


def _mail(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.when(~m.substr(at, F.length(m)).contains(".."), F.concat(_permuted(m.substr(F.lit(1), at - 1), key, "mail"), m.substr(at, F.length(m))))


def _ints(m: Column, cut: str) -> Column:
    return F.transform(F.split(m, cut), lambda p: p.cast("int"))


def _ip(m: Column, key: str) -> Column:
    octets = _ints(m, r"\.")
    valid = F.forall(octets, lambda v: v < 256) & ~m.rlike(r"(?:^|\.)0\d")
    new = feistel(octets, F.array(*[F.lit(256)] * 4), key, "ip")
    return F.when(valid, F.array_join(F.transform(new, lambda v: v.cast("string")), "."))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.get(_ints(m, "-"), F.lit(i)) for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    old = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)
    return F.when(valid, _let(feistel(old, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn"), lambda x: F.concat(
        F.lpad((F.get(x, F.lit(0)) + F.when(F.get(x, F.lit(0)) >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lit("-"),
        F.lpad((F.get(x, F.lit(1)) + 1).cast("string"), 2, "0"), F.lit("-"),
        F.lpad((F.get(x, F.lit(2)) + 1).cast("string"), 4, "0"))))


def _date(m: Column, key: str) -> Column:
    """Year first; or day, month, year; with slashes and hyphens month, day,
    year where that is a date."""
    part = F.split(m, "[./-]")
    a, b, c = (F.get(part, F.lit(i)) for i in range(3))
    sep = F.regexp_extract(m, "[./-]", 0)
    two = lambda s: F.lpad(s, 2, "0")
    day = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, two(mo), two(d)), "yyyy-MM-dd")
    year_first = F.length(a) == 4
    american = day(c, a, b)
    us = ~year_first & (sep != ".") & american.isNotNull()
    when = F.when(year_first, day(a, b, c)).when(us, american).otherwise(day(c, b, a))
    start = F.to_date(F.lit("1700-01-01"))
    number = F.date_diff(when, start)
    old = F.array(F.floor(number / 5411).cast("int"), number % 5411)

    def write(x: Column) -> Column:
        new = F.date_add(start, F.get(x, F.lit(0)) * 5411 + F.get(x, F.lit(1)))
        y, mo, d = F.year(new).cast("string"), F.month(new).cast("string"), F.day(new).cast("string")
        like = lambda v, p: F.when(F.length(p) == 2, two(v)).otherwise(v)
        return F.when(year_first, F.concat(y, sep, two(mo), sep, two(d))).when(
            us, F.concat(like(mo, a), sep, like(d, b), sep, y)).otherwise(F.concat(like(d, a), sep, like(mo, b), sep, y))

    return F.when((number >= 0) & (number < 27 * 5411), _let(feistel(old, F.array(F.lit(27), F.lit(5411)), key, "date"), write))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a candidate; null if it fails its validation."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (F.when(m.contains("@"), _mail(m, key)).when(m.rlike(r"^\+"), _phone(m, key)).when(m.rlike("^[A-Za-z]"), _iban(m, key))
            .when(whole(DATE), _date(m, key)).when(whole(IPV4), _ip(m, key)).when(whole(SSN), _ssn(m, key))
            .when(whole(CARD), _card(m, key)).otherwise(_phone(m, key)))


def pseudonymise(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``df`` with personal data in the text replaced, and ``n_replaced``, the
    number of values replaced."""
    rest = [c for c in df.columns if c != "n_replaced"]
    text = F.col(f"`{text_col}`")
    found = df.select(*[F.col(f"`{c}`") for c in rest], F.when(
        text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).alias("__found"))
    # pairs (as found, replacement or null)
    found = found.withColumn("__new", F.transform("__found", lambda m: pseudonym(m, key)))
    gaps = F.split(text, CANDIDATE, -1)
    filled = F.array_join(F.transform(gaps, lambda g, i: F.concat(
        g, F.coalesce(F.get(F.col("__new"), i), F.get(F.col("__found"), i), F.lit("")))), "")
    n = F.size(F.filter("__new", lambda x: x.isNotNull()))
    n = F.when(F.col("__new").isNull(), 0).otherwise(n).cast("bigint")
    return found.select(*[F.when(n > 0, filled).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in rest],
                        n.alias("n_replaced"))
