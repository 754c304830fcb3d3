import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from quarry.llm import pii

KEY = "k"


def feistel(x, radix, kind):
    """The permutation written plainly."""
    x = list(x)
    for r in range(pii.ROUNDS):
        others = ",".join(str(v) for i, v in enumerate(x) if i % 2 != r % 2)
        d = b"".join(hashlib.sha512(f"{KEY}|{kind}|{len(x)}|{r}|{b}|{others}".encode()).digest() for b in range((len(x) + 31) // 32))
        x = [(v + int.from_bytes(d[4 * (i // 2):][:4], "big")) % radix[i] if i % 2 == r % 2 else v for i, v in enumerate(x)]
    return x


def in_classes(s, kind):
    """Letters and digits of a string permuted within their classes."""
    at = [i for i, c in enumerate(s) if c.isascii() and c.isalnum()]
    first = lambda c: "0" if c.isdigit() else "a" if c.islower() else "A"
    new = feistel([ord(s[i]) - ord(first(s[i])) for i in at], [10 if s[i].isdigit() else 26 for i in at], kind)
    out = list(s)
    for i, v in zip(at, new):
        out[i] = chr(ord(first(s[i])) + v)
    return "".join(out)


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s if c.isalnum())) % 97


def plain_iban(m):
    land, check, body = m[:2], m[2:4], m[4:]
    if mod97(body + land + check) != 1:
        return None
    new = in_classes(body, "iban")
    return f"{land}{98 - mod97(new + land + '00'):02}{new}"


def plain_ssn(m):
    a, g, n = map(int, m.split("-"))
    if a in (0, 666) or a > 899 or not g or not n:
        return None
    a, g, n = feistel([a - 1 - (a > 666), g - 1, n - 1], [898, 99, 9999], "ssn")
    return f"{a + 1 + (a >= 665):03}-{g + 1:02}-{n + 1:04}"


def plain_ip(m):
    parts = m.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    return ".".join(map(str, feistel(map(int, parts), [256] * 4, "ip")))


def plain_date(m):
    sep = re.search("[./-]", m)[0]
    a, b, c = m.split(sep)
    forms = [("y", "m", "d")] if len(a) == 4 else [("d", "m", "y")] if sep == "." else [("m", "d", "y"), ("d", "m", "y")]
    for form in forms:
        x = dict(zip(form, (a, b, c)))
        try:
            day = datetime.date(*(int(x[k]) for k in "ymd"))
        except ValueError:
            continue
        n = (day - datetime.date(1700, 1, 1)).days
        if not 0 <= n < 27 * 5411:
            return None
        q, r = feistel(divmod(n, 5411), [27, 5411], "date")
        new = datetime.date(1700, 1, 1) + datetime.timedelta(q * 5411 + r)
        v = {"y": new.year, "m": new.month, "d": new.day}
        return sep.join(f"{v[k]:0{len(x[k]) if len(x[k]) != 1 else 0}}" for k in form)
    return None


def plain_phone(m):
    kept = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d|1[ .-]|1(?=\()|", m)[0]
    rest = m[len(kept):]
    digits = re.sub(r"\D", "", rest)
    if m[0] != "+" and ("000" in (digits[:3], digits[3:6]) or (re.fullmatch(r"[\d ]+", rest) and (digits[0] in "01" or digits[3] in "01"))):
        return None
    return kept + in_classes(rest, "phone")


def plain_mail(m):
    local, _, domain = m.partition("@")
    return None if ".." in domain else in_classes(local, "mail") + "@" + domain


def luhn(s):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id int, text string, n_replaced string")
    return [r for r in pii.pseudonymise(df, KEY).orderBy("doc_id").collect()]


def test_cards_match_the_plain_permutation(spark):
    rnd = random.Random(1)
    numbers = ["".join(rnd.choice("0123456789") for _ in range(rnd.randint(13, 19))) for _ in range(300)]
    got = run(spark, [f"pay {n} now" for n in numbers])
    for n, r in zip(numbers, got):
        if not luhn(n):
            assert (r.text, r.n_replaced) == (f"pay {n} now", 0)
            continue
        head = "".join(map(str, feistel([int(c) for c in n[:-1]], [10] * (len(n) - 1), "card")))
        check = next(c for c in "0123456789" if luhn(head + c))
        assert (r.text, r.n_replaced) == (f"pay {head}{check} now", 1)


def test_permutations_have_no_collisions(spark):
    df = spark.range(256 * 40).select(
        F.concat_ws(".", F.lit("10"), F.floor(F.col("id") / 256).cast("string"), F.lit("0"), (F.col("id") % 256).cast("string")).alias("ip"),
        F.date_add(F.lit("1700-01-01").cast("date"), (F.col("id") * 14).cast("int")).cast("string").alias("day"))
    got = df.select("ip", "day", pii.pseudonym(F.col("ip"), KEY).alias("a"), pii.pseudonym(F.col("day"), KEY).alias("b")).collect()
    assert len({r.a for r in got}) == len({r.b for r in got}) == len(got)
    assert all(re.fullmatch(r"(\d+\.){3}\d+", r.a) and max(map(int, r.a.split("."))) < 256 for r in got)
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\d", r.b) and "1700" <= r.b[:4] <= "2099" for r in got)


def test_formats_validation_and_links(spark):
    texts = ["4111 1111 1111 1111 or 4111111111111111, 4111-1111-1111-1111; not 4111111111111112 nor a4111111111111111.",
             "+1 (017) 555-7713 and +1 017-555-7713; (415) 555-2671 or 415-555-2671; +49 30 901820",
             "at 233.254.104.120, not 300.1.1.1 or 1.2.3.4.5 or v01.2.3.4", "a.34@mail7.example.com, <X.y@z.org>",
             "DE89 3704 0044 0532 0130 00 = DE89370400440532013000, not DE89370400440532013001", "123-45-6789 not 000-12-3456 666-12-3456",
             "1990-02-28 28.02.1990 28.2.1990 2/28/1990 not 1990-02-30 31.02.1990 1600-01-01", None, "", "plain words, 12 of 2024 and 3.5"]
    out = run(spark, texts)
    assert [r.n_replaced for r in out] == [3, 5, 1, 2, 2, 1, 4, 0, 0, 0]
    t = [r.text for r in out]
    assert t[7:] == [None, "", texts[9]]
    shape = lambda s: re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"\d", "9", s)))
    for i in (0, 1, 3, 4, 5):
        assert shape(t[i]) == shape(texts[i])
    cards = re.findall(r"\d[\d -]{14,18}\d", t[0])
    assert len({re.sub(r"\D", "", c) for c in cards[:3]}) == 1 and luhn(re.sub(r"\D", "", cards[0])) and cards[3] == "4111111111111112"
    assert len({re.sub(r"\D", "", c) for c in t[1].split(";")[0].split(" and ")}) == 1
    assert "300.1.1.1 or 1.2.3.4.5 or v01.2.3.4" in t[2] and "233.254.104.120" not in t[2]
    assert t[3].endswith("@z.org>") and "a.34@" not in t[3]
    iban = t[4].split(" = ")[0].replace(" ", "")
    assert iban == t[4].split(" = ")[1].split(",")[0] and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    days = t[6].split(" not ")[0].split()
    y, m, d = days[0].split("-")
    assert days[1] == f"{d}.{m}.{y}" and [int(x) for x in days[3].split("/")] == [int(m), int(d), int(y)]
    assert t[6].endswith("not 1990-02-30 31.02.1990 1600-01-01")


def test_equal_values_stay_linked_and_keys_differ(spark):
    df = spark.createDataFrame([(i, f"{'x ' * i}mail me: tom.9@a.org " + "y" * 5000) for i in range(5)], "id int, text string")
    a = {re.search(r"\S+@a.org", r.text)[0] for r in pii.pseudonymise(df, "one").collect()}
    b = {re.search(r"\S+@a.org", r.text)[0] for r in pii.pseudonymise(df, "two").collect()}
    assert len(a) == len(b) == 1 and a != b
    assert pii.pseudonymise(df.limit(0), "one").collect() == []


def test_values_in_comma_separated_fields(spark):
    texts = ["17,4111111111111111,2024-01-31,x", "2024-01-31,2024-02-01", "SSN 123-45-6789,42", "7,123-45-6789,10.0.0.1,5,31.01.2024,9",
             "2024-01-31/2024-02-01", "30.01.2024-31.01.2024", "10.0.0.1/24", "4111 1111 1111 1111-123", "4111111111111111/12/27", "5,415-555-2671,6"]
    out = run(spark, texts)
    assert [r.n_replaced for r in out] == [2, 2, 1, 3, 2, 2, 1, 1, 1, 1]
    for old, r in zip(texts, out):
        assert re.sub(r"\d", "9", r.text) == re.sub(r"\d", "9", old) or "10.0.0.1" in old
    assert out[0].text.startswith("17,") and out[3].text.startswith("7,") and out[3].text.endswith(",9")


def test_phones_with_a_leading_1_or_numbers_behind(spark):
    out = run(spark, ["1-800-555-1234", "800-555-1234", "1 (800) 555-1234", "+1 415 555 2671 7 days", "+1 415 555 2671",
                      "+1 415 555 2671 12345 days"])
    assert [r.n_replaced for r in out] == [1] * 6
    t = [r.text for r in out]
    assert t[0] == "1-" + t[1] != "1-800-555-1234" and re.sub(r"\D", "", t[0]) == re.sub(r"\D", "", t[2])
    assert t[3] == t[4] + " 7 days" and t[5] == t[4] + " 12345 days" and t[4].startswith("+1 ") and t[4] != "+1 415 555 2671"


def test_parts_of_longer_values_stay(spark):
    texts = ["0.4111111111111111 4111111111111111.5", "1.2.3.4.5", "1-123-45-6789 123-45-6789-1", "5-4111-1111-1111-1111-5",
             "1-2024-01-31 2024-01-31-5 1.31.01.2024 1/2/28/1990", "21-800-555-1234 415-555-2671-5"]
    assert [(r.text, r.n_replaced) for r in run(spark, texts)] == [(t, 0) for t in texts]


def test_very_long_texts_of_every_pattern_end_well(spark):
    n = 1_000_000
    parts = ["x@a.", "x@" + "a." * 2000 + "com ", "a", "a.", "a@", "1", "1-", "1.", "12.", "+1 ", "+12-345 ", "(123) ", "(", "4111 ", "1234-", "DE89 ",
             "DE89", "AB12 3456 ", "12/", "2024-", "10.0.0.", "123-45-", "800-555-", "é@", "\u0660"]
    texts = [(x * (n // len(x) + 1))[:n] for x in parts] + ["x@" + "a." * 500_000 + "com", "x" * n + "@a.org", "x@" + "b" * n + ".org"]
    out = run(spark, texts)
    assert [len(r.text) == len(t) for r, t in zip(out, texts)] == [True] * len(texts)
    assert out[-1].n_replaced == out[-2].n_replaced == out[-3].n_replaced == 0


def test_mail_domains(spark):
    texts = ["a.b@x.y.example.com", "a.b@x..com", "a.b@-x.co.uk,", "a.b@x.c", "a.b@x.com.", "a.b@x.com.5", "a.b@x.com_"]
    assert [r.n_replaced for r in run(spark, texts)] == [1, 0, 1, 0, 1, 1, 0]


def test_every_format_matches_its_plain_version(spark):
    rnd = random.Random(7)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    two = lambda: str(rnd.randint(1, 31)).zfill(rnd.choice((1, 2)))
    cases = [("12-31-1999", plain_date), ("31-12-1999", plain_date), ("1-1-2024", plain_date)]
    for _ in range(60):
        cases.append((f"{digits(3)}-{digits(2)}-{rnd.choice((digits(4), '0000'))}", plain_ssn))
        cases.append((".".join(str(rnd.randint(0, 270)) for _ in range(4)), plain_ip))
        y = rnd.randint(1650, 2150)
        cases.append((rnd.choice((f"{y}-{rnd.randint(1, 13):02}-{rnd.randint(1, 31):02}", f"{y}/{rnd.randint(1, 13):02}/{rnd.randint(1, 31):02}",
                                  f"{two()}.{two()}.{y}", f"{two()}/{two()}/{y}", f"{two()}-{two()}-{y}")), plain_date))
        land, body = rnd.choice(("DE", "XX", "gb")), "".join(rnd.choice("0123456789ABC") for _ in range(18))
        body = body.lower() if land == "gb" else body
        iban = f"{land}{98 - mod97(body + land + '00'):02}{body}"
        cases.append((rnd.choice((iban, iban[:-1] + "0")), plain_iban))
        area, exchange = (rnd.choice((digits(3), "000", "100")) for _ in range(2))
        sep = rnd.choice(" .-")
        cases.append((rnd.choice(("", f"1{sep}")) + rnd.choice((f"{area}{sep}{exchange}{sep}{digits(4)}", f"({area}) {exchange}-{digits(4)}")), plain_phone))
        cases.append((f"+{rnd.randint(1, 999)} {digits(rnd.randint(2, 5))} {digits(rnd.randint(4, 5))}", plain_phone))
        name = "".join(rnd.choice("abcXYZ0189._%+-") for _ in range(rnd.randint(0, 63)))
        cases.append((f"a{name}@mail.example.org", plain_mail))
    got = run(spark, [f"see {m} here" for m, _ in cases])
    for (m, plain), r in zip(cases, got):
        want = plain(m)
        assert (r.text, r.n_replaced) == (f"see {want or m} here", int(want is not None)), m


def test_small_ibans_have_their_countrys_length(spark):
    texts = ["de89370400440532013000", "DE89370400440532013000", "de89 3704 0044 0532 0130 00"]
    small = "zz" + "00" + "1" * 18
    small = f"zz{98 - mod97(small[4:] + 'zz00'):02}{small[4:]}"
    out = run(spark, [*texts, small])
    assert [r.n_replaced for r in out] == [1, 1, 0, 0] and out[0].text[4:] == out[1].text[4:].lower()
    assert out[0].text != texts[0] and out[0].text.startswith("de") and mod97(out[0].text[4:] + out[0].text[:4]) == 1


def test_groups_of_numbers_are_no_phones(spark):
    texts = ["000-000-0000", "100 200 3000", "415-000-1234", "(000) 555-1234", "300 100 2000", "415 555 2671", "017-555-7713", "(132) 555-1352"]
    assert [r.n_replaced for r in run(spark, texts)] == [0, 0, 0, 0, 0, 1, 1, 1]
