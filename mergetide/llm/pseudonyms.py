"""Format-preserving Feistel pseudonyms for personal data, with DataFrame functions only.

One regular expression finds candidates; what validates (card numbers by issuer and check digit, addresses by octets, dates by
calendar, social security numbers by their number plan, phone numbers by their form and length) is permuted by an eight-round
Feistel network keyed by ``key``, inside its own format: a card stays a number of its issuer with a right check digit, a date a date of 1900 to 2099, an
address an address, an e-mail keeps its domain and its pattern of letters and digits, a secret its alphabet, a telephone number its
country and, at ten digits, valid area and exchange codes.  The same
value gets the same pseudonym in every document, so that documents stay linked, and the key undoes it.

The network works on two numbers modulo two moduli whose product is the size of the format, and adds a keyed hash
of one to the other in turn.  Edges: null text gives null; text without candidates is returned as it is, character by
character; candidates that do not validate stay; repeated values are replaced alike; very long texts are read whole;
dates outside 1900 to 2099 do not validate;
other columns of the input are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
CHUNK = 24
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: One pattern for each kind, tried in this order.
PATTERNS = {
    "secret": r"(?i:password|passwd|pwd|token|secret|api[_-]?key)[ ]{0,3}[=:][ ]{0,3}[\"']?[0-9A-Fa-f]{16,64}(?![0-9A-Za-z])",
    "access_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:[.][A-Za-z0-9-]{1,63}){0,5}[.][A-Za-z]{2,}",
    "ip": rf"(?<![0-9A-Za-z.]){OCTET}(?:[.]{OCTET}){{3}}(?![0-9A-Za-z]|[.][0-9])",
    "phone": r"(?<![0-9+])[+][0-9]{1,3}[ .-]?[(]?[0-9]{2,4}[)]?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9(])[(][0-9]{3}[)] ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])",
    "card": r"(?<![0-9A-Za-z-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7})(?![0-9A-Za-z-])",
}
#: Fixed value: country codes of one, two and three digits.
COUNTRY = "^[+](?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
#: Fixed value: how the numbers of payment cards begin.
ISSUERS = "^(?:4|5[0-9]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|30[0-5]|3[4-9]|6)"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
FIRST_DAY, DAYS = "1900-01-01", (319, 229)  # 319 * 229 days end with 2099-12-31
LETTERS, DIGITS_26 = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"


def let(x: Column, make: Callable[[Column], Column]) -> Column:
    """``make(x)`` with ``x`` told once, however often it is used: the driver's plan holds its expression once, and each row works it out once."""
    return F.get(F.transform(F.array(x), make), F.lit(0))


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, tweak: str) -> Column:
    """``struct(a, b)`` permuted over pairs below ``(size_a, size_b)``; both sizes at most 2**60."""

    def f(i: Column, x: Column, size: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), x.cast("string"), size["a"].cast("string"), size["b"].cast("string")), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def turn(acc: Column, i: Column, size: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(acc["a"] + f(i, acc["b"], size), size["a"])).otherwise(acc["a"]).alias("a"),
            F.when(even, acc["b"]).otherwise(F.pmod(acc["b"] + f(i, acc["a"], size), size["b"])).alias("b"),
        )

    def rounds(size: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), lambda acc, i: turn(acc, i, size))

    return let(F.struct(size_a.alias("a"), size_b.alias("b")), rounds)


def permuted(s: Column, radix: int, key: str, tweak: str) -> Column:
    """A string of digits of ``radix`` (26: letters a to z) permuted among those of its length, CHUNK digits at a time."""

    def number(x: Column) -> Column:
        x = F.translate(x, LETTERS, DIGITS_26) if radix == 26 else x
        return F.coalesce(F.conv(F.when(x != "", x), radix, 10).cast("long"), F.lit(0).cast("long"))

    def spell(n: Column, length: Column) -> Column:
        x = F.lpad(F.lower(F.conv(n.cast("string"), 10, radix)), length, "0")
        x = F.translate(x, DIGITS_26, LETTERS) if radix == 26 else F.upper(x) if radix == 36 else x
        return F.when(length > 0, x).otherwise(F.lit(""))

    def size(length: Column) -> Column:  # an exact power
        return F.element_at(F.array(*[F.lit(radix**i) for i in range(CHUNK // 2 + 1)]), length + 1)

    def one(part: Column) -> Column:
        n = F.length(part)
        left, right = F.ceil(n / 2).cast("int"), F.floor(n / 2).cast("int")
        done = feistel(number(F.substring(part, F.lit(1), left)), number(F.substring(part, left + 1, right)), size(left), size(right), key, tweak)
        return F.concat_ws("", F.transform(F.array(done), lambda d: F.concat(spell(d["a"], left), spell(d["b"], right))))

    def every(s: Column) -> Column:
        chunks = F.ceil(F.length(s) / CHUNK).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.greatest(chunks, F.lit(1)) - 1), lambda i: F.substring(s, i * CHUNK + 1, F.lit(CHUNK)))
        return F.when(F.length(s) > 0, F.array_join(F.transform(parts, one), "")).otherwise(F.lit(""))

    return let(s, every)


def only(s: Column, others: str) -> Column:
    return F.regexp_replace(s, others, "")


def respelled(s: Column, digits: Column, letters: Column) -> Column:
    """``s`` with its digits and letters replaced in order, case and everything else kept."""
    bound = F.struct(digits.alias("d"), letters.alias("l"))

    def each(b: Column, i: Column) -> Column:
        c, upto = F.substring(s, i, F.lit(1)), F.substring(s, F.lit(1), i)
        digit = F.substring(b["d"], F.length(only(upto, "[^0-9]")), F.lit(1))
        letter = F.substring(b["l"], F.length(only(upto, "[^A-Za-z]")), F.lit(1))
        return F.when(c.rlike("[0-9]"), digit).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c)

    return F.concat_ws("", F.transform(F.array(bound), lambda b: F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: each(b, i)), "")))


def luhn(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled; a valid number has a multiple of 10."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def card(m: Column, key: str) -> Column:
    """Numbers of a payment issuer with a right check digit; the first four digits, which name the issuer, stay."""
    digits = only(m, "[^0-9]")
    body = F.concat(F.substring(digits, 1, 4), permuted(F.substring(digits, F.lit(5), F.length(digits) - 5), 10, key, "card"))
    full = F.transform(F.array(body), lambda b: F.concat(b, F.pmod(10 - luhn(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))
    return F.when(digits.rlike(ISSUERS) & (luhn(digits) % 10 == 0), respelled(m, F.get(full, F.lit(0)), F.lit(""))).otherwise(m)


def phone(m: Column, key: str) -> Column:
    """The country code stays, with or without a separator after it.

    Numbers of ten digits without a country code or with +1 have an area and an exchange, neither of which begins with 0 or 1
    where the number is valid: each is numbered among those that begin alike (800 valid ones, 200 others), so that a valid number
    gets a valid one, however it is spelt.  Of other numbers the first digit stays, as national numbers begin with no 0.
    """
    apart = F.regexp_extract(m, r"^[+][0-9]{1,3}(?=[ .(-])", 0)
    code = F.when(apart != "", apart).otherwise(F.regexp_extract(m, COUNTRY, 0))
    return let(code, lambda code: renumbered(m, code, key))


def renumbered(m: Column, code: Column, key: str) -> Column:
    """A telephone number with its country code apart."""
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    digits = only(rest, "[^0-9]")
    planned = (F.length(digits) == 10) & code.isin("", "+1")
    area, exchange, line = (digits.substr(i, n).cast("long") for i, n in ((1, 3), (4, 3), (7, 4)))
    first = lambda x: F.when(x >= 200, F.lit(200)).otherwise(F.lit(0))
    many = lambda x: F.when(x >= 200, F.lit(800)).otherwise(F.lit(200))
    done = feistel(area - first(area), (exchange - first(exchange)) * 10_000 + line, many(area), many(exchange) * 10_000, key, "phone")
    bound = F.struct(done.alias("x"), first(area).alias("area"), first(exchange).alias("exchange"))
    spell = lambda n, width: F.lpad(n.cast("string"), width, "0")

    def text(d: Column) -> Column:
        return F.concat(spell(d["x"]["a"] + d["area"], 3), spell(F.floor(d["x"]["b"] / 10_000) + d["exchange"], 3), spell(d["x"]["b"] % 10_000, 4))

    other = F.concat(F.substring(digits, 1, 1), permuted(F.substring(digits, F.lit(2), F.length(digits)), 10, key, "phone"))
    new = F.when(planned, F.concat_ws("", F.transform(F.array(bound), text))).otherwise(other)
    return F.when(F.length(only(m, "[^0-9]")).between(8, 15), F.concat(code, respelled(rest, new, F.lit("")))).otherwise(m)


def ssn(m: Column, key: str) -> Column:
    """Valid numbers are numbered without gaps (898 areas, 99 groups, 9999 serials), so that a pseudonym is valid as well."""
    area, group, serial = (only(m, "[^0-9]").substr(a, n).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    done = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    spell = lambda n, width: F.lpad(n.cast("string"), width, "0")

    def text(d: Column) -> Column:
        first = d["a"] + F.when(d["a"] >= 665, 2).otherwise(1)
        return F.concat(spell(first, 3), F.lit("-"), spell(F.floor(d["b"] / 9999) + 1, 2), F.lit("-"), spell(d["b"] % 9999 + 1, 4))

    return F.when(valid, F.concat_ws("", F.transform(F.array(done), text))).otherwise(m)


def address(m: Column, key: str) -> Column:
    o = [F.get(F.split(m, "[.]"), F.lit(i)).cast("long") for i in range(4)]
    done = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip")
    return F.concat_ws("", F.transform(F.array(done), lambda d: F.concat_ws(".", F.floor(d["a"] / 256).cast("string"), (d["a"] % 256).cast("string"), F.floor(d["b"] / 256).cast("string"), (d["b"] % 256).cast("string"))))


def date(m: Column, key: str) -> Column:
    """Year first, or day and month first: day before month only where the second number cannot be a day's month."""
    forms = [("yyyy-MM-dd", m.contains("-")), ("dd/MM/yyyy", m.contains("/") & (F.try_to_timestamp(m, F.lit("MM/dd/yyyy")).isNull())), ("MM/dd/yyyy", m.contains("/"))]
    out = F.lit(None).cast("string")
    for form, chosen in reversed(forms):
        n = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date"))
        done = feistel(F.floor(n / DAYS[1]), n % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date")
        text = F.concat_ws("", F.transform(F.array(done), lambda d: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (d["a"] * DAYS[1] + d["b"]).cast("int")), form)))  # noqa: B023
        out = F.when(chosen, F.when(n.between(0, DAYS[0] * DAYS[1] - 1), text)).otherwise(out)
    return F.coalesce(out, m)


def email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    local, domain = F.substring(m, F.lit(1), at - 1), F.substring(m, at, F.length(m))
    return F.concat(respelled(local, permuted(only(local, "[^0-9]"), 10, key, "email"), permuted(F.lower(only(local, "[^A-Za-z]")), 26, key, "email")), domain)


def secret(m: Column, key: str) -> Column:
    """A value with a capital letter gets capitals, and the same digits as in small letters."""
    value = F.regexp_extract(m, "[0-9A-Fa-f]{16,}$", 0)
    new = permuted(F.lower(value), 16, key, "secret")
    return F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), F.when(value.rlike("[A-F]"), F.upper(new)).otherwise(new))


def access_key(m: Column, key: str) -> Column:
    return F.concat(F.lit("AKIA"), permuted(F.substring(m, 5, 16), 36, key, "access_key"))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match; the match itself where it does not validate."""
    whole = {k: f"^(?:{p.replace('(?<![A-Za-z0-9._%+-])', '')})$" for k, p in PATTERNS.items()}
    makers = {"secret": secret, "access_key": access_key, "email": email, "ip": address, "phone": phone, "ssn": ssn, "date": date, "card": card}
    out = F.when(F.lit(False), m)
    for kind, make in makers.items():
        out = out.when(m.rlike(whole[kind]), make(m, key))
    return out.otherwise(m)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_replaced") -> DataFrame:
    """``docs`` with its text column rewritten; ``count_col`` (if not None): values replaced in each row."""
    found_col, new_col = "_found", "_new"
    while {found_col, new_col} & {c.lower() for c in docs.columns}:
        found_col, new_col = found_col + "_", new_col + "_"
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, count_col)]
    text, found, new = F.col(text_col), F.col(found_col), F.col(new_col)
    some = text.rlike("[0-9]{3}|@|[0-9][.][0-9]|AKIA|(?i:password|passwd|pwd|token|secret|key)")  # every kind of value holds one of these
    d = docs.select(*kept, text, F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias(found_col))
    d = d.select(*kept, text, found, F.when(F.size(found) > 0, F.transform(found, lambda m: pseudonym(m, key))).alias(new_col))
    between = F.split(text, ANY, -1)
    joined = F.array_join(F.transform(F.arrays_zip(between.alias("p"), new.alias("r")), lambda x: F.concat(x["p"], F.coalesce(x["r"], F.lit("")))), "")
    changed = F.filter(F.arrays_zip(found.alias("p"), new.alias("r")), lambda x: x["p"] != x["r"])
    count = F.when(new.isNotNull(), F.coalesce(F.size(changed), F.lit(0))).otherwise(F.lit(0)).cast("long")
    done = d.select(*kept, F.when(new.isNotNull(), joined).otherwise(text).alias(text_col), *([count.alias(count_col)] if count_col else []))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns if c != count_col], *([F.col(count_col)] if count_col else []))
