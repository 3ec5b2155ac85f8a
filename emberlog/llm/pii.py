"""Pseudonyms for personal data that keep its format.

Numbers and dates that pass their validation (Luhn sum, remainders of
account numbers, calendar, octets, number plans) are permuted within all values of their format by a keyed
Feistel network: the pseudonym is valid too, equal values get equal
pseudonyms in all documents, and different values different ones. A value is
a pair (l, r) below (a, b); a round adds a keyed hash of one half to the
other, modulo its range, which is a bijection whatever the ranges are. Local
parts of e-mail addresses are permuted as base-36 numbers; secrets get a
keyed digest of their length. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import table

ROUNDS = 8
#: Only the registered query takes this key; jobs pass in a secret of their own.
DEMO_KEY = "emberlog demonstration key"
#: 400 Gregorian years repeat exactly: 146,097 = 189 * 773 days.
FIRST_DAY, DAYS = "1700-01-01", (189, 773)

# What may repeat without end is possessive: Java repeats such groups in a loop, others by recursion, which a long text would exhaust.
_PATTERN = "|".join(
    [
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?[A-Za-z0-9+/_.-]{8,}+",
        r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)|(?<!\d)\d{4}/\d{2}/\d{2}(?!\d)|(?<!\d)\d{2}\.\d{2}\.\d{4}(?!\d)|(?<!\d)\d{2}/\d{2}/\d{4}(?!\d)",
        r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
        r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
        r"(?<![\d.,])\d{13,19}(?!\d)|(?<!\d)\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}(?!\d)|(?<!\d)\d{4}([ -])\d{6}\2\d{4,5}(?!\d)",
        r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)",
        r"(?<![\d.-])(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?!\d)",
    ]
)
_HEX = 15


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string."""
    each = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: F.struct(F.substring(F.reverse(digits), i, F.lit(1)).cast("int").alias("d"), (i % 2 == 0).alias("twice")),
    )
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x["twice"], x["d"] * 2 - F.when(x["d"] > 4, 9).otherwise(0)).otherwise(x["d"]))


def _mod97(code: Column) -> Column:
    """The remainder of an account number, letters counting from 10."""
    number = F.array_join(F.transform(F.split(code, ""), lambda c: F.conv(c, 36, 10)), "")
    return F.aggregate(F.split(number, ""), F.lit(0), lambda s, d: (s * 10 + d.cast("int")) % 97)


def _compact(m: Column) -> Column:
    return F.replace(m, F.lit(" "), F.lit(""))


def _date(m: Column) -> Column:
    """The date that m is, or null; of two numbers before a slash and a year, the one over 12 is the day, else the first."""
    us = F.substring(m, 4, 2).cast("int") > 12
    return (
        F.when(m.rlike(r"^\d{4}-"), F.try_to_date(m, "yyyy-MM-dd"))
        .when(m.rlike(r"^\d{4}/"), F.try_to_date(m, "yyyy/MM/dd"))
        .when(m.rlike(r"^\d\d\."), F.try_to_date(m, "dd.MM.yyyy"))
        .when(m.rlike(r"^\d\d/") & us, F.try_to_date(m, "MM/dd/yyyy"))
        .when(m.rlike(r"^\d\d/"), F.try_to_date(m, "dd/MM/yyyy"))
    )


def _date_text(day: Column, like: Column) -> Column:
    us = F.substring(like, 4, 2).cast("int") > 12
    return (
        F.when(like.rlike(r"^\d{4}-"), F.date_format(day, "yyyy-MM-dd"))
        .when(like.rlike(r"^\d{4}/"), F.date_format(day, "yyyy/MM/dd"))
        .when(like.rlike(r"^\d\d\."), F.date_format(day, "dd.MM.yyyy"))
        .when(us, F.date_format(day, "MM/dd/yyyy"))
        .otherwise(F.date_format(day, "dd/MM/yyyy"))
    )


def _local(m: Column) -> Column:
    """Letters and digits of an address's local part, in lower case; of more than 20 the last 20."""
    return F.right(F.regexp_replace(F.lower(F.substring_index(m, "@", 1)), "[^a-z0-9]", ""), F.lit(20))


def _power(base: int, n: Column) -> Column:
    return F.round(F.pow(F.lit(float(base)), n)).cast("long")


def _kind(m: Column, digits: Column) -> Column:
    """What m is, if it is valid."""
    day, n = _date(m), F.length(digits)
    octets = F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255)
    ten = F.right(digits, F.lit(10))
    return (
        F.when(m.contains("@"), F.when(F.length(_local(m)) > 0, F.lit("email")))
        .when(m.rlike(r"^[A-Z]{2}\d\d ?[A-Z0-9]{4}"), F.when(_mod97(F.concat(F.substring(_compact(m), 5, 40), F.substring(_compact(m), 1, 4))) == 1, F.lit("iban")))
        .when(m.rlike(r"^[A-Za-z]"), F.lit("secret"))
        .when(m.rlike(r"^(\d{4}-\d\d-|\d{4}/\d\d/|\d\d\.\d\d\.\d{4}|\d\d/)"), F.when((day >= F.lit(FIRST_DAY)) & (day < F.lit("2100-01-01")), F.lit("date")))
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(octets, F.lit("ip")))
        .when(
            m.rlike(r"^\d{3}-\d{2}-\d{4}$"),
            F.when(~m.rlike(r"^(000|666|9)") & ~m.rlike(r"^...-00") & ~m.rlike(r"0000$"), F.lit("ssn")),
        )
        .when(m.startswith("+") & (n == 11) & m.startswith("+1"), F.when(ten.rlike("^[2-9]..[2-9]"), F.lit("phone")).otherwise("number"))
        .when(m.startswith("+"), F.when((n >= 8) & (n <= 15), F.lit("number")))
        .when(n >= 13, F.when(_luhn(digits) % 10 == 0, F.lit("card")))
        .when(n == 10, F.when(ten.rlike("^[2-9]..[2-9]"), F.lit("phone")))
    )


def _value(x: Column) -> Column:
    """x (m, digits, kind) as l, r below a, b."""
    m, digits, kind = x["m"], x["digits"], x["kind"]
    n, none = F.length(digits), F.lit(0).cast("long")

    def pair(l: Column, r: Column, a: Column, b: Column) -> Column:  # noqa: E741
        return F.struct(*(c.cast("long").alias(k) for c, k in zip((l, r, a, b), "lrab", strict=True)))

    def halves(of: Column, base: int) -> Column:
        size = F.length(of)
        u = F.floor(size / 2).cast("int")
        number = lambda s: F.coalesce(F.conv(F.when(F.length(s) > 0, s), base, 10).cast("long"), none)
        return pair(number(F.substring(of, F.lit(1), u)), number(F.substring(of, u + 1, size)), _power(base, u), _power(base, size - u))

    days = F.datediff(_date(m), F.lit(FIRST_DAY))
    octet = F.transform(F.split(m, r"\."), lambda o: o.cast("long"))
    area = F.substring(digits, 1, 3).cast("long")
    rest = (F.substring(digits, 4, 2).cast("long") - 1) * 9999 + F.substring(digits, 6, 4).cast("long") - 1
    ten = F.right(digits, F.lit(10))
    line = (F.substring(ten, 4, 3).cast("long") - 200) * 10000 + F.substring(ten, 7, 4).cast("long")
    return (
        F.when(kind == "email", halves(_local(m), 36))
        .when(kind == "date", pair(F.floor(days / DAYS[1]), days % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1])))
        .when(kind == "ip", pair(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], F.lit(65536), F.lit(65536)))
        .when(kind == "ssn", pair(area - 1 - F.when(area > 666, 1).otherwise(0), rest, F.lit(898), F.lit(99 * 9999)))
        .when(kind == "phone", pair(F.substring(ten, 1, 3).cast("long") - 200, line, F.lit(800), F.lit(800 * 10000)))
        .when(kind == "number", halves(F.right(digits, F.lit(7)), 10))
        .when(kind == "card", halves(F.substring(digits, F.lit(2), n - 2), 10))
        .when(kind == "iban", halves(F.substring(digits, F.lit(3), n), 10))
    )


def _hash(key: str, *parts: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts)), 256), 1, _HEX), 16, 10).cast("long")


def _permuted(v: Column, kind: Column, key: str, rounds: int) -> Column:
    """The Feistel network on l, r."""
    start = F.struct(v["l"].alias("l"), v["r"].alias("r"))

    def turn(s: Column, i: Column) -> Column:
        left = F.transform(F.array(F.pmod(s["l"] + F.pmod(_hash(key, kind, i, v["a"], v["b"], F.lit("l"), s["r"]), v["a"]), v["a"])), lambda x: x)
        both = F.transform(
            left,
            lambda x: F.struct(x.alias("l"), F.pmod(s["r"] + F.pmod(_hash(key, kind, i, v["a"], v["b"], F.lit("r"), x), v["b"]), v["b"]).alias("r")),
        )
        return both[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn)


def _laid_out(new: Column, like: Column, of: str) -> Column:
    """The characters of new in the places of like's characters that match of."""
    return F.array_join(
        F.transform(
            F.split(like, ""),
            lambda c, i: F.when(c.rlike(of), F.substring(new, F.length(F.regexp_replace(F.substring(like, F.lit(1), i + 1), f"(?!{of}).", "")), F.lit(1))).otherwise(c),
        ),
        "",
    )


def _pseudonym(x: Column, key: str) -> Column:
    """x (m, digits, kind, and l, r after the network) as text."""
    m, digits, kind, p = x["m"], x["digits"], x["kind"], x["p"]
    n = F.length(digits)

    def halves(of: Column, base: int) -> Column:
        size = F.length(of)
        u = F.floor(size / 2).cast("int")
        text = lambda v, k: F.when(k > 0, F.lpad(F.lower(F.conv(v.cast("string"), 10, base)), k, F.lit("0"))).otherwise("")
        return F.concat(text(p["l"], u), text(p["r"], size - u))

    local = F.substring_index(m, "@", 1)
    letters = F.regexp_replace(F.lower(local), "[^a-z0-9]", "")
    extra = F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("long"), letters), 512), F.lit(1), F.greatest(F.length(letters) - 20, F.lit(0)))
    named = F.concat(_laid_out(F.concat(F.rpad(extra, F.greatest(F.length(letters) - 20, F.lit(0)), F.lit("0")), halves(_local(m), 36)), local, "[A-Za-z0-9]"), F.substring(m, F.length(local) + 1, F.length(m)))
    value = F.regexp_extract(m, r"[A-Za-z0-9+/_.-]+$", 0)
    hidden = F.repeat(F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), value), 512), F.ceil(F.length(value) / 128).cast("int"))
    secret = F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), F.substring(hidden, F.lit(1), F.length(value)))
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * DAYS[1] + p["r"]).cast("int"))
    octets = F.concat_ws(".", *(c.cast("string") for c in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)))
    pad = lambda v, k: F.lpad(v.cast("string"), k, "0")
    area = p["l"] + 1
    ssn = F.concat_ws("-", pad(area + F.when(area >= 666, 1).otherwise(0), 3), pad(F.floor(p["r"] / 9999) + 1, 2), pad(p["r"] % 9999 + 1, 4))
    ten = F.concat(pad(p["l"] + 200, 3), pad(F.floor(p["r"] / 10000) + 200, 3), pad(p["r"] % 10000, 4))
    phone = F.concat(F.substring(digits, F.lit(1), n - 10), ten)
    number = F.concat(F.substring(digits, F.lit(1), n - 7), halves(F.right(digits, F.lit(7)), 10))
    payload = F.concat(F.substring(digits, 1, 1), halves(F.substring(digits, F.lit(2), n - 2), 10))
    card = F.concat(payload, F.pmod(10 - _luhn(F.concat(payload, F.lit("0"))) % 10, F.lit(10)).cast("string"))
    account = _laid_out(halves(F.substring(digits, F.lit(3), n), 10), F.substring(_compact(m), 5, 40), "[0-9]")
    country = F.substring(m, 1, 2)
    check = F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    iban = _laid_out(F.concat(country, check, account), m, "[A-Z0-9]")
    return (
        F.when(kind == "email", named)
        .when(kind == "iban", iban)
        .when(kind == "secret", secret)
        .when(kind == "date", _date_text(day, m))
        .when(kind == "ip", octets)
        .when(kind == "ssn", ssn)
        .when(kind == "phone", _laid_out(phone, m, "[0-9]"))
        .when(kind == "number", _laid_out(number, m, "[0-9]"))
        .when(kind == "card", _laid_out(card, m, "[0-9]"))
        .otherwise(m)
    )


def pseudonymize(docs: DataFrame, key: str, column: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """docs with pseudonyms in column, and with pii_kinds (one kind for each replaced value, in order; replaces a column of that name).

    Rows are independent, so repeated rows and null ids need no care. A null
    or empty text stays as it is and has no kinds. What looks like a number
    but fails its validation stays. Of a number with an international prefix
    that is no ten-digit one the last seven digits are permuted, of a local part of an address
    its last 20 letters and digits (the ones before them are hashed). A text is worked on as a
    whole, however long; no rows give no rows; columns of any name stay.
    Nothing is joined or shuffled. The key is a literal of the plan, so event
    logs and plans of a job that uses it must be kept like the key.
    """
    docs = docs.drop("pii_kinds")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(column).alias("text"))
    text = F.col("text")
    some = F.coalesce(text.rlike("[0-9@=:]"), F.lit(False))
    pattern = F.lit(_PATTERN)
    found = F.when(some, F.regexp_extract_all(text, pattern, F.lit(0)))
    with_found = packed.withColumn("found", found)
    parsed = F.transform("found", lambda m: F.struct(m.alias("m"), _digits(m).alias("digits")))
    parsed = F.transform(parsed, lambda x: F.struct(x["m"].alias("m"), x["digits"].alias("digits"), _kind(x["m"], x["digits"]).alias("kind")))
    valued = F.transform(parsed, lambda x: F.struct(x["m"].alias("m"), x["digits"].alias("digits"), x["kind"].alias("kind"), _value(x).alias("v")))
    moved = F.transform(
        valued,
        lambda x: F.struct(
            x["m"].alias("m"), x["digits"].alias("digits"), x["kind"].alias("kind"),
            F.when(x["v"].isNotNull(), _permuted(x["v"], x["kind"], key, rounds)).alias("p"),
        ),
    )
    named = F.transform(moved, lambda x: F.struct(x["kind"].alias("kind"), _pseudonym(x, key).alias("name")))
    with_named = with_found.withColumn("named", F.when(F.size("found") > 0, named))
    parts = F.split(text, _PATTERN, -1)
    joined = F.array_join(F.flatten(F.zip_with(parts, F.col("named"), lambda p, x: F.array(p, F.coalesce(x["name"], F.lit(""))))), "")
    kinds = F.filter(F.transform("named", lambda x: x["kind"]), lambda k: k.isNotNull())
    changed = F.when(F.col("named").isNotNull(), joined).otherwise(text)
    columns = [changed.alias(c) if c == column else F.col("row").getField(c).alias(c) for c in docs.columns]
    return with_named.select(*columns, F.coalesce(kinds, F.array().cast("array<string>")).alias("pii_kinds"))


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms, under the demonstration key. See pseudonymize() for odd rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, DEMO_KEY).select(
        "doc_id", "text", F.size("pii_kinds").cast("long").alias("n_replaced"), F.array_join("pii_kinds", ",").alias("kinds")
    )
