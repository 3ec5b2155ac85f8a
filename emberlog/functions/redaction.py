"""Redaction of personal data and secrets in log text.

Each kind is one expression: text in, (text, count) out. They apply in a
fixed order, each to what the one before left, so counts are taken on the
text that the pattern really sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns and placeholders.
JWT = r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+"
BEARER = r"(?i)((?:bearer|token|auth(?:orization)?)\s+)([A-Za-z0-9+/=_\-\.]{20,})"
AWS_KEY = r"(?<![A-Z0-9])AKIA[0-9A-Z]{16}(?![A-Z0-9])"
PASSWORD = (
    r"(?i)((?:password|passwd|pwd|secret(?:_?key)?|api_?key|access_?key|private_?key|credentials?|secret_?access)"
    r"\s*[:=]\s*)([\"']?)(\S+)\2"
)
CARD = (
    r"(?<!\d)(?:4[0-9]{12}(?:[0-9]{3,6})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}"
    r"|6(?:011|5[0-9]{2})[0-9]{12,15}|(?:[0-9]{4}[-\s]?){3}[0-9]{4,7})(?!\d)"
)
SSN = r"(?<!\d)(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?!\d)"
# A local part is only tried where it begins, so that a long word without @ is read once.
EMAIL = r"(?:(?<![a-zA-Z0-9._%+\-])|\G)[a-zA-Z0-9._%+\-]++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"(?<!\d)(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}(?!\d)"
_OCTET = r"0*(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PRIVATE_IP = rf"(?<!\d)(?:0?10\.{_OCTET}|127\.{_OCTET}|172\.0?(?:1[6-9]|2\d|3[01])|192\.168)\.{_OCTET}\.{_OCTET}(?!\d)"
PUBLIC_IP = rf"(?<!\d){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}(?!\d)"
INTERNAL = "[INTERNAL_IP]"
PLACEHOLDERS = {
    "jwt": "[REDACTED_JWT]",
    "bearer": "[REDACTED_API_KEY]",
    "aws": "[REDACTED_AWS_KEY]",
    "password": "[REDACTED_PASSWORD]",
    "card": "[REDACTED_CC]",
    "ssn": "[REDACTED_SSN]",
    "email": "[REDACTED_EMAIL]",
    "phone": "[REDACTED_PHONE]",
    "ipv4": "[REDACTED_IP]",
}
_PATTERNS = {
    "jwt": (JWT, ""),
    "bearer": (BEARER, "$1"),
    "aws": (AWS_KEY, ""),
    "ssn": (SSN, ""),
    "email": (EMAIL, ""),
    "phone": (PHONE, ""),
}


# What each match of a kind contains, without look-around: far cheaper than its pattern, and found in a text wherever it is in a part of it.
_SECRET_NAME = r"(?i:pass(?:word|wd)|pwd|secret|(?:api|access|private)_?key|credential)"
_HINTS = {
    "bearer": r"(?i:bearer|token|auth)",
    "password": _SECRET_NAME,
    "card": r"\d{4}[-\s]?\d{4}[-\s]?\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone": r"\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "ipv4": r"\d\.\d++\.\d++\.\d",
}
#: What each match of any kind contains; those of digits share their first ones.
_HINT = (
    r"@|eyJ|AKIA|\d(?:\.\d++\.\d++\.\d|\d\d(?:-\d{2}-\d{4}|\)?[-.\s]?\d{3}[-.\s]?\d{4}|\d[-\s]?\d{4}[-\s]?\d{4}))"
    rf"|{_HINTS['bearer']}|{_SECRET_NAME}"
)


def luhn_valid(number: Column) -> Column:
    """At least 13 digits, separators aside, with a valid Luhn sum."""
    digits = F.regexp_replace(number, r"[\s\-]", "")
    return F.when(F.length(digits) >= 13, F.call_function("luhn_check", digits)).otherwise(F.lit(False))


def _result(text: Column, n: Column) -> Column:
    return F.struct(text.alias("text"), n.cast("int").alias("n"))


def _possible(text: Column, kind: str) -> Column:
    """Whether a text has what every match of the kind contains; far cheaper than its pattern."""
    literal = {"jwt": "eyJ", "aws": "AKIA", "email": "@"}.get(kind)
    if literal:
        return text.contains(literal)
    if kind in ("bearer", "card", "password"):
        pattern = {"bearer": BEARER, "card": CARD, "password": PASSWORD}[kind]
        return text.rlike(_HINTS[kind]) & text.rlike(pattern)
    return text.rlike(_HINTS[kind])


def redact_kind(text: Column, kind: str) -> Column:
    """(text, n): the text without one kind of data, and how many were replaced. Private addresses are replaced but not counted. A null text stays null, and so does its count."""
    none = _result(text, F.when(text.isNotNull(), 0))
    return F.when(_possible(text, kind), _replaced(text, kind)).otherwise(none)


def _replaced(text: Column, kind: str) -> Column:
    placeholder = PLACEHOLDERS[kind]
    if kind in _PATTERNS:
        pattern, before = _PATTERNS[kind]
        return _result(F.regexp_replace(text, pattern, before + placeholder), F.regexp_count(text, F.lit(pattern)))
    if kind == "password":
        return _result(F.regexp_replace(text, PASSWORD, f"$1$2{placeholder}$2"), F.regexp_count(text, F.lit(PASSWORD)))
    if kind == "ipv4":
        left = F.regexp_replace(text, PRIVATE_IP, INTERNAL)
        return _result(F.regexp_replace(left, PUBLIC_IP, placeholder), F.regexp_count(left, F.lit(PUBLIC_IP)))
    # cards: what lies between candidates is joined with each candidate or its placeholder
    found = F.regexp_extract_all(text, F.lit(CARD), F.lit(0))
    parts = F.split(text, CARD, -1)
    named = F.transform(found, lambda m: F.when(luhn_valid(m), F.lit(placeholder)).otherwise(m))
    joined = F.array_join(F.flatten(F.zip_with(parts, named, lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))), "")
    return _result(F.when(F.size(found) > 0, joined).otherwise(text), F.size(F.filter(found, luhn_valid)))


def with_redaction(df: DataFrame, column: str, prefix: str = "redacted") -> DataFrame:
    """df with {prefix}_text, {prefix}_count and {prefix}_types (distinct placeholders, sorted) of a text column; a null text stays null with a count of 0.

    Lambdas bind what each kind leaves, so the expression stays as long as the
    list of kinds wherever the optimizer moves it, a filter on the result too.
    """
    names = F.array(*map(F.lit, PLACEHOLDERS.values()))
    found = F.filter(F.transform("_redacted.counts", lambda n, k: F.when(n > 0, F.get(names, k))), lambda x: x.isNotNull())
    none = F.struct(F.col(column).alias("text"), F.array_repeat(F.lit(0), len(PLACEHOLDERS)).alias("counts"))
    out = df.withColumn("_redacted", F.when(F.col(column).rlike(_HINT), redacted_counts(F.col(column))).otherwise(none))
    return (
        out.withColumn(f"{prefix}_text", F.col("_redacted.text"))
        .withColumn(f"{prefix}_count", F.aggregate("_redacted.counts", F.lit(0), lambda s, n: s + n))
        .withColumn(f"{prefix}_types", F.array_sort(found))
        .drop("_redacted")
    )


def redacted_counts(text: Column) -> Column:
    """(text, counts): a text without any of the kinds, and how many of each were replaced."""

    def step(kind: str):
        def act(s: Column) -> Column:
            return _bound(redact_kind(s["text"], kind), lambda done: F.struct(done["text"].alias("text"), F.concat(s["counts"], F.array(F.coalesce(done["n"], F.lit(0)))).alias("counts")))

        return act

    out = F.struct(text.alias("text"), F.array().cast("array<int>").alias("counts"))
    for kind in PLACEHOLDERS:
        out = _bound(out, step(kind))
    return out


def _bound(value: Column, act) -> Column:
    """act(value), with the value evaluated once however often act uses it."""
    return F.get(F.transform(F.array(value), act), F.lit(0))


def redacted(text: Column) -> Column:
    """(text, n) of a text without any of the kinds. Each step's lambda binds what the step before left."""

    def step(kind: str):
        def act(s: Column) -> Column:
            return _bound(redact_kind(s["text"], kind), lambda done: _result(done["text"], s["n"] + F.coalesce(done["n"], F.lit(0))))

        return act

    out = _result(text, F.lit(0))
    for kind in PLACEHOLDERS:
        out = _bound(out, step(kind))
    return out


#: A string literal of a JSON text, with its quotes. Possessive, as Java repeats such groups in a loop rather than by recursion.
_LITERAL = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def _counted(value: Column, n: Column) -> Column:
    return F.struct(value.alias("value"), F.coalesce(n, F.lit(0)).cast("int").alias("n"))


def _parted(text: Column) -> Column:
    """(between, found): of a JSON object or list what stands between its string literals, and these; of another text nothing, and itself."""
    nested = text.rlike(r"(?s)^\s*+[{\[]") & F.try_parse_json(text).isNotNull()
    plain = F.struct(F.array().cast("array<string>").alias("between"), F.array(text).alias("found"))
    return F.when(nested, F.struct(F.split(text, _LITERAL, -1).alias("between"), F.regexp_extract_all(text, F.lit(_LITERAL), F.lit(0)).alias("found"))).otherwise(plain)


def _redacted_parts(part: Column) -> Column:
    """(value, n) of what _parted() made: each text redacted for itself, so that JSON stays JSON."""
    guarded = lambda x: F.when(x.rlike(_HINT), redacted(x)).otherwise(_result(x, F.lit(0)))

    def whole(done: Column) -> Column:
        joined = F.array_join(F.zip_with(part["between"], done, lambda b, d: F.concat(b, F.coalesce(d["text"], F.lit("")))), "")
        text = F.when(F.size(part["between"]) > 0, joined).otherwise(F.get(done, F.lit(0))["text"])
        return _counted(text, F.aggregate(done, F.lit(0), lambda s, d: s + F.coalesce(d["n"], F.lit(0))))

    return _bound(F.transform(part["found"], guarded), whole)


def redact_value(value: Column, kind: T.DataType) -> Column:
    """(value, n) of a value of any type with its texts redacted, and how many were: texts, and lists, maps and structs down to their texts; other values stay."""
    if isinstance(kind, T.StringType):
        return F.when(value.rlike(_HINT), _bound(_parted(value), _redacted_parts)).otherwise(_counted(value, F.lit(0)))
    if isinstance(kind, T.ArrayType):

        def items(done: Column) -> Column:
            return _counted(F.transform(done, lambda x: x["value"]), F.aggregate(done, F.lit(0), lambda s, x: s + x["n"]))

        return _bound(F.transform(value, lambda x: redact_value(x, kind.elementType)), items)
    if isinstance(kind, T.MapType):

        def entry(e: Column) -> Column:
            return _bound(redact_value(e["value"], kind.valueType), lambda r: F.struct(e["key"].alias("key"), r["value"].alias("value"), r["n"].alias("n")))

        def whole(entries: Column) -> Column:
            back = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
            return _counted(back, F.aggregate(entries, F.lit(0), lambda s, e: s + e["n"]))

        return _bound(F.transform(F.map_entries(value), entry), whole)
    if isinstance(kind, T.StructType) and kind.fields:

        def fields(parts: Column) -> Column:
            back = F.struct(*(parts[f"_{k}"]["value"].alias(f.name) for k, f in enumerate(kind.fields)))
            n = F.lit(0)
            for k in range(len(kind.fields)):
                n += parts[f"_{k}"]["n"]
            return _counted(F.when(value.isNotNull(), back), n)

        return _bound(F.struct(*(redact_value(value[f.name], f.dataType).alias(f"_{k}") for k, f in enumerate(kind.fields))), fields)
    return _counted(value, F.lit(0))


def redact_map(df: DataFrame, column: str) -> DataFrame:
    """df with the texts of a map (or struct) column redacted at any depth, and {column}_count. Rows are worked on one by one: nothing is shuffled."""
    name = "_redacted"
    while name in df.columns:
        name += "_"
    out = df.withColumn(name, redact_value(F.col(column), df.schema[column].dataType)).withColumns({column: F.col(f"{name}.value"), f"{column}_count": F.col(f"{name}.n")})
    return out.drop(name)


#: Text columns besides message, raw line and extra fields that the gate redacts where a record has them. Leave out source_ip where addresses are needed.
TEXT_COLUMNS = ("service_name", "request_id", "trace_id", "environment", "deployment_version", "source_ip", "http_method", "http_path")


def redact_records(df: DataFrame, columns: tuple[str, ...] = TEXT_COLUMNS) -> DataFrame:
    """The gate before storage: message, then raw_line only if the message was clean (dropped when dirty), extra_fields, and the text columns named; counts add up in pii_count.

    extra_fields is a map of texts or JSON text. The values of an object are
    redacted one by one and JSON is made of them afterwards, so it stays
    JSON and no value takes a neighbour with it; text that isn't an object is
    redacted as it is. What is null stays null, and the type stays.
    """
    own = [c for c in columns if c in df.columns]
    as_text = isinstance(df.schema["extra_fields"].dataType, T.StringType)
    extra = F.col("extra_fields")
    if as_text:
        read = F.map_entries(F.from_json(extra, "map<string,string>"))
        members = F.when(extra.rlike(r"(?s)^\s*+\{"), F.map_from_entries(last_of_each(read)))
    else:
        members = extra
    out = with_redaction(df, "message", "_m").withColumn("_members", members)
    # all other texts in one array, which the patterns go through once
    first = [F.when(F.col("_m_count") == 0, F.col("raw_line")), *([F.when(F.col("_members").isNull(), extra)] if as_text else []), *(F.col(c) for c in own)]
    texts = F.concat(F.array(*first), F.coalesce(F.map_values("_members"), F.array().cast("array<string>")))
    out = out.withColumn("_done", F.transform(texts, lambda x: redact_value(x, T.StringType())))
    done = lambda k: F.get("_done", F.lit(k))
    values = F.transform(F.slice("_done", len(first) + 1, F.size("_done")), lambda d: d["value"])
    back = F.when(F.col("_members").isNotNull(), F.map_from_arrays(F.map_keys("_members"), values))
    clean = (F.col("_m_count") == 0) & (done(0)["n"] == 0)
    n = F.col("_m_count") + F.aggregate("_done", F.lit(0), lambda s, d: s + d["n"])
    changed = {c: done(len(first) - len(own) + k)["value"] for k, c in enumerate(own)}
    changed |= {
        "message": F.col("_m_text"), "raw_line": F.when(clean, F.col("raw_line")), "pii_count": n, "pii_was_redacted": n > 0,
        "extra_fields": F.coalesce(F.to_json(back), done(1)["value"]) if as_text else back,
    }
    return out.withColumns(changed).select(*df.columns, *(c for c in ("pii_count", "pii_was_redacted") if c not in df.columns))


def last_of_each(entries: Column) -> Column:
    """Map entries without those whose key comes again later, as readers of JSON keep the last of equal keys."""
    keys = F.transform(entries, lambda e: e["key"])
    later = lambda e, i: F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"])
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), entries).otherwise(F.filter(entries, lambda e, i: ~later(e, i)))
