"""Log lines to typed records.

A grammar is a pattern and the expressions of its groups. parse_lines() tries
them in order in one pass of plain projections; by itself each is an
expression from a line to a record struct, null where it doesn't match. All times are UTC without a zone; years
that a grammar lacks come from the evaluation time.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions.redaction import last_of_each

# Key names in order of priority, spellings of severities, grammars.
TIMESTAMP_KEYS = ["timestamp", "time", "ts", "@timestamp", "datetime", "date", "created_at"]
SEVERITY_KEYS = ["level", "severity", "log_level", "loglevel", "lvl", "priority", "sev"]
MESSAGE_KEYS = ["message", "msg", "text", "body", "log", "content"]
SERVICE_KEYS = ["service", "service_name", "app", "application", "component", "logger"]
REQUEST_ID_KEYS = ["request_id", "requestId", "req_id", "reqId", "correlation_id", "x-request-id"]
TRACE_ID_KEYS = ["trace_id", "traceId", "trace", "dd.trace_id", "traceID"]
ENVIRONMENT_KEYS = ["environment", "env", "stage", "deployment_env"]
VERSION_KEYS = ["version", "app_version", "release", "deployment_version", "build"]
METHOD_KEYS, PATH_KEYS = ["method", "http_method"], ["path", "url", "uri"]
STATUS_KEYS, DURATION_KEYS = ["status", "status_code", "http_status"], ["duration", "duration_ms", "elapsed"]
KNOWN_KEYS = [
    *TIMESTAMP_KEYS, *SEVERITY_KEYS, *MESSAGE_KEYS, *SERVICE_KEYS, *REQUEST_ID_KEYS, *TRACE_ID_KEYS,
    *ENVIRONMENT_KEYS, *VERSION_KEYS, *METHOD_KEYS, *PATH_KEYS, *STATUS_KEYS, *DURATION_KEYS,
]
SEVERITIES = {
    "trace": "TRACE", "debug": "DEBUG", "dbg": "DEBUG", "info": "INFO", "information": "INFO", "warn": "WARN", "warning": "WARN",
    "error": "ERROR", "err": "ERROR", "critical": "CRITICAL", "crit": "CRITICAL", "fatal": "FATAL",
}
STORED_SEVERITIES = ["TRACE", "DEBUG", "INFO", "WARN", "WARNING", "ERROR", "CRITICAL", "FATAL"]
STORED_FORMATS = ["apache_common", "apache_combined", "nginx", "json", "syslog", "custom"]
SYSLOG_SEVERITIES = ["CRITICAL", "CRITICAL", "CRITICAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
COMMON = r'^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]+)"\s+(\d{3})\s+(\S+)'
COMBINED = COMMON + r'\s+"([^"]*)"\s+"([^"]*)"'
NGINX = r'^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*)"\s+(\d{3})\s+(\S+)(?:\s+"([^"]*)"\s+"([^"]*)")?(?:\s+\[?([\d.]+)\]?)?'
# Structured data: bracketed elements, each up to a bracket before white space or another element; possessive, as any number may follow.
RFC5424 = r"^<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(?:(\[.*?\](?=[\s\[])(?:\s*+\[.*?\](?=[\s\[]))*+|-)\s+)?(.*)"
RFC3164 = r"^(?:<\d+>)?(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^\[:]+?)(?:\[(\d+)\])?:\s*(.*)"
GENERIC = (
    r"(?i)^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?)"
    r"(?:\s+\[?(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|CRITICAL|FATAL)\]?)?(?:\s+\[?([^\s\]]+)\]?)?"
    r"(?:\s+([\w.$-]+\.[\w.$-]+))?\s*[-:–]?\s*(.*)"
)
#: White space around a line.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"

FIELDS = {
    "timestamp": "timestamp_ntz", "service_name": "string", "severity": "string", "message": "string", "request_id": "string",
    "trace_id": "string", "environment": "string", "deployment_version": "string", "source_ip": "string", "http_method": "string",
    "http_path": "string", "http_status": "int", "duration_ms": "double", "log_format": "string", "extra_fields": "map<string,string>",
    "is_malformed": "boolean",
}


def _record(**values: Column) -> Column:
    """A record with the given fields; others are null."""
    values.setdefault("is_malformed", F.lit(False))
    return F.struct(*(values.get(n, F.lit(None)).cast(t).alias(n) for n, t in FIELDS.items()))


_MARK = "\x01"


def _groups(line: Column, pattern: str) -> Column:
    """The groups of a line that the pattern matches, empty where one took no part. One replacement turns the line into them; only a line that has the mark itself is matched once for each group."""
    n = re.compile(pattern).groups
    singly = F.array(*(F.regexp_extract(line, pattern, k + 1) for k in range(n)))
    marked = F.regexp_replace(line, pattern + "(?s:.*)$", _MARK.join(f"${k + 1}" for k in range(n)))
    return F.when(line.contains(_MARK), singly).otherwise(F.split(marked, _MARK))


def _matched(line: Column, pattern: str, record: Callable[[Callable[[int], Column], Callable[[int], Column]], Column]) -> Column:
    """record(group, text) where the pattern matches, else null; group(n) is null and text(n) empty where group n took no part. The lambda binds the groups, so they are taken once."""
    text = lambda g: lambda k: F.get(g, F.lit(k - 1))
    group = lambda g: lambda k: F.nullif(F.get(g, F.lit(k - 1)), F.lit(""))
    found = F.when(line.rlike(pattern), _groups(line, pattern))
    return F.get(F.transform(F.array(found), lambda g: F.when(g.isNotNull(), record(group(g), text(g)))), F.lit(0))


def _dashed(x: Column) -> Column:
    return F.when(x != "-", x)


def _map(**values: Column) -> Column:
    """A map of the values that aren't null, as texts."""
    none = F.create_map().cast("map<string,string>")
    parts = [F.when(v.isNotNull(), F.create_map(F.lit(k), v.cast("string"))).otherwise(none) for k, v in values.items()]
    return F.map_concat(*parts) if len(parts) > 1 else parts[0] if parts else none


def utc(text: Column) -> Column:
    """An ISO 8601 time, with or without a zone, as UTC without one; null if it can't be read."""
    iso = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2})[T ]", "$1 ")
    zoned = F.regexp_replace(iso, r"([+-]\d{2})(\d{2})$", "$1:$2")
    # the session's zone only stands in where the text names none
    named = F.when(zoned.rlike(r"(Z|[+-]\d{2}:\d{2})$"), zoned).otherwise(F.concat(zoned, F.lit("Z")))
    return F.to_utc_timestamp(F.try_to_timestamp(named), F.current_timezone()).cast("timestamp_ntz")


def http_severity(status: Column) -> Column:
    return F.when(status >= 500, "ERROR").when(status >= 400, "WARN").otherwise("INFO")


def clf_time(text: Column) -> Column:
    read = F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    return F.to_utc_timestamp(read, F.current_timezone()).cast("timestamp_ntz")


def request_method(request: Column) -> Column:
    return F.when(F.size(F.split(request, " ")) >= 2, F.upper(F.get(F.split(request, " "), F.lit(0))))


def request_path(request: Column) -> Column:
    return F.get(F.split(request, " "), F.lit(1))


def map_severity(raw: Column) -> Column:
    """The stored spelling of a severity, or UNKNOWN."""
    upper = F.upper(F.coalesce(raw, F.lit("")))
    return F.when(upper.isin(STORED_SEVERITIES), upper).otherwise("UNKNOWN")


def map_format(raw: Column) -> Column:
    return F.when(raw.isin(STORED_FORMATS), raw).otherwise("unknown")


def _spelled(raw: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in SEVERITIES.items() for x in pair))
    return F.coalesce(F.element_at(names, F.lower(raw)), F.lit("UNKNOWN"))


def json_keys(line: Column) -> Column:
    """The top-level members of a JSON object line as a map of texts, or null if the line is none. Of equal keys the last counts."""
    text = F.btrim(line, F.lit(WHITE))
    members = F.from_json(text, "map<string,string>")
    own = F.get(F.transform(F.array(F.map_entries(members)), lambda e: F.map_from_entries(last_of_each(e))), F.lit(0))
    return F.when(text.startswith("{") & text.endswith("}"), own)


def first_present(members: Column, keys: list[str]) -> Column:
    """The value of the first of keys that is present, be it null."""
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        out = F.when(F.map_contains_key(members, k), F.element_at(members, k)).otherwise(out)
    return out


def first_true(members: Column, keys: list[str]) -> Column:
    """The first value that isn't empty, zero, false or null."""
    values = [F.element_at(members, k) for k in keys]
    return F.coalesce(*(F.when(~v.isin("", "0", "0.0", "false"), v) for v in values))


def json_time(raw: Column) -> Column:
    number = raw.try_cast("double")
    seconds = F.when(number > 1e12, number / 1000).otherwise(number)
    epoch = F.timestamp_micros((seconds * 1_000_000).cast("long"))
    return F.coalesce(F.to_utc_timestamp(epoch, F.current_timezone()).cast("timestamp_ntz"), utc(raw))


def json_extras(members: Column) -> Column:
    return F.map_filter(members, lambda k, v: ~k.isin(KNOWN_KEYS))


def _json_fields(m: Column, time: Column, extras: Column) -> dict[str, Column]:
    """Fields of the members of an object; time: the value of its first time key; extras: json_extras() of it."""
    return dict(
        timestamp=json_time(time),
        severity=_spelled(first_present(m, SEVERITY_KEYS)),
        message=first_present(m, MESSAGE_KEYS),
        service_name=first_present(m, SERVICE_KEYS),
        request_id=first_present(m, REQUEST_ID_KEYS),
        trace_id=first_present(m, TRACE_ID_KEYS),
        environment=first_present(m, ENVIRONMENT_KEYS),
        deployment_version=first_present(m, VERSION_KEYS),
        http_method=first_true(m, METHOD_KEYS),
        http_path=first_true(m, PATH_KEYS),
        http_status=first_true(m, STATUS_KEYS).try_cast("int"),
        duration_ms=first_true(m, DURATION_KEYS).try_cast("double"),
        extra_fields=extras,
        log_format=F.lit("json"),
    )


def parse_json(line: Column) -> Column:
    record = lambda m: F.when(m.isNotNull(), _record(**_json_fields(m, first_present(m, TIMESTAMP_KEYS), json_extras(m))))
    return F.get(F.transform(F.array(json_keys(line)), record), F.lit(0))


def _access(g, extras: dict[str, Column], log_format: str, **more: Column) -> dict[str, Column]:
    """What the three access formats share."""
    status = g(6).try_cast("int")
    return dict(
        source_ip=_dashed(g(1)),
        timestamp=clf_time(g(4)),
        http_method=request_method(g(5)),
        http_path=request_path(g(5)),
        http_status=status,
        severity=http_severity(status),
        extra_fields=_map(bytes_sent=_dashed(g(7)).try_cast("long"), **extras),
        log_format=F.lit(log_format),
        **more,
    )


def _common(g, t, as_of: Column | None) -> dict[str, Column]:
    return _access(g, {}, "apache_common")


def _combined(g, t, as_of: Column | None) -> dict[str, Column]:
    return _access(g, {"referer": t(8), "user_agent": t(9)}, "apache_combined")


def _nginx(g, t, as_of: Column | None) -> dict[str, Column]:
    return _access(g, {"referer": g(8), "user_agent": g(9)}, "nginx", duration_ms=g(10).try_cast("double") * 1000)


def _rfc5424(g, t, as_of: Column | None) -> dict[str, Column]:
    return dict(
        severity=F.get(F.array(*map(F.lit, SYSLOG_SEVERITIES)), g(1).try_cast("int") % 8),
        timestamp=utc(_dashed(g(3))),
        source_ip=_dashed(g(4)),
        service_name=_dashed(g(5)),
        request_id=_dashed(g(7)),
        message=t(9),
        extra_fields=_map(pid=g(6)),
        log_format=F.lit("syslog"),
    )


def _rfc3164(g, t, as_of: Column | None) -> dict[str, Column]:
    month = F.greatest(F.array_position(F.array(*map(F.lit, MONTHS)), g(1)).cast("int"), F.lit(1))
    date = F.concat_ws("-", F.year(as_of), F.lpad(month.cast("string"), 2, "0"), F.lpad(g(2), 2, "0"))
    return dict(
        severity=F.lit("INFO"),
        timestamp=F.concat_ws(" ", date, g(3)).try_cast("timestamp_ntz"),
        source_ip=g(4),
        service_name=F.trim(g(5)),
        message=t(7),
        extra_fields=_map(pid=g(6)),
        log_format=F.lit("syslog"),
    )


def _generic(g, t, as_of: Column | None) -> dict[str, Column]:
    return dict(
        timestamp=utc(F.replace(g(1), F.lit(","), F.lit("."))),
        severity=_spelled(g(2)),
        message=F.trim(t(5)),
        service_name=g(4),
        extra_fields=_map(),
        log_format=F.lit("custom"),
    )


def _malformed(line: Column) -> dict[str, Column]:
    return dict(message=line, severity=F.lit("UNKNOWN"), extra_fields=_map(), log_format=F.lit("custom"), is_malformed=F.lit(True))


#: Grammars after JSON, in the order in which they are tried: how a line that one takes must begin, its pattern and fields.
_ACCESS, _SYSLOG = r"^\S+\s+\S+\s+\S+\s+\[", r"^(?:<\d+>)?\w{3}\s+\d"
CASCADE = [
    (_ACCESS, COMBINED, _combined), (_ACCESS, COMMON, _common), (_ACCESS, NGINX, _nginx), (r"^<\d+>\d", RFC5424, _rfc5424),
    (_SYSLOG, RFC3164, _rfc3164), (r"^\d{4}-", GENERIC, _generic),
]


def _parser(pattern: str, fields: Callable[..., dict[str, Column]]) -> Callable[..., Column]:
    def parse(line: Column, as_of: Column | None = None) -> Column:
        return _matched(line, pattern, lambda g, t: _record(**fields(g, t, as_of)))

    return parse


parse_common, parse_combined, parse_nginx = _parser(COMMON, _common), _parser(COMBINED, _combined), _parser(NGINX, _nginx)
parse_rfc5424, parse_rfc3164, parse_generic = _parser(RFC5424, _rfc5424), _parser(RFC3164, _rfc3164), _parser(GENERIC, _generic)


def parse_malformed(line: Column) -> Column:
    return _record(**_malformed(line))


def parse_lines(lines: DataFrame, as_of: Column, column: str = "value", keep: str = "raw_line") -> DataFrame:
    """lines with the fields of the first grammar that matches: JSON, combined, common, nginx, both syslogs, logger style; else a malformed record. Blank lines go; the line stays as keep.

    One pass without lambdas over records: a line's beginning says which
    grammars can take it, their patterns which one does; its groups are taken
    out by one replacement, and each field is a choice among the grammars' expressions of groups.
    """
    line = F.rtrim(F.regexp_replace(F.col(column), r"[\r\n]+$", ""))
    own = lines.where(F.coalesce(F.btrim(F.col(column), F.lit(WHITE)) != "", F.lit(False))).withColumn(keep, line)
    rest = [c for c in own.columns if c not in (column, *FIELDS)]
    x = F.col(keep)
    own = own.withColumn("_members", json_keys(x)).withColumn("_extras", json_extras(F.col("_members")))
    form = F.when(F.col("_members").isNotNull(), 0)
    for k, (begins, pattern, _) in enumerate(CASCADE, 1):
        form = form.when(x.rlike(begins) & x.rlike(pattern), k)
    own = own.withColumns({"_form": form.otherwise(len(CASCADE) + 1), "_time": first_present(F.col("_members"), TIMESTAMP_KEYS)})
    groups = F.when(F.col("_form") == 0, F.lit(None).cast("array<string>"))
    for k, (_, pattern, _) in enumerate(CASCADE, 1):
        groups = groups.when(F.col("_form") == k, _groups(x, pattern))
    own = own.withColumn("_groups", groups)
    text = lambda k: F.get("_groups", F.lit(k - 1))
    group = lambda k: F.nullif(text(k), F.lit(""))
    every = [_json_fields(F.col("_members"), F.col("_time"), F.col("_extras")), *(fields(group, text, as_of) for _, _, fields in CASCADE), _malformed(x)]

    def chosen(name: str, kind: str) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast(kind))
        for k, fields in enumerate(every):
            if name in fields:
                out = out.when(F.col("_form") == k, fields[name].cast(kind))
        return out.otherwise(F.lit(False)) if name == "is_malformed" else out

    return own.select(*rest, *(chosen(n, t).alias(n) for n, t in FIELDS.items()))


def format_vote(records: DataFrame, session: str, order: str) -> DataFrame:
    """The most frequent format of each session; of equally frequent ones that of the earliest line. Two aggregations, both partial."""
    counts = records.groupBy(session, "log_format").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(session).agg(F.max_by("log_format", F.struct("n", -F.col("first"))).alias("dominant_format"))


def session_stats(records: DataFrame, session: str = "session_id") -> DataFrame:
    """Lines, stored and failed records and replaced personal data of each session."""
    return records.groupBy(session).agg(
        F.count("*").alias("total_lines"),
        F.count_if(~F.col("is_malformed")).alias("inserted"),
        F.count_if("is_malformed").alias("failed"),
        F.sum("pii_count").alias("pii_total"),
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
