"""Queries of English search, and the stemmer as SQL: by lists of endings where the library uses patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import english as E
from emberlog.operators import search as S
from emberlog.plans import domain as D
from emberlog.sources.shared import fresh_path

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in sorted(values, key=len, reverse=True)) + "]"


def _map(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


def _ended(name: str, of: str, endings) -> str:
    """A CTE with the longest ending e of w, and b, what is before it."""
    return f"""{name}e AS (SELECT *, list_filter({_list(endings)}, lambda x: ends_with(w, x))[1] AS e FROM {of}),
{name}b AS (SELECT *, left(w, length(w) - length(e)) AS b, length(w) - length(e) AS k FROM {name}e)"""


_REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
_KEEP = "SELECT word, own, r1, r2,"
#: Whether x ends in a short syllable.
_SHORT = "(regexp_matches({x}, '[^aeiouy][aeiouy][^aeiouywxY]$') OR regexp_matches({x}, '^[aeiouy][^aeiouy]$'))"


def stems_sql(source: str) -> str:
    """CTEs that end in stems (word, stem) of the distinct words of the CTE source (word)."""
    b_short, c_short = _SHORT.format(x="b"), _SHORT.format(x="c")
    return f"""p0 AS (SELECT word, CASE WHEN length(word) <= 2 THEN word ELSE {_map(E.OWN_STEMS)}[word] END AS own, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {source}),
p1 AS (SELECT *, CASE WHEN starts_with(w, 'gener') OR starts_with(w, 'arsen') THEN 5 WHEN starts_with(w, 'commun') THEN 6 ELSE length(regexp_extract(w, '{_REGION}')) END AS h FROM p0),
p2 AS (SELECT *, CASE WHEN h = 0 THEN length(w) ELSE h END AS r1 FROM p1),
p3 AS (SELECT *, length(regexp_extract(substr(w, r1 + 1), '{_REGION}')) AS h2 FROM p2),
p4 AS ({_KEEP} w FROM (SELECT *, CASE WHEN h2 = 0 THEN length(w) ELSE r1 + h2 END AS r2 FROM p3)),
{_ended("a", "p4", ["sses", "ied", "ies", "us", "ss", "s"])},
a1 AS (SELECT word, r1, r2, own, CASE WHEN e = 'sses' THEN b || 'ss' WHEN e IN ('ied', 'ies') THEN b || CASE WHEN length(b) > 1 THEN 'i' ELSE 'ie' END
  WHEN e = 's' AND regexp_matches(left(b, length(b) - 1), '[aeiouy]') THEN b ELSE w END AS w FROM ab),
a2 AS (SELECT word, coalesce(own, CASE WHEN list_contains({_list(E.FINAL_WORDS)}, w) THEN w END) AS own, r1, r2, w FROM a1),
{_ended("b", "a2", ["eed", "eedly", "ed", "edly", "ing", "ingly"])},
b1 AS ({_KEEP} CASE WHEN starts_with(e, 'eed') AND k >= r1 THEN b || 'ee' WHEN NOT starts_with(e, 'eed') AND regexp_matches(b, '[aeiouy]') THEN NULL ELSE w END AS w, b AS c FROM bb),
b2 AS ({_KEEP} CASE WHEN w IS NOT NULL THEN w WHEN right(c, 2) IN ('at', 'bl', 'iz') THEN c || 'e' WHEN right(c, 2) IN ('bb', 'dd', 'ff', 'gg', 'mm', 'nn', 'pp', 'rr', 'tt') THEN left(c, length(c) - 1)
  WHEN {c_short} AND r1 >= length(c) THEN c || 'e' ELSE c END AS w FROM b1),
c1 AS ({_KEEP} CASE WHEN length(w) > 2 AND lower(right(w, 1)) = 'y' AND NOT contains('aeiouy', left(right(w, 2), 1)) THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM b2),
{_ended("d", "c1", E.STEP_2)},
d1 AS ({_KEEP} CASE WHEN e IS NULL OR k < r1 OR e = 'ogi' AND right(b, 1) <> 'l' OR e = 'li' AND NOT contains('cdeghkmnrt', right(b, 1)) THEN w ELSE b || {_map(E.STEP_2)}[e] END AS w FROM db),
{_ended("f", "d1", E.STEP_3)},
f1 AS ({_KEEP} CASE WHEN e IS NULL OR k < r1 OR e = 'ative' AND k < r2 THEN w ELSE b || {_map(E.STEP_3)}[e] END AS w FROM fb),
{_ended("g", "f1", E.STEP_4)},
g1 AS ({_KEEP} CASE WHEN e IS NULL OR k < r2 OR e = 'ion' AND right(b, 1) NOT IN ('s', 't') THEN w ELSE b END AS w FROM gb),
{_ended("h", "g1", ["e", "l"])},
h1 AS ({_KEEP} CASE WHEN e = 'e' AND (k >= r2 OR k >= r1 AND NOT {b_short}) OR e = 'l' AND k >= r2 AND right(b, 1) = 'l' THEN b ELSE w END AS w FROM hb),
stems AS (SELECT word, coalesce(own, replace(w, 'Y', 'y')) AS stem FROM h1)"""


def _words_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


@query(f"""WITH found AS (SELECT word, count(*) AS n FROM (SELECT unnest({_words_sql('text')}) AS word FROM documents) GROUP BY word), {stems_sql('found')}
SELECT word, stem, n FROM stems JOIN found USING (word)""")
def english_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with its stem and how often it occurs."""
    words = D.read(spark, sf_dir, "documents").select(F.explode(E.words(F.col("text"))).alias("word"))
    return E.with_stem(words.groupBy("word").agg(F.count("*").alias("n")), "word").select("word", "stem", "n")


_PHRASES = [
    "Connection failed while retrying", "retries are FAILING on connections", "failure of a connection", "connecting again", "request refused: connections exceeded",
    "scheduler skipped failing jobs", "rates were limited",
]


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("id") % len(_PHRASES) + 1).cast("int"))
    return D.logs(spark, sf_dir).select("id", "timestamp", "service_name", F.concat(phrase, F.lit(" in "), "message").alias("message"))


_MESSAGES = f"""{D.LOGS}, own AS (SELECT id, [{", ".join(f"'{p}'" for p in _PHRASES)}][id % {len(_PHRASES)} + 1] || ' in ' || message AS message FROM logs)"""


def _search_sql(stems: list[str]) -> str:
    wanted = " AND ".join(f"bool_or(stem = '{s}')" for s in stems)
    return f"""WITH {_MESSAGES}, w AS (SELECT DISTINCT id, unnest({_words_sql('message')}) AS word FROM own), found AS (SELECT DISTINCT word FROM w), {stems_sql('found')},
hit AS (SELECT id FROM w JOIN stems USING (word) GROUP BY id HAVING {wanted}) SELECT id, message FROM own JOIN hit USING (id)"""


def _search(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Two batches, the first delivered twice, and a search over both."""
        own, path = _messages(spark, sf_dir), fresh_path(spark, "searched")
        for k in (0, 0, 1):
            S.index_batch(own.where(F.col("id") % 2 == k), path, f"part {k}", slots=2)
        return S.search(spark, path, own.schema, text).select("id", "message")

    return run


QUERIES["search_english"], SQL["search_english"] = _search("the failing connections"), _search_sql(["fail", "connect"])
QUERIES["search_rare"], SQL["search_rare"] = _search("Exceeding 100032 refusals, coded"), _search_sql(["exceed", "100032", "refus", "code"])
