"""Quality rules: how much of a text repeats itself.

Rolling hashes of words, n-grams of several lengths and lines are compared
within each document in numpy, many documents at a time; the measures are
characters inside n-grams and lines that occur more than once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import table
from emberlog.llm.textops import Rolling, Texts, grams, mix, repeated, sliced

#: n-gram length: largest share of word characters inside repeated n-grams.
MAX_GRAM_SHARE = {5: 0.40, 6: 0.39, 7: 0.38, 8: 0.37, 9: 0.36, 10: 0.35}
#: Largest share of word characters inside lines equal to an earlier one.
MAX_LINE_SHARE = 0.30
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]
_GRAMS = [f"dup_{n}gram_chars" for n in MAX_GRAM_SHARE]


def _per_doc(values: np.ndarray, at: np.ndarray, docs: Texts) -> np.ndarray:
    """Sums of values by document; at: their places in the data, ascending."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(sums[np.searchsorted(at, docs.bounds)])


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    docs = Texts(texts)
    data, rolling = docs.data, Rolling(docs.data)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    starts, ends = docs.spans(_WORD)
    doc, long = docs.doc_of(starts), chars[ends] - chars[starts]
    word = rolling.of(starts, ends)
    seed = mix(np.arange(docs.n, dtype=np.uint64) + np.uint64(1))
    symbols = np.flatnonzero(_SYMBOL[data])
    out = {
        "n_words": _per_doc(np.ones(len(starts)), starts, docs),
        "word_chars": _per_doc(long, starts, docs),
        "n_symbols": _per_doc(np.ones(len(symbols)), symbols, docs),
    }

    line, line_end = docs.lines()
    words = np.concatenate([[0], np.cumsum(long)])
    line_chars = words[np.searchsorted(starts, line_end)] - words[np.searchsorted(starts, line)]
    line, line_end, line_chars = line[line_chars > 0], line_end[line_chars > 0], line_chars[line_chars > 0]
    _, before = repeated(mix(rolling.of(line, line_end) ^ seed[docs.doc_of(line)]))
    out["n_dup_lines"] = _per_doc(before, line, docs)
    out["dup_line_chars"] = _per_doc(line_chars * before, line, docs)

    alive = None  # windows of 3 words that occur twice or more: longer repeats consist of them
    for n in (3, *MAX_GRAM_SHARE):
        covered = np.zeros(len(starts) + 1, np.int64)
        if len(starts) >= n:
            fit = doc[: len(doc) - n + 1] == doc[n - 1 :]
            if alive is not None:
                for k in range(n - 2):
                    fit &= alive[k : k + len(fit)]
            at = np.flatnonzero(fit)
            twice, _ = repeated(mix(grams(word, n)[at] ^ seed[doc[at]]))
            at = at[twice]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + n, -1)
            if n == 3:
                alive = np.zeros(len(fit), bool)
                alive[at] = True
        covered = np.cumsum(covered)[:-1] > 0
        if n == 3:
            out["n_repeat_words"] = _per_doc(covered, starts, docs)
        else:
            out[f"dup_{n}gram_chars"] = _per_doc(covered * long, starts, docs)
    return out


def _measures(text: Column) -> Column:
    """All counts of a text as a struct. The row itself stays in the JVM: the text goes out once, counts come back."""
    names = [*COUNTS, *_GRAMS]

    @F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in names]))
    def counts(texts: pa.Array) -> pa.Array:
        parts = [measure(own) for _, own in sliced(pa.RecordBatch.from_arrays([texts], names=["text"]))]
        columns = [np.concatenate([np.zeros(0, np.int64), *(m[c].astype(np.int64) for m in parts)]) for c in names]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=names)

    return counts.asNondeterministic()(text.cast("binary"))  # so that no filter on the counts measures a second time


def judged(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), m (struct of the counts), base_failed, kept."""
    own = docs.select(F.struct(*docs.columns).alias("row"), _measures(docs["text"]).alias("m"))
    base = (F.col("m.n_words") < 50) | (100 * F.col("m.n_repeat_words") > 50 * F.col("m.n_words"))
    fine = F.col("m.dup_line_chars") <= MAX_LINE_SHARE * F.col("m.word_chars")
    for n, share in MAX_GRAM_SHARE.items():
        fine &= F.col(f"m.dup_{n}gram_chars") <= share * F.col("m.word_chars")
    return own.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & fine)


def quality_rules(docs: DataFrame) -> DataFrame:
    """docs with the counts, base_failed and kept added (replacing columns of these names); row by row, so repeated rows and null ids need no care, and no rows give no rows. A text, however long, is measured as a whole in one task.

    Words are stretches without white space; a null text has none, so it
    fails. base_failed: under 50 words, or over half of the words in 3-word
    windows that occur twice or more. kept: not base_failed, and no more than
    the shares above of the word characters in repeated n-grams or lines. All comparisons are strict.
    """
    docs = docs.drop(*COUNTS, *_GRAMS, "base_failed", "kept")
    return judged(docs).select("row.*", "m.*", "base_failed", "kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document. See quality_rules() for odd rows."""
    measured = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return measured.select("doc_id", *COUNTS[:5], "base_failed", "kept", COUNTS[5], *_GRAMS)


def _sql() -> str:
    grams = "".join(
        f"""
w{n} AS (SELECT k, i, array_to_string(ws[i:i + {n - 1}], ' ') AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w)),
r{n} AS (SELECT k, i FROM w{n} QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
c{n} AS (SELECT p.k, count(*) AS n, sum(length(ws[p])) AS chars FROM (SELECT DISTINCT k, i + unnest(range(0, {n})) AS p FROM r{n}) p JOIN w ON p.k = w.k GROUP BY p.k),"""
        for n in (3, *MAX_GRAM_SHARE)
    )
    chars = ", ".join(f"coalesce(c{n}.chars, 0)::BIGINT AS dup_{n}gram_chars" for n in MAX_GRAM_SHARE)
    joins = " ".join(f"LEFT JOIN c{n} ON w.k = c{n}.k" for n in (3, *MAX_GRAM_SHARE))
    fine = " AND ".join(f"dup_{n}gram_chars <= {share} * word_chars" for n, share in MAX_GRAM_SHARE.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
l AS (SELECT k, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM d),
y AS (SELECT k, row_number() OVER (PARTITION BY k, line ORDER BY pos) > 1 AS again, length(array_to_string(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'), '')) AS chars FROM l),
z AS (SELECT k, count(*) FILTER (WHERE again AND chars > 0) AS n, sum(chars) FILTER (WHERE again) AS chars FROM y GROUP BY k),{grams}
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             z.n AS n_dup_lines, coalesce(c3.n, 0) AS n_repeat_words, coalesce(z.chars, 0)::BIGINT AS dup_line_chars, {chars}
      FROM w JOIN z ON w.k = z.k {joins}),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND dup_line_chars <= {MAX_LINE_SHARE} * word_chars AND {fine} AS kept FROM b"""


SQL = _sql()
