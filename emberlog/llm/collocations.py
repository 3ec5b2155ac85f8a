"""Phrase collocations from a weighted de Bruijn graph.

Three words in a row are a node, four an edge between two overlapping nodes,
weighted by how often they occur. Each word of a piece starts one row: an edge,
or, at the piece's end, the node or fewer words that are left there. All
shorter counts follow from that: a node occurs as often as its edges leave
it, corrected by the pieces that end in it, and so on down to single words.

Rows are summed up in each task, dealt to ranges of grams and sorted,
so whatever shares a beginning stands together and its flow is the sum of a
stretch; a frequent beginning is cut across partitions like any other. What
meets a border of a batch leaves it as a part and is summed up afterwards;
inside, only counts from the limit on leave. Where a node has one edge in and
one out, of the same weight, edges are compacted to paths.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.llm.common import stored, table, tasks

#: Words of an edge; least count of a phrase; share of a phrase (in hundredths) that a longer one must have to replace it; phrases of a language.
EDGE, LEAST, REPLACES, TOP = 4, 30, 80, 2000
SCORE = 2_000_000
#: Words whose rows are summed up together in a task.
_WORDS = 1 << 20
#: Rows of a record batch.
_ROWS = 1 << 16
#: Documents, about, whose grams say where ranges are cut, and of how many grams each cut is chosen. Results don't depend on the cuts.
_SAMPLE, _CHOICE = 4000, 40
#: Parts that a language's candidates are ranked in before the best of all parts are.
_PARTS = 64
_BREAKS = bytes(10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def _prefix(lang: str) -> bytes:
    """A language in front of its words: no other language's name begins like this."""
    name = lang.encode()
    return b"%d:%s" % (len(name), name)


def _rows(words: list[bytes], ends: list[int], prefix: bytes) -> Iterator[tuple[pa.Array, pa.Array]]:
    """gram (prefix and up to EDGE words, each with \\t behind; ascending), n: the row that each word starts, equal ones summed up. ends: where pieces end."""
    coded = pa.array(words, pa.binary()).dictionary_encode()
    own = pa.array([w + b"\t" for w in coded.dictionary.to_pylist()], pa.binary())
    order = pc.array_sort_indices(own).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    code = np.concatenate([rank[coded.indices.to_numpy()], np.zeros(EDGE, np.int64)])
    end = np.repeat(np.array(ends), np.diff(ends, prepend=0))
    texts = pa.concat_arrays([pa.array([b""], pa.binary()), own.take(pa.array(order))])
    for at in range(0, len(words), _WORDS):
        i = np.arange(at, min(at + _WORDS, len(words)))
        g = [np.where(i + k < end[i], code[i + k], 0) for k in range(EDGE)]
        high, low = (g[0] << 32) | g[1], (g[2] << 32) | g[3]
        by = np.lexsort((low, high))
        high, low = high[by], low[by]
        new = np.ones(len(by), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(by)))
        starts = by[first]
        for k in range(0, len(starts), _ROWS):
            parts = [texts.take(pa.array(x[starts[k : k + _ROWS]])) for x in g]
            yield pc.binary_join_element_wise(pa.scalar(prefix, pa.binary()), *parts, pa.scalar(b"", pa.binary())), pa.array(n[k : k + _ROWS])


def _ranges(gram: pa.Array, cuts: list[bytes]) -> np.ndarray:
    """The range of each of ascending grams: how many cuts it isn't below. Only cuts between the first and the last are looked for."""
    low, high = (bisect_right(cuts, gram[k].as_py()) for k in (0, len(gram) - 1))
    places = [bisect_left(range(len(gram)), c, key=lambda i: gram[i].as_py()) for c in cuts[low:high]]
    return (low + np.searchsorted(np.array(places, np.int64), np.arange(len(gram)), side="right")).astype(np.int32)


def edges(docs: DataFrame, cuts: list[bytes]) -> DataFrame:
    """gram (binary), n, range (between cuts, ascending grams): rows of all pieces of docs (text, lang); a language's number of words comes as a row of its name alone. Rows of one gram may come from many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[bytes], list[int]]] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            words, ends = held.pop(lang)
            every = (pa.array([_prefix(lang)], pa.binary()), pa.array([len(words)]))
            for gram, n in (every, *_rows(words, ends, _prefix(lang))):
                yield pa.RecordBatch.from_arrays([gram, n, pa.array(_ranges(gram, cuts))], names=["gram", "n", "range"])

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words, ends = held.setdefault(lang, ([], []))
                for piece in (text.as_py() or b"").translate(_BREAKS).split(b"\n"):
                    if own := piece.split():  # of what is white space only blanks and tabs are left
                        words += own
                        ends.append(len(words))
                if len(words) >= _WORDS:
                    yield from flush(lang)
        for lang in list(held):
            if held[lang][0]:
                yield from flush(lang)

    own = docs.select(F.col("text").cast("binary").alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    return own.mapInArrow(run, "gram binary, n long, range int")


def _cuts(docs: DataFrame, ranges: int) -> list[bytes]:
    """Grams that cut those of a sample of docs into ranges of about as many."""
    share = min(1.0, _SAMPLE / max(1, docs.count()))
    some = edges(docs.sample(share, 42), []).select("gram").orderBy(F.xxhash64("gram"), "gram").limit(_CHOICE * ranges).collect()
    grams = sorted({bytes(r["gram"]) for r in some})
    return sorted({grams[k * len(grams) // ranges] for k in range(1, ranges)}) if grams else []


def _flows(gram: pa.Array, n: np.ndarray, least: int) -> Iterator[tuple[bytes, int, int]]:
    """Beginning, its number of words, sum of n of all rows that have it; rows are sorted. Beginnings that meet the first or last row come whatever their sum, others from least on."""
    tokens = pc.split_pattern(gram, b"\t")  # the last one is empty, the first has the language's name
    start = tokens.offsets.to_numpy()
    count = np.diff(start) - 1
    code = tokens.values.dictionary_encode().indices.to_numpy()
    sums = np.concatenate([[0], np.cumsum(n)])
    for i in np.flatnonzero(count == 0):
        yield gram[int(i)].as_py(), 0, int(n[i])
    same = np.ones(len(n), bool)  # with the row before, as far as the words looked at go
    same[0] = False
    last = np.zeros(len(n), np.int64)  # bytes of the words looked at
    width = pc.binary_length(tokens.values).to_numpy()
    for k in range(EDGE):
        has = count > k
        at = np.where(has, start[:-1] + k, start[:-1])
        same[1:] &= has[1:] & has[:-1] & (code[at[1:]] == code[at[:-1]])
        last += np.where(has, width[at] + 1, 0)
        cut = np.flatnonzero(~same | ~has)  # where a beginning ends, or one begins
        first = cut[has[cut]]
        end = np.append(cut, len(n))[np.searchsorted(cut, first, side="right")]
        total = sums[end] - sums[first]
        go = (total >= least) | (first == 0) | (end == len(n))
        for i, f in zip(first[go].tolist(), total[go].tolist(), strict=True):
            yield gram[i].as_py()[: last[i]], k + 1, f


def counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase (words with blanks between), k (words), f: what occurs least times or more in a language, up to EDGE words; and with k = 0 a language's number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple] = []
            for text, k, f in _flows(batch.column(0), batch.column(1).to_numpy(), least):
                size, _, rest = text.partition(b":")
                out.append((rest[: int(size)], rest[int(size) :].rstrip(b"\t").replace(b"\t", b" "), k, f))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "k", "f"])

    ranges = tasks(docs)
    ranged = edges(docs, _cuts(docs, ranges)).repartitionById(ranges, F.col("range")).select("gram", "n").sortWithinPartitions("gram")
    parts = ranged.mapInArrow(run, "lang binary, phrase binary, k int, f long")
    whole = parts.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("k") == 0))
    return whole.select(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), "k", "f")


def _part(start: int | Column, length: int | Column) -> Column:
    """Some words of a phrase."""
    one = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.array_join(F.slice(F.split("phrase", " "), one(start), one(length)), " ")


def paths(grams: DataFrame) -> DataFrame:
    """lang, phrase (an edge), path (the words of its unary path), path_words for each edge of counts().

    Two edges are joined where the node between them has their weight: then
    no other edge enters or leaves it, and no piece begins or ends there. An edge
    looks twice as far back in each round, so rounds grow with the logarithm
    of the longest path. A path has no cycle, as no piece is endless.
    """
    of = grams.where(F.col("k") == EDGE).select("lang", "phrase", "f")
    nodes = grams.where(F.col("k") == EDGE - 1).select("lang", F.col("phrase").alias("node"), "f")
    into = of.select("lang", "phrase", _part(2, EDGE - 1).alias("node"), "f").join(nodes, ["lang", "node", "f"])
    out = of.select("lang", F.col("phrase").alias("next"), _part(1, EDGE - 1).alias("node"), "f").join(nodes, ["lang", "node", "f"])
    back = into.join(out, ["lang", "node", "f"]).select("lang", F.col("next").alias("phrase"), F.col("phrase").alias("before"))
    at = of.join(back, ["lang", "phrase"], "left").select("lang", "phrase", "before", F.when(F.col("before").isNull(), 0).otherwise(1).alias("steps"))
    at = stored(at, "paths").select("lang", "phrase", F.coalesce("before", "phrase").alias("head"), "steps")
    while True:
        far = at.select("lang", F.col("phrase").alias("head"), F.col("head").alias("further"), F.col("steps").alias("more"))
        moved = stored(at.join(far, ["lang", "head"]).select("lang", "phrase", F.col("further").alias("head"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved")), "paths")
        at = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            break
    words = F.array_sort(F.collect_list(F.struct("steps", _part(EDGE, 1).alias("word"))))  # a path is no longer than a piece
    whole = at.groupBy("lang", "head").agg(words.alias("words"))
    text = F.concat_ws(" ", "head", F.nullif(F.array_join(F.transform(F.slice("words", 2, F.size("words")), lambda x: x["word"]), " "), F.lit("")))
    whole = whole.select("lang", "head", text.alias("path"), (F.size("words") + EDGE - 1).cast("long").alias("path_words"))
    return at.join(whole, ["lang", "head"]).select("lang", "phrase", "path", "path_words")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, path, path_words: each language's best phrases of 2 to 4 words.

    Texts are lower-cased (A-Z), cut into pieces at .,;:!? and line ends, and
    these into words at blanks and tabs; a null lang is und, a null or empty
    text has none. a is how often the phrase occurs, l and r how often its
    parts do at the cut with the lowest score, floor(2000000 a / (l + r)); n counts all words of the
    language. Phrases inside a longer one that has 80 of 100 of their
    occurrences go. Equal scores are ranked by a, then by the phrase's
    bytes. Repeated rows count each, ids and other columns play no part, no rows give no rows.
    path is the compacted path that a phrase of four words is an edge of.
    """
    grams = stored(counts(docs, least), "grams")
    own = grams.where("k > 1")
    cuts = own.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "k", "f", "cut", _part(1, F.col("cut")).alias("left"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    left, right = (grams.select("lang", F.col("phrase").alias(side), F.col("f").alias(side[0])) for side in ("left", "right"))
    score = F.expr(f"cast({SCORE} as decimal(10,0)) * cast(f as decimal(20,0)) div cast(l + r as decimal(20,0))")
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", score)
    scored = scored.groupBy("lang", "phrase", "k", F.col("f").alias("a")).agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    # edges that were compacted on either side cover their nodes: as frequent, and longer
    inside = F.explode(F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"))
    longer = grams.where("k > 2").select("lang", inside.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < REPLACES * F.col("a"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    flat = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score", F.pmod(F.xxhash64("phrase"), F.lit(_PARTS)).alias("part"))
    some = flat.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = grams.where("k = 0").select("lang", F.col("f").alias("n"))
    named = best.join(words, "lang").join(paths(grams), ["lang", "phrase"], "left")
    return named.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "path", "path_words")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE p AS (SELECT row_number() OVER () AS p, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
o AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
g AS (SELECT lang, ws[i:i + m - 1] AS g, count(*) AS f FROM (SELECT lang, ws, i, unnest(range(1, least(4, len(ws) - i + 1) + 1)) AS m FROM o) GROUP BY ALL),
n AS (SELECT lang, count(*) AS n FROM o GROUP BY lang),
h AS MATERIALIZED (SELECT lang, g, len(g) AS k, f, array_to_string(g, ' ') AS phrase FROM g WHERE f >= 30),
c AS (SELECT h.lang, h.phrase, h.g, h.k, h.f, cut, x.f AS l, y.f AS r, ((2000000::HUGEINT * h.f) // (x.f + y.f))::BIGINT AS score FROM (SELECT *, unnest(range(1, k)) AS cut FROM h WHERE k > 1) h
  JOIN h x ON x.lang = h.lang AND x.g = h.g[1:cut] JOIN h y ON y.lang = h.lang AND y.g = h.g[cut + 1:]),
b AS (SELECT lang, phrase, g, f AS a, min((score, cut, l, r)) AS best FROM c GROUP BY ALL),
i AS (SELECT lang, g[s:s + m - 1] AS g, max(f) AS longer FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM h WHERE k > 2)) GROUP BY ALL),
t AS (SELECT lang, phrase, a, best[3] AS l, best[4] AS r, best[1] AS score, row_number() OVER (PARTITION BY lang ORDER BY best[1] DESC, a DESC, phrase) AS rank
  FROM (SELECT b.lang, b.phrase, b.a, [best[1], best[2], best[3], best[4]] AS best FROM b LEFT JOIN i ON i.lang = b.lang AND i.g = b.g WHERE longer IS NULL OR 100 * longer < 80 * a)),
k AS MATERIALIZED (SELECT x.lang, x.g AS before, y.g FROM h x JOIN h v ON v.lang = x.lang AND v.k = 3 AND v.g = x.g[2:4] AND v.f = x.f JOIN h y ON y.lang = x.lang AND y.k = 4 AND y.g[1:3] = v.g AND y.f = x.f WHERE x.k = 4),
z AS (SELECT lang, g, g AS head, g AS path FROM h WHERE k = 4 AND NOT EXISTS (SELECT 1 FROM k WHERE k.lang = h.lang AND k.g = h.g)
  UNION ALL SELECT z.lang, k.g, z.head, list_append(z.path, k.g[4]) FROM z JOIN k ON k.lang = z.lang AND k.before = z.g),
q AS (SELECT z.lang, array_to_string(z.g, ' ') AS phrase, array_to_string(w.path, ' ') AS path, len(w.path) AS path_words FROM z JOIN (SELECT lang, head, arg_max(path, len(path)) AS path FROM z GROUP BY ALL) w ON w.lang = z.lang AND w.head = z.head)
SELECT t.lang, rank, t.phrase, a, l, r, n, score, path, path_words FROM t JOIN n ON n.lang = t.lang LEFT JOIN q ON q.lang = t.lang AND q.phrase = t.phrase WHERE rank <= 2000
"""
