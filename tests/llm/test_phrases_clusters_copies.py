"""Operators 11 to 13 against brute force, on rows with every odd thing."""

import collections
import hashlib
import itertools
import math
import random
import re
from bisect import bisect_right

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberlog.llm import bitplanes, collocations, minhash, queries
from tests.llm.test_operators import ROWS, SCHEMA, docs, empty, same  # noqa: F401

# --- 11


def brute_collocations(rows, least, top):
    """Every rule of the contract, one by one."""
    count = collections.defaultdict(collections.Counter)
    words = collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for i, n in itertools.product(range(len(ws)), range(1, 5)):
                if i + n <= len(ws):
                    count[lang][tuple(ws[i : i + n])] += 1
    out = []
    for lang, f in count.items():
        own = {g: a for g, a in f.items() if a >= least and len(g) > 1}
        rows = []
        for g, a in own.items():
            inside = [f_ for h, f_ in own.items() if len(h) > len(g) and any(h[k : k + len(g)] == g for k in range(len(h) - len(g) + 1))]
            if any(100 * x >= 80 * a for x in inside):
                continue
            score, _, left, right = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
SEPARATORS = [" ", " ", " ", "\t", " . ", "\n", "!", "  "]


def prose(n, seed):
    rng = random.Random(seed)
    own = ["the", "The", "of", "and", "é", "漢字", "x\x01", "x", "10:a"]
    return "".join(rng.choice(own) + rng.choice(SEPARATORS) for _ in range(n))


@pytest.mark.parametrize(("least", "top"), [(2, 7), (4, 2000)])
def test_collocations_equal_brute_force(spark, least, top):
    chain = " ".join(f"w{k}" for k in range(12))
    rows = [(k, prose(60, k), ["en", None, "10:x", "e"][k % 4]) for k in range(40)]
    rows += [(100 + k, f"{chain}. {'spam ' * 9}", "en") for k in range(6)] + [(200, None, "en"), (201, "", None), (None, "the of and", "zz"), (202, " \t\n", "yy")]
    rows += [(300, prose(9000, 9), "en")] * 2
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, phrase int").repartition(3)
    found = collocations.collocations(df, least, top).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in found) == brute_collocations([(t, lang) for _, t, lang in rows], least, top)
    paths = {r.path: r.path_words for r in found if r.path}
    assert top < 100 or paths.get(chain) == 12


def test_collocations_in_small_batches(spark, monkeypatch):
    """Frequent beginnings are cut by batches, ranges and flushes; nothing is lost or counted twice."""
    monkeypatch.setattr(collocations, "_SAMPLE", 5)
    rows = [(k, prose(400, k % 3), "en" if k % 5 else None) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        found = collocations.collocations(df, 30, 50).select(*COLUMNS).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, found)) == brute_collocations([(t, lang) for _, t, lang in rows], 30, 50)


def test_collocations_of_nothing(empty):  # noqa: F811
    assert collocations.collocations(empty).count() == 0


def test_ranges_are_those_of_the_cuts():
    rng = random.Random(0)
    for _ in range(500):
        grams, cuts = (sorted({bytes(rng.choices(b"ab\t", k=rng.randrange(1, 4))) for _ in range(n)}) for n in (12, 8))
        assert collocations._ranges(pa.array(grams, pa.binary()), cuts).tolist() == [bisect_right(cuts, g) for g in grams]


# --- 12


def brute_clusters(rows, most, rounds):
    """Plain integers, one vector at a time."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 2**19 for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest()))
    centres = [v for _, v in order[:most]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((far(v, c), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        for k, vs in members.items():
            centres[k] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    sums = collections.Counter()
    for _, d, k in found:
        sums[k] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, k, d, sums[k], sum(sums.values()), sha[k]) for i, d, k in found]


def vectors(n, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    return [[float(x) for x in v] for v in rng.normal(0, scale, (n, 64)).astype(np.float32)]


@pytest.mark.parametrize(("n", "most", "scale"), [(70, 6, 1.0), (3, 8, 0.001), (40, 5, 50_000.0)])
def test_clusters_equal_brute_force(spark, n, most, scale):
    rows = list(enumerate(vectors(n, n, scale)))
    rows += [(2, rows[2][1]), (2, rows[2][1]), (None, rows[0][1]), (900, None), (901, [1.0] * 63), (902, [1.0] * 63 + [None]), (903, [float("nan")] * 64), (904, [float("inf")] * 64), (905, [1e30] * 64), (906, [-1.0] * 65), (907, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, cluster string").repartition(3)
    same(bitplanes.clusters(df, most=most, rounds=3), brute_clusters([(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], most, 3))


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<double>")
    assert bitplanes.clusters(df).collect() == [] and bitplanes.clusters(df.limit(0)).count() == 0


@pytest.mark.parametrize(("low", "high"), [(0, 1), (-5, 6), (-(1 << 27), 1 << 27)])
def test_planes_give_exact_dot_products(low, high):
    rng = np.random.default_rng(high)
    a, b = rng.integers(low, high, (9, 64)), rng.integers(low, high, (4, 64))
    width = max(1, (high - low).bit_length())
    planes = bitplanes.to_planes(a - low, width)
    assert (bitplanes.from_planes(planes) + low == a).all()
    best, far = bitplanes.Centres(b, low).nearest(planes)
    exact = [[sum((int(x) - int(y)) ** 2 for x, y in zip(v, c, strict=True)) for c in b] for v in a]
    assert far.tolist() == [min(e) for e in exact] and best.tolist() == [e.index(min(e)) for e in exact]


# --- 13


def plain_super_minhash(hashes, slots):
    """The algorithm as published: elements one by one, a shuffle each, stopped at the largest rank that is still in use."""
    mix = lambda x: int(minhash.mix(np.array([x], np.uint64))[0])
    out, used, top = [None] * slots, [0] * slots, slots - 1
    used[-1] = slots
    for h in hashes:
        seed, order, rank = mix(h), list(range(slots)), 0
        while rank <= top:
            r = mix((seed + (rank + 1) * 0x9E3779B97F4A7C15) % 2**64)
            k = rank + ((r >> 32) * (slots - rank) >> 32)
            order[rank], order[k] = order[k], order[rank]
            at, value = order[rank], (rank << 32) | (r & 0xFFFFFFFF)
            if out[at] is None or value < out[at]:
                old = slots - 1 if out[at] is None else out[at] >> 32
                out[at] = value
                if rank < old:
                    used[old] -= 1
                    used[rank] += 1
                    while used[top] == 0:
                        top -= 1
            rank += 1
    return out


@pytest.mark.parametrize("slots", [16, 256])
def test_signatures_equal_the_plain_algorithm(slots):
    rng = random.Random(slots)
    sets = [np.array(sorted({rng.getrandbits(64) for _ in range(n)}), np.uint64) for n in (1, 2, 0, 7, 300, 40)]
    found = minhash.super_minhash(sets, slots)
    for s, own in zip(sets, found, strict=True):
        assert own.tolist() == (plain_super_minhash(s.tolist(), slots) if len(s) else [2**64 - 1] * slots)


def test_signatures_estimate_similarity():
    """Unbiased, with less variance than independent hashes have."""
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(300):
        x = rng.integers(0, 2**63, 60).astype(np.uint64)
        a, b = np.sort(x[:50]), np.sort(x[10:])
        one, two = minhash.super_minhash([a, b])
        errors.append((one == two).mean() - 40 / 60)
    assert abs(np.mean(errors)) < 0.006 and np.var(errors) < 0.8 * (40 / 60) * (20 / 60) / minhash.SLOTS


def brute_copies(rows, similarity=0.85, n=3):
    sets = []
    for _, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set())
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 100 * similarity * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for k, r in enumerate(root):
        least[r] = min((x for x in (least.get(r), rows[k][0]) if x is not None), default=None)
    return [(rows[k][0], len(sets[k]), least[r], rows[k][0] == least[r]) for k, r in enumerate(root)]


def edited(text, changes, seed):
    rng, ws = random.Random(seed), text.split(" ")
    for _ in range(changes):
        ws[rng.randrange(len(ws))] = f"new{rng.randrange(10**6)}"
    return " ".join(ws)


@pytest.mark.parametrize("hot_bucket", [4096, 6])
def test_near_copies_equal_brute_force(spark, hot_bucket):
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    base = [text(n) for n in (3, 4, 9, 30, 100, 400)]
    rows = [(r[0], r[1]) for r in ROWS] + [(100 + k, edited(b, c, 10 * k + c)) for k, (b, c) in enumerate(itertools.product(base, (0, 1, 2, 3, 5, 8, 14)))]
    rows += [(300 + k, edited(base[4], 2, k)) for k in range(30)] + [(400, "one"), (401, "ONE"), (402, "one two"), (403, " \t"), (None, base[3]), (404, base[3].upper())]
    df = spark.createDataFrame([(*r, "c", 0) for r in rows], "doc_id long, text string, node string, kept int").repartition(3)
    same(minhash.near_copies(df, hot_bucket=hot_bucket), brute_copies(rows))


def test_near_copies_of_nothing(spark, empty):  # noqa: F811
    assert minhash.near_copies(empty).count() == 0
    alone = spark.createDataFrame([(2, None), (1, ""), (None, " ")], "doc_id long, text string")
    same(minhash.near_copies(alone), [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)])


def test_pairs_at_the_limit_share_a_band():
    """Pairs whose similarity is 0.85 exactly, of small and large sets: all are candidates."""
    rng, missed = np.random.default_rng(3), 0
    for n in (17, 170, 850):
        for _ in range(150):
            x = rng.integers(0, 2**63, n * 20 // 17).astype(np.uint64)
            a, b = np.sort(x), np.sort(x[:n])
            slots = minhash.super_minhash([a, b])
            bits = np.packbits((minhash.mix(slots) & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint64)
            missed += not (minhash.bands(slots)[0] == minhash.bands(slots)[1]).any() or int(np.bitwise_count(bits[0] ^ bits[1]).sum()) > minhash.RADIUS
    assert missed == 0


def test_union_find_keeps_what_connects(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(300)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    for block in (1 << 20, 5):
        kept = minhash.forest(links, block).collect()
        root = {k: k for k in range(40)}
        for r in kept:
            a, b = root[r.a], root[r.b]
            root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
        assert {root[a] for p in pairs for a in p} == {0} and (block < 10 or len(kept) < 3 * 40)


# --- registered queries against SQL


@pytest.mark.parametrize("name", ["op11_collocations", "op12_centroid_clusters", "op13_minhash_near_dedup"])
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = c.execute(queries.SQL[name])
    columns = [d[0] for d in found.description]
    own = queries.QUERIES[name](spark, sf)
    assert sorted(own.columns) == sorted(columns)
    same(own.select(*columns), [tuple(r) for r in found.fetchall()])
