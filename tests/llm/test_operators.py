"""The corpus operators against brute force, on rows with every odd thing: nulls, empty and long texts, repeated rows, empty tables, columns with clashing names."""

import collections
import datetime
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberlog.llm import (
    components,
    decontaminate,
    language,
    line_dedup,
    packing,
    pii,
    quality,
    records,
    rindex,
    simhash,
    substrings,
    url_filter,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"word{k}" for k in range(60))


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(50)) for _ in range(n))


ROWS = [
    (1, words(80, 1) + "\n" + PASSAGE, "en", "a", 1),
    (2, words(90, 2) + " é ünï " + PASSAGE.upper(), "fr", "a", 2),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \n\t\n ", "en", None, 5),
    (6, "Short one.", "en", "b", 10),
    (7, words(80, 1) + "\n" + PASSAGE, "en", "b", 1),
    (7, words(80, 1) + "\n" + PASSAGE, "en", "b", 1),
    (None, words(60, 3), "de", "c", 3),
    (8, (PASSAGE + " ") * 40, "en", "c", 9),
    (9, words(30_000, 4), "en", "c", 9),
    (10, "漢字 かな 12345 😀 " * 30, "ja", "c", 9),
    (11, "a" * 5000, None, "c", 9),
    *((20 + k, f"{words(55, 50 + k)}\nThis very line is repeated in many documents here.\n  THIS very line is repeated in many documents here.", "en", "d", 1) for k in range(7)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is not None, x) for x in row)


def same(df, expected):
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(expected, key=key)


# --- 1


def test_language_learns_and_marks_texts_without_letters(spark):
    rng = random.Random(0)
    parts = {"xx": ["ka", "lo", "mi"], "yy": ["str", "ung", "ö"], "zz": ["ção", "ei", "qu"]}
    rows = [(k, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(60)), lang) for k, lang in enumerate(list(parts) * 60)]
    df = spark.createDataFrame([*rows, (900, None, "xx"), (901, "123 456 !", "yy"), (None, "kalomi kalo", None), (902, "", None)], "doc_id long, text string, lang string")
    model = language.fit(df, per_language=40)
    assert model.languages == ["xx", "yy", "zz"]
    out = {r.doc_id: r for r in language.identify(df.withColumn("score", F.lit("clash")), model).collect()}
    held = [(k, lang) for k, _, lang in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([out[k].lang_pred == lang for k, lang in held]) > 0.95
    assert [(out[k].lang_pred, out[k].score) for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert out[None].lang_pred == "xx" and 0 < out[None].score <= 1


def test_language_gradients():
    """Backpropagation through time agrees with differences."""
    rng = np.random.default_rng(0)
    x, u, b = (rng.normal(0, 0.5, s) for s in ((256, 9), (3, 9), (3,)))
    data = rng.integers(97, 100, (5, 2))
    g = rng.normal(size=(5, 2, 3))

    def loss() -> float:
        return float((language._forward(x, u, b, data, range(5)).astype(float) * g).sum())

    tape: list = []
    language._forward(x, u, b, data, range(5), tape)
    _, d_u, d_b = language._backward(u, data, tape, g)
    for w, d in ((u, d_u), (b, d_b)):
        for at in list(np.ndindex(w.shape))[::4]:
            old = w[at]
            w[at] = old + 1e-3
            up = loss()
            w[at] = old - 1e-3
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-3 - d[at]) < 5e-3


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 3000])
def test_probabilities_equal_the_plain_network(n):
    """The fast pass over many windows against the form that was trained, letter by letter."""
    rng = np.random.default_rng(n)
    units, langs = 4, ["a", "b", "c"]
    normal = lambda *shape: rng.normal(0, 0.7, shape).astype(np.float32)
    x, u, b = ([normal(*shape) for _ in range(2)] for shape in ((256, 3 * units), (units, 3 * units), (units,)))
    model = language.Model(langs, x, u, b, normal(2 * units, 3), normal(3))
    texts = [bytes(rng.integers(32, 256, n + k).astype(np.uint8)) for k in range(3)] + [b"", b"12 34", b"Az"]
    found = language.probabilities(model, texts)
    for text, own in zip(texts, found, strict=True):
        sums, letters = np.zeros(3), 0
        for k in range(0, len(text), language.WINDOW):
            data = np.frombuffer(text[k : k + language.WINDOW].ljust(language.WINDOW), np.uint8)[:, None]
            ways = (range(language.WINDOW), range(language.WINDOW - 1, -1, -1))
            states = np.concatenate([language._forward(x[d], u[d], b[d], data, ways[d]) for d in (0, 1)], axis=2)[:, 0]
            logits = (states @ model.out + model.out_b).astype(float)
            for c, row in zip(data[:, 0].tolist(), logits, strict=True):
                if c >= 0x80 or chr(c).isalpha():
                    sums += np.exp(row - row.max()) / np.exp(row - row.max()).sum()
                    letters += 1
        assert np.allclose(own, sums / max(1, letters), atol=1e-4)


def test_every_language_is_learned(spark, monkeypatch):
    """More languages than the sample has room for: fewer documents of each, but no language is left out; repeated rows and long texts are read to the end."""
    rows = [(k, f"{k % 130} " + chr(0x4E00 + k % 130) * 20, f"l{k % 130}") for k in range(130 * 8)]
    rows += [(5000, "x" * 200_000 + "é", "l1"), (5000, "x" * 200_000 + "é", "l1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang for r in language.training_sample(df).collect()} == {f"l{k}" for k in range(130)}
    monkeypatch.setattr(language, "SAMPLE_TOTAL", 260)
    drawn = [r.lang for r in language.training_sample(df).collect()]
    assert len(set(drawn)) == 130 and len(drawn) <= 260 * language.SAMPLE_WINDOWS
    monkeypatch.setattr(language, "SAMPLE_TOTAL", 10)
    drawn = [r.lang for r in language.training_sample(df).collect()]
    assert len(set(drawn)) == 130 and len(drawn) <= 130 * language.SAMPLE_WINDOWS
    model = language.fit(df.where("doc_id < 40"), per_language=2)
    assert language.identify(df, model).where("doc_id = 5000").count() == 2


def test_language_without_labels(empty):
    model = language.fit(empty)
    assert model.languages == [] and language.identify(empty, model).count() == 0


# --- 2


def test_records_round_trip(spark, docs, tmp_path):
    path = f"file://{tmp_path}/records"
    records.write_records(docs.withColumn("frame", F.lit("clash")).withColumn("value", F.lit(1)), path, public_tokenizers.path("word_bpe_49k.json"), file_blocks=1)
    index = records.write_index(spark, path)
    assert records.read_index(spark, path).count() == len(ROWS)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    expected, start, ids_of = [], 0, collections.defaultdict(list)
    for r in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]
        expected.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        ids_of[r[0]].append(ids)
        start += len(ids)
    same(index.select("doc_id", "start", "n_tokens", "ids_crc32"), expected)
    some = index.where("doc_id in (8, 6, 2)").orderBy(F.desc("doc_id"))
    assert {r.doc_id: r.ids for r in records.read_records(spark, path, some).collect()} == {k: ids_of[k][0] for k in (8, 6, 2)}


def test_record_files_are_bounded_by_bytes(spark, tmp_path):
    """However long texts are, a file holds a few blocks, each of the records of a slice of text."""
    path = f"file://{tmp_path}/records"
    rows = [(k, "word " * (60_000 if k % 2 else 3)) for k in range(40)]
    records.write_records(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, public_tokenizers.path("word_bpe_49k.json"), file_blocks=2)
    index = records.write_index(spark, path)
    sizes = [r.size for r in index.groupBy("file").agg(F.sum("size").alias("size")).collect()]
    largest = index.agg(F.max("size")).first()[0]
    assert len(sizes) > 3 and max(sizes) < 2 * ((1 << 20) + largest) and index.count() == 40


def test_frames_find_damage():
    raw = records.frame(5, np.array([1, 70_000], "<u4")) + b"\n" + records.frame(None, np.array([3], "<u4")) + b"\n"
    assert [(d, x.tolist()) for _, _, d, x in records.frames(raw)] == [(5, [1, 70_000]), (None, [3])]
    for at in (0, 9, 20, len(raw) - 3):
        with pytest.raises(ValueError):
            list(records.frames(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :]))


def test_file_names_with_misleading_middles(spark):
    names = spark.createDataFrame([("part-00012-0aa1-c123-part-77-c000.txt",), ("part-00012-0aa1-c123-part-77-c010.txt",)], "file string")
    assert [tuple(r) for r in names.select(*records.file_place(F.col("file"))).collect()] == [(12, 0), (12, 10)]


def test_records_of_nothing(spark, empty, tmp_path):
    path = f"file://{tmp_path}/none"
    records.write_records(empty, path, public_tokenizers.path("word_bpe_49k.json"))
    assert records.build_index(spark, path).count() == 0
    assert records.write_index(spark, path).count() == 0


# --- 3

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_hits(rows, items, n=10):
    found = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        m = min(n, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            found[tuple(w[k : k + m])].add("" if i is None else str(i))
    out = []
    for r in rows:
        w, hit, ids = WORD.findall((r[1] or "").translate(LOWER)), set(), set()
        for m in {len(x) for x in found}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in found:
                    ids |= found[tuple(w[k : k + m])]
                    hit.update(range(k, k + m))
        out.append((r[0], len(w), len(hit), ",".join(sorted(ids)), bool(hit)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination(spark, docs, block):
    items = [(1, PASSAGE), (2, "word5 WORD6; word7"), (3, None), (3, "!!"), (4, " ".join(words(80, 1).split()[10:30])), (None, "short one"), (2, "nothing here at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(decontaminate.build_index(docs, 3000), bench, block_bytes=block)
    n_hit = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    same(found.select("doc_id", F.col("n_words").cast("int"), n_hit, F.array_join("items", ","), n_hit > 0), brute_hits(ROWS, items))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one two X three four"), (2, "one two three four"), (3, "four three two one")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three four")], "item_id long, text string")
    out = {r.doc_id: (r["items"], r.near_items) for r in decontaminate.contamination(docs, items, slack=1).collect()}
    assert out == {1: ([], ["7"]), 2: (["7"], ["7"]), 3: ([], [])}


def test_proximity_stays_in_a_document(spark):
    """Random near items against brute force, in many short documents of one segment."""
    rng = random.Random(21)
    some = lambda n: [rng.choice("abcdefghijkl") for _ in range(n)]
    texts, items, slack, window = [some(rng.randrange(0, 12)) for _ in range(120)], [some(5) for _ in range(40)], 2, 4
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")

    def near(text, win):
        at = lambda i: range(max(0, i - slack), min(len(text), i + slack + 1))
        starts = range(-slack, len(text) - window + slack + 1)
        return any(all(any(text[x] == win[i] for x in at(s + i)) for i in range(window)) for s in starts)

    found = {r.doc_id: set(r.near_items) for r in decontaminate.find(decontaminate.build_index(docs), bench, window, slack).collect()}
    expected = {k: {str(i) for i, t in enumerate(items) if any(near(text, t[j : j + window]) for j in range(2))} for k, text in enumerate(texts)}
    assert found == expected and sum(map(len, found.values())) > 10
    cut = decontaminate.find(decontaminate.build_index(docs.repartition(4), 100), bench, window, slack)  # other segments, same items
    assert {r.doc_id: set(r.near_items) for r in cut.collect()} == expected


def test_decontamination_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(empty, none).count() == 0
    assert not decontaminate.contamination(docs, none).where("contaminated").count()


def test_decontamination_with_clashing_columns_and_a_long_text(spark):
    """Columns named like those that the operator makes, an item at the end of a text of 2 MB, repeated rows."""
    long = words(200_000, 5) + " " + PASSAGE
    rows = [(1, long), (2, PASSAGE), (2, PASSAGE), (None, None), (3, "")]
    docs = spark.createDataFrame([(*r, 9, "x", [1], "z") for r in rows], "doc_id long, text string, segment int, nth string, spans array<int>, items string")
    bench = spark.createDataFrame([(5, PASSAGE, "d", 1)], "item_id long, text string, doc_id string, n_words int")
    found = decontaminate.contamination(docs, bench)
    same(found.select("doc_id", F.col("n_words").cast("int"), F.col("n_hit").cast("int"), F.array_join("items", ","), "contaminated"), brute_hits(rows, [(5, PASSAGE)]))


# --- 4


def test_urls(spark):
    urls = [
        (1, "http://a.example.com/en/7x?q"), (2, "HTTP://COM/en/"), (3, "x://example.NET/de/8#y"), (4, "http://sub.net/de/"), (5, "http://example.org/es"),
        (6, None), (7, "no scheme"), (8, "http://notcom/en/"), (9, ""), (9, ""), (None, "http://b.org/es/1"), (11, "http://xexample.com/en/7"), (12, "a://b://c.com/en/"),
    ]
    pages = spark.createDataFrame([(*u, "x") for u in urls], "page_id long, url string, verdict string")

    def brute(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    same(url_filter.filter_pages(pages, url_filter.rule_table(spark, url_filter.RULES)), [(i, *brute(u)) for i, u in urls])
    none = url_filter.rule_table(spark, [])
    assert {r.verdict for r in url_filter.filter_pages(pages, none).collect()} == {"allow"}
    assert url_filter.filter_pages(pages.limit(0), none).count() == 0


def test_rules_of_the_contract(spark):
    """The word of each rule as the contract lists it, and the verdicts that follow."""
    assert {h + p: v for h, p, v in url_filter.RULES} == {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    pages = spark.createDataFrame([(1, "http://sub.net/de/x"), (2, "http://example.net/de/7"), (3, "http://a.example.net/de/81")], "page_id long, url string")
    found = url_filter.filter_pages(pages, url_filter.rule_table(spark, url_filter.RULES)).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in found) == [(1, "net/de/", "allow"), (2, "net/de/", "allow"), (3, "example.net/de/8", "block")]


def test_urls_with_many_shapes(spark):
    """Rules of 900 shapes, a very long URL, rules of equal length with other hosts."""
    rules = [(".".join(["h"] * k + ["com"]), "/" + "p" * n, "block") for k in range(1, 31) for n in range(30)]
    rules += [("a.net", "/bc", "block"), ("net", "/bc/de", "allow"), ("x.a.net", "/b", "block"), (None, "/", "block")]
    urls = [(1, "http://" + "h." * 40 + "com/" + "p" * 200_000), (2, "http://x.a.net/bc/de"), (3, "http://h.com/q?p"), (4, "s://A.NET/bcz#x"), (5, None)]
    found = url_filter.filter_pages(spark.createDataFrame(urls, "page_id long, url string"), url_filter.rule_table(spark, rules)).collect()
    best = {r.page_id: (r.rule, r.verdict) for r in found}
    assert best[1] == (".".join(["h"] * 30 + ["com"]) + "/" + "p" * 29, "block")
    assert best[2] == ("x.a.net/b", "block") and best[3] == ("h.com/", "block") and best[4] == ("a.net/bc", "block") and best[5] == (None, "allow")


# --- 5


def test_run_index():
    rng = np.random.default_rng(1)
    for _ in range(20):
        base = [bytes(rng.integers(97, 99, rng.integers(3, 30)).astype(np.uint8)) for _ in range(5)]
        parts = [b"".join(base[k] for k in rng.integers(0, 5, 4)) for _ in range(20)]
        text, begin = rindex.symbols(parts)
        places = np.concatenate([b + np.arange(max(0, len(p) - 9)) for b, p in zip(begin, parts, strict=True)])
        seen = {}
        for p, first in zip(places, rindex.first_places(text, places, 10), strict=True):
            assert first == seen.setdefault(text[p : p + 10].tobytes(), p)


@pytest.mark.parametrize("split", [512, 2])
def test_repeats(docs, split):
    rows, seen, expected = {(r[0], r[1] or "") for r in ROWS}, set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw, marks = t.encode(), np.zeros(len(t.encode()) + 1, int)
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                marks[k] += 1
                marks[k + 100] -= 1
            seen.add(raw[k : k + 100])
        gone = np.cumsum(marks)[:-1] > 0
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        expected[i, t] = (i, len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    out = substrings.remove_repeats(docs.withColumn("start", F.lit(1)), split_runs=split).withColumn("h", F.sha2("kept", 256)).drop("kept")
    same(out, [expected[r[0], r[1] or ""] for r in ROWS])


def brute_repeats(texts, length=100):
    """n_removed by text, for texts in order."""
    seen, removed = set(), []
    for raw in texts:
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in seen:
                gone[k : k + length] = True
            seen.add(raw[k : k + length])
        removed.append(int(gone.sum()))
    return removed


@pytest.mark.parametrize("split", [512, 3])
def test_repeats_around_common_passages(spark, split):
    """Passages that are longer or shorter than a stretch, alone and in mixed contexts, and texts with periods."""
    rng = random.Random(11)
    letters = lambda n, of="abcdefghij": "".join(rng.choice(of) for _ in range(n))
    common = [letters(n) for n in (30, 60, 95, 99, 140)]
    texts = [letters(rng.randrange(0, 60), "ab") + rng.choice(common) + letters(rng.randrange(0, 60), "ab") + rng.choice(common) for _ in range(150)]
    texts += [letters(k) * (400 // k) for k in (1, 2, 7, 24, 30, 90, 101)] + [letters(3) * 100 + common[4] for _ in range(5)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.n_removed for r in substrings.remove_repeats(rows, split_runs=split).collect()}
    assert [found[k] for k in range(len(texts))] == brute_repeats([t.encode() for t in texts])


def test_halves_stay_few_and_end(spark):
    """Runs of a frequent key: a few parts for each, not a row for each byte; and a key whose runs all differ late still ends."""
    rng = random.Random(12)
    seed = "the same twenty-four byte"
    texts = ["".join(rng.choice("abcdefgh") for _ in range(90)) + seed + "".join(rng.choice("abcdefgh") for _ in range(90)) for _ in range(200)]
    own = substrings._own(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    none = F.lit(None).cast("int")
    key = int(substrings.Rolling(np.frombuffer(seed[:24].encode(), np.uint8)).of(np.array([0]), np.array([24])).view(np.int64)[0])
    bytes_ = F.expr("substring(text, 15, 176)")
    runs = own.select(F.lit(key).alias("key"), "doc", "variant", F.lit(14).cast("long").alias("start"), none.alias("a"), none.alias("l"), none.alias("h"), bytes_.alias("b"))
    halves = runs.mapInArrow(substrings._halved(100, 24), substrings._RUNS).collect()
    assert len(halves) == 400
    assert sum(len(r["bytes"]) - 99 for r in halves) == 200 * 77


def test_repeats_of_rows_without_ids(spark):
    """Many rows of no or one id: texts whose hashes share 22 bits are still told apart."""
    hashes = spark.range(9000).select(F.concat(F.lit("text "), "id").alias("text")).select("text", F.shiftrightunsigned(F.xxhash64("text"), 42).alias("h"))
    met = hashes.groupBy("h").agg(F.collect_list("text").alias("t")).where("size(t) > 1").first().t[:2]
    rng = random.Random(13)
    long = ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (150, 160)]
    hash_of = lambda df: df.select("text", F.shiftrightunsigned(F.xxhash64("text"), 42).alias("h"))
    made = spark.range(30_000).select(F.concat(F.lit(long[0]), F.lit(" "), "id").alias("text"))
    other = hash_of(spark.range(30_000).select(F.concat(F.lit(long[1]), F.lit(" "), "id").alias("text"))).withColumnRenamed("text", "other")
    pair = hash_of(made).join(other, "h").orderBy("text", "other").first()
    texts = [pair["text"], pair["other"], long[0], long[1], *met]
    for ids in ([None] * 6, [5] * 6, [1, 2, 3, 4, 5, 6]):
        rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
        out = substrings.remove_repeats(rows).collect()
        assert sum(r.n_removed for r in out) == 310


def test_repeats_of_nothing(empty):
    assert substrings.remove_repeats(empty).count() == 0


# --- 6


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0


def test_pseudonyms(spark):
    rows = [
        (1, "card 4041894974608795 or 4041 8949 7460 8795, not 4041894974608796"), (2, "born 1984-02-29 or 29.02.1984, not 1985-02-29"), (3, "ip 8.8.4.4 and 300.1.1.1"),
        (4, "me.Too42@mail.example.com, +1 (988) 555-2485"), (5, None), (6, ""), (6, ""), (7, 'token = "be8a8e7152a5c568"'), (None, "ip 8.8.4.4"), (8, "ssn 123-45-6789"),
        (9, "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, not DE88370400440532013000"),
    ]
    out = [(r.doc_id, r.text, r.pii_kinds) for r in pii.pseudonymize(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, pii_kinds string"), pii.DEMO_KEY).collect()]
    of = {i: t for i, t, _ in out}
    one, two = re.findall(r"(?:\d ?){16}", of[1])[:2]
    assert one.replace(" ", "") == two.replace(" ", "").strip() and luhn(one.strip()) and one != "4041894974608795" and "4041894974608796" in of[1]
    iso, dots = re.search(r"\d{4}-\d\d-\d\d", of[2])[0], re.search(r"\d\d\.\d\d\.\d{4}", of[2])[0]
    assert iso.split("-") == dots.split(".")[::-1] and "1985-02-29" in of[2] and iso != "1984-02-29"
    assert "8.8.4.4" not in of[3] and "300.1.1.1" in of[3] and of[None] == of[3].split(" and")[0]
    assert re.fullmatch(r"[a-z0-9]{2}\.[a-z0-9]{5}@mail\.example\.com, \+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", of[4])
    assert of[5] is None and of[6] == "" and re.fullmatch(r'token = "[0-9a-f]{16}"', of[7]) and re.fullmatch(r"ssn \d{3}-\d\d-\d{4}", of[8])
    spaced, plain, bad = re.search(r"(DE\d\d(?: \d{4}){4} \d\d) and (GB\d\dWEST\d{14}), not (\S+)", of[9]).groups()
    for x in (spaced.replace(" ", ""), plain):
        assert int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    assert spaced != "DE89 3704 0044 0532 0130 00" and plain[8:] != "12345698765432" and bad == "DE88370400440532013000"
    assert sorted(len(k) for _, _, k in out) == [0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2]


def test_pseudonyms_in_very_long_texts(spark):
    """What may repeat in a value does not exhaust the stack, nor take time that grows with the square of the text."""
    parts = ["a.", "x@a.", "12 ", "1234 ", "+49 ", "AB12 ", "ab", "1.", "password=", "2024-01-", "@"]
    texts = ["x@" + "a." * 600_000 + "com", *(f"{p * (1_000_000 // len(p))} me@example.org" for p in parts)]
    found = pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8), "k").orderBy("doc_id").collect()
    assert len(found) == len(texts) and all("email" in r.pii_kinds for r in found)


def test_network_against_plain_integers(spark):
    """The Feistel network on addresses, days and numbers in plain Python, its inverse, and no clash with the caller's columns."""
    key = "another key"

    def part(*x):
        return int(hashlib.sha256("|".join(map(str, (key, *x))).encode()).hexdigest()[:15], 16)

    def network(kind, left, right, a, b, back=False):
        for i in range(8, 0, -1) if back else range(1, 9):
            if back:
                right = (right - part(kind, i, a, b, "r", left) % b) % b
                left = (left - part(kind, i, a, b, "l", right) % a) % a
            else:
                left = (left + part(kind, i, a, b, "l", right) % a) % a
                right = (right + part(kind, i, a, b, "r", left) % b) % b
        return left, right

    def address(text, back=False):
        o = [int(x) for x in text.split(".")]
        x, y = network("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, back)
        return f"{x >> 8}.{x & 255}.{y >> 8}.{y & 255}"

    def day(text, back=False):
        first = datetime.date(1700, 1, 1)
        days = (datetime.date.fromisoformat(text) - first).days
        x, y = network("date", *divmod(days, 773), 189, 773, back)
        return (first + datetime.timedelta(x * 773 + y)).isoformat()

    def social(text, back=False):
        area, group, serial = map(int, text.split("-"))
        x, y = network("ssn", area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, back)
        return f"{x + 1 + (x + 1 >= 666):03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"

    rng = random.Random(3)
    values = [(address, ".".join(str(rng.randrange(256)) for _ in range(4))) for _ in range(30)]
    values += [(day, (datetime.date(1950, 1, 1) + datetime.timedelta(rng.randrange(30_000))).isoformat()) for _ in range(30)]
    values += [(social, f"{rng.choice([1, 665, 667, 899])}".zfill(3) + f"-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10_000):04d}") for _ in range(30)]
    rows = spark.createDataFrame([(k, f"on {v} ", "own") for k, (_, v) in enumerate(values)], "doc_id long, text string, _found string")
    out = {r.doc_id: r for r in pii.pseudonymize(rows.withColumn("row", F.lit(1)).withColumn("named", F.lit(2)), key).collect()}
    for k, (f, v) in enumerate(values):
        assert out[k].text == f"on {f(v)} " and f(f(v), back=True) == v
        assert (out[k]._found, out[k]["row"], out[k].named) == ("own", 1, 2)
    assert pii.pseudonymize(rows.limit(0), key).count() == 0
    long = spark.createDataFrame([(1, "no data here " * 60_000 + "10.1.2.3")], "doc_id long, text string")
    assert pii.pseudonymize(long, key).first().text.endswith(f"here {address('10.1.2.3')}")


def test_pseudonyms_permute(spark):
    """Different values of a format have different pseudonyms."""
    phones = spark.range(3000).select(F.col("id").alias("doc_id"), F.format_string("%03d-555-%04d", F.col("id") % 800 + 200, F.col("id")).alias("text"))
    out = pii.pseudonymize(phones, pii.DEMO_KEY).select("text").distinct()
    assert out.where(r"text rlike '^[2-9]\\d\\d-[2-9]\\d\\d-\\d{4}$'").count() == 3000


# --- 7


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, repeats = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)

    def covered(n):
        c = collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        return {k + j for k in range(len(w) - n + 1) if c[tuple(w[k : k + n])] > 1 for j in range(n)}

    three = len(covered(3))
    failed = len(w) < 50 or 100 * three > 50 * len(w)
    grams = [sum(len(w[k]) for k in covered(n)) for n in quality.MAX_GRAM_SHARE]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), repeats, three, failed, grams


def test_quality(docs, empty):
    out = quality.quality_rules(docs.withColumn("kept", F.lit("x"))).collect()
    assert len(out) == len(ROWS)
    for r in out:
        *counts, failed, grams = brute_quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*counts, failed)
        assert [r[f"dup_{n}gram_chars"] for n in quality.MAX_GRAM_SHARE] == grams
        kept = not failed and r.dup_line_chars <= quality.MAX_LINE_SHARE * counts[1] and all(g <= s * counts[1] for g, s in zip(grams, quality.MAX_GRAM_SHARE.values(), strict=True))
        assert r.kept == kept
    assert quality.quality_rules(empty).count() == 0


# --- 8


def test_packing(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    packed = packing.pack_documents(docs, path, with_ids=True)
    expected, total = [], 0
    for r in ROWS:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        for k, (start, n) in enumerate(packing.cut(len(ids))):
            expected.append((r[0], k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
    same(packed.select("doc_id", "piece", "start", "length", "ids_crc32"), expected)
    bins = collections.defaultdict(list)
    for r in packed.collect():
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(bins) <= -(-total // 1024) + 1
    assert {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(packed).collect()} == {k: sum(n for _, n in b) for k, b in bins.items()}
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_with_clashing_columns_and_a_long_text(spark):
    """Every id of a text of 1 MB has one place; columns named like those that the operator makes play no part."""
    rows = [(1, words(100_000, 6)), (None, None), (2, ""), (2, "")]
    docs = spark.createDataFrame([(*r, 1, "x", 2, b"q") for r in rows], "doc_id long, text string, piece int, row_salt string, length long, ids binary")
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    long = sorted((r.start, r.length) for r in packed if r.doc_id == 1)
    assert long[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(long)) and all(n == 1024 for _, n in long[1:])
    assert sorted((r.doc_id is None, r.piece, r.start, r.length) for r in packed if r.doc_id != 1) == [(False, 0, 0, 1), (False, 0, 0, 1), (True, 0, 0, 1)]
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) and max(r.offset + r.length for r in packed) <= 1024


def test_packing_of_equal_rows(spark, monkeypatch):
    """Rows of one id and text are dealt to many rank groups like others; places stay gapless."""
    monkeypatch.setattr(packing, "GROUP_ROWS", 10)
    df = spark.createDataFrame([(None, "same text")] * 300 + [(7, "same text")] * 200, "doc_id long, text string").repartition(4)
    found = packing.pack_documents(df, public_tokenizers.path(packing.VOCABULARY))
    assert "row_salt" not in found.columns
    by = collections.defaultdict(list)
    for r in found.collect():
        by[r.sequence_id].append((r.offset, r.length))
    assert sum(map(len, by.values())) == 500
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE


def test_plan_replaces_the_smallest_with_two():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]  # greedy: 6 + 3; better: 6 + 2 + 2
    assert packing.plan(counts, 10)[0] == ([6, 2, 2], 1)
    rng = np.random.default_rng(0)
    for _ in range(20):
        counts = np.bincount(rng.integers(1, 101, 300), minlength=101)
        used = np.zeros(101, int)
        for lengths, times in packing.plan(counts, 100):
            assert sum(lengths) <= 100
            np.add.at(used, lengths, times)
        assert (used == counts).all()


# --- 9


@pytest.mark.parametrize("hot", [10_000, 3])
def test_lines(docs, empty, hot):
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = collections.defaultdict(set)
    for r in ROWS:
        for x in (r[1] or "").split("\n"):
            if len(norm(x)) >= 40:
                holders[norm(x)].add(r[0])
    expected = []
    for r in ROWS:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(norm(x), ())) >= 5 and r[0] != max(h for h in holders[norm(x)] if h is not None))]
        expected.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    out = line_dedup.dedup_lines(docs.withColumn("words", F.lit(1)), hot_lines=hot)
    same(out.select("doc_id", F.col("n_lines").cast("int"), F.col("n_dropped").cast("int"), "kept_text"), expected)
    assert sum(e[2] for e in expected) == 12
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_of_a_long_document(spark):
    line = "The quick brown fox jumps over the lazy dog today"
    rows = [(k, "\n".join([line, *(f"{k} {n}" for n in range(200)), line])) for k in range(6)]
    out = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {k: (202, 0 if k == 5 else 2) for k in range(6)}


# --- 10


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    if not w:
        return 0
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, ids):
    root = list(range(len(ids)))

    def find(k):
        return k if root[k] == k else find(root[k])

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, i in enumerate(ids):
        least[find(k)].append(i)
    return [min((i for i in least[find(k)] if i is not None), default=None) for k in range(len(ids))]


def test_simhash(docs, empty):
    prints = [brute_fingerprint(r[1]) for r in ROWS]
    groups = brute_components(prints, [r[0] for r in ROWS])
    out = simhash.simhash_components(docs.withColumn("fp", F.lit("clash")))
    same(out, [(r[0], f"{p:016x}", g) for r, p, g in zip(ROWS, prints, groups, strict=True)])
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("hot", [4096, 2])
def test_links_lose_none(spark, hot):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    every = [base]
    for _ in range(4):
        x = every[-1].copy()
        for _ in range(2):
            x ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
        every.append(x)
    fps = np.unique(np.concatenate(every))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r.node: r.component for r in components.components(simhash.links(df, hot_bucket=hot)).collect()}
    groups = brute_components([int(x) for x in fps], [int(x) for x in fps.view(np.int64)])
    assert [found.get(int(x), int(x)) for x in fps.view(np.int64)] == groups


@pytest.mark.parametrize("radius", [2, 5, 20])
def test_bit_planes(radius):
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**64, (150, 2), dtype=np.uint64)
    fps[75:] = fps[:75]
    fps[75:, 0] ^= np.uint64(0b111)
    bucket = np.sort(rng.integers(0, 2, 150))
    a, b = simhash.compare(fps, bucket, radius)
    far = lambda i, j: sum((int(x) ^ int(y)).bit_count() for x, y in zip(fps[i], fps[j], strict=True))
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(i, j) for i in range(150) for j in range(i) if bucket[i] == bucket[j] and far(i, j) <= radius}


def jaccard_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if group[i] != group[j] and (a == b or len(a & b) >= 0.8 * len(a | b)):
            old, new = sorted((group[i], group[j]), reverse=True)
            group = [new if g == old else g for g in group]
    return group


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_similar_sets_share_a_signature(similarity):
    """Pairs of every small size, and of larger ones, as different as they may be: none is without a common signature."""
    rng = np.random.default_rng(17)
    sizes = [*range(1, 40), *(int(x) for x in rng.integers(40, 3000, 60))]
    for n in sizes:
        for large in {n, n + 1, int(n / similarity + 1e-9), int(rng.integers(n, int(n / similarity + 1e-9) + 1))}:
            both = math.ceil(similarity / (1 + similarity) * (n + large) - 1e-9)  # the fewest common elements
            if both > n or n == large == both:
                continue
            for _ in range(30 if n < 40 else 3):
                u = rng.integers(0, 2**64, n + large - both, dtype=np.uint64)
                a, b = np.unique(u[:n]), np.unique(np.concatenate([u[:both], u[n:]]))
                number, found = simhash.signatures([a, np.zeros(0, np.uint64), b], similarity)
                assert not (number == 1).any()
                assert np.intersect1d(found[number == 0], found[number == 2]).size, (n, large)


@pytest.mark.parametrize("lane_words", [None, 1])
def test_bit_planes_of_those_that_ask(lane_words):
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 2**64, (300, 1), dtype=np.uint64)
    bucket, asks = np.sort(rng.integers(0, 2, 300)), rng.random(300) < 0.5
    found = {(i, j) for a, b in simhash.compared(fps, bucket, 28, asks, lane_words) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    place = [i - int(np.searchsorted(bucket, bucket[i])) for i in range(300)]
    far = lambda i, j: (int(fps[i, 0]) ^ int(fps[j, 0])).bit_count()
    most = 64 if lane_words else 300
    assert found == {(i, j) for i in range(300) for j in range(i) if bucket[i] == bucket[j] and far(i, j) <= 28 and asks[i] and place[j] < most}


@pytest.mark.parametrize("hot", [4096, 8])
def test_near_copies_by_sets(spark, hot):
    """Groups of copies with one word in n changed, above and below the threshold, in the same buckets."""
    rng = random.Random(8)
    rows = [(None, words(70, 9000)), (900, ""), (901, None), (902, "two words"), (903, "Two  words"), (904, "two words more")]
    for base, (every, copies) in enumerate([(60, 12), (25, 6), (20, 12), (12, 6), (400, 3)]):
        start = words(240, 100 + base).split()
        for _ in range(copies):
            w = [f"new{rng.randrange(10**6)}" if rng.randrange(every) == 0 else x for x in start]
            rows.append((len(rows), " ".join(w)))
    rows += [rows[-1], (2000, rows[-1][1].upper())]
    group = jaccard_components(rows)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, node string, class string")
    out = simhash.drop_near_copies(df, hot_bucket=hot)
    assert out.columns == df.columns
    found = [r.doc_id for r in out.collect()]
    key = lambda x: (x is not None, x)
    expected = [min((r[0] for r, g in zip(rows, group, strict=True) if g == c), key=key) for c in set(group)]
    assert sorted(found, key=key) == sorted(expected, key=key)
    assert simhash.drop_near_copies(df.limit(0)).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (101, 100)], "a long, b long")
    assert {r.node: r.component for r in components.components(edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components.components(edges.limit(0)).count() == 0
