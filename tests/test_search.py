"""English stems, and search that opens few files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberlog.functions import english as E
from emberlog.operators import search as S
from emberlog.sources import commits
from emberlog.sources.shared import fresh_path

# Pairs of the published stemmer's vocabulary, and special cases of each step.
KNOWN = dict(
    x.split()
    for x in """consign consign|consigned consign|consigning consign|consignment consign|consistency consist|consistently consist|consolatory consolatori
consolidate consolid|conspicuously conspicu|conspiracy conspiraci|knackeries knackeri|knavish knavish|kneaded knead|knightly knight|knives knive|knotted knot
failing fail|failed fail|failure failur|connections connect|generously generous|happy happi|dying die|news news|hoped hope|hopping hop|ties tie|cries cri
gas gas|gaps gap|kiwis kiwi|say say|by by|agreed agre|proceed proceed|luxuriated luxuri|relational relat|conditional condit|communication communic
skies sky|national nation|vietnamization vietnam|apology apolog|controlling control|roll roll|bed bed|shredded shred|youth youth|formative format
refused refus|exceeded exceed|a a|y y|été été|1000 1000""".replace("\n", "|").split("|")
)


def stems(spark, words):
    return {r.word: r.stem for r in E.with_stem(spark.createDataFrame([(w,) for w in words], "word string"), "word").collect()}


def test_known_stems(spark):
    assert stems(spark, KNOWN) == KNOWN


def test_odd_words(spark):
    long = ["x" * 300_000, "a" * 300_000 + "ing", "y" * 100_000, "ya" * 100_000 + "tional"]
    found = stems(spark, [None, "", *long])
    assert found[None] is None and found[""] == "" and found[long[1]] == "a" * 300_000 and len(found) == 6


def records(spark, rows):
    return spark.createDataFrame([(i, dt.datetime(2024, 1, d, h) if d else None, m) for i, d, h, m in rows], "id long, timestamp timestamp_ntz, message string")


def scans(df):
    """Rows of df, and for each scan of files in its executed plan the files and partitions that it opened."""
    rows, plan = df.collect(), df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") else plan
    leaves, out = plan.collectLeaves(), []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.nodeName().startswith("Scan parquet"):
            out.append(leaf.metrics().get("numFiles").get().value())
    return rows, out


def test_search_finds_other_forms_and_opens_few_files(spark):
    rows = [(d * 24 + h, d, h, f"request {d * 24 + h} was accepted") for d in range(1, 6) for h in range(24)]
    rows += [(1000, 3, 7, "The connection FAILED"), (1001, 4, 20, "failing: no connections"), (1002, 4, 21, "failure of a connection"), (1003, None, 0, "connected, then failed"), (1004, 2, 2, None), (1005, 2, 3, "")]
    own, path = records(spark, rows), fresh_path(spark, "search")
    S.index_batch(own, path, "all", slots=24)
    found, opened = scans(S.search(spark, path, own.schema, "is the Failing connection"))
    assert sorted(r.id for r in found) == [1000, 1001, 1003]
    files = commits.read(spark, path, "records", own.schema).select(F.input_file_name()).distinct().count()
    assert files > 100 and opened == [3]
    assert [r.id for r in S.search(spark, path, own.schema, "accept 49").collect()] == [49]
    for nothing in ("", "the and of", "connection unheard", "..."):
        assert S.search(spark, path, own.schema, nothing).count() == 0


def test_words_of_one_slot_in_different_rows_do_not_match(spark):
    own, path = records(spark, [(1, 1, 1, "alpha"), (2, 1, 1, "beta"), (3, 1, 1, "alphas, beta")]), fresh_path(spark, "search")
    S.index_batch(own, path, "b")
    assert [r.id for r in S.search(spark, path, own.schema, "alpha betas").collect()] == [3]


def test_batches_delivered_again_and_cut_differently(spark):
    own, path = records(spark, [(k, 1 + k % 3, k % 24, f"job {k} timed out") for k in range(60)] + [(7, 1, 7, "job 7 timed out")]), fresh_path(spark, "search")
    for batch, slots in ((0, 1), (0, 96), (1, 96), (1, 1)):
        S.index_batch(own.where(F.col("id") % 2 == batch), path, str(batch), slots)
    assert S.search(spark, path, own.schema, "timing jobs").count() == 61
    assert [r.id for r in S.search(spark, path, own.schema, "jobs 7").collect()] == [7, 7]


@pytest.mark.parametrize("limit", [0, 100_000])
def test_shuffled_and_broadcast_slots_agree(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "BROADCAST_SLOTS", limit)
    own, path = records(spark, [(k, 1 + k % 3, k % 24, f"job {k} " + ("failed" if k % 5 == 0 else "passed")) for k in range(60)]), fresh_path(spark, "search")
    S.index_batch(own, path, "b")
    assert sorted(r.id for r in S.search(spark, path, own.schema, "fails").collect()) == list(range(0, 60, 5))


def test_empty_table_and_no_batch(spark):
    own, path = records(spark, []), fresh_path(spark, "search")
    assert S.search(spark, path, own.schema, "failed").count() == 0
    S.index_batch(own, path, "b")
    assert S.search(spark, path, own.schema, "failed").count() == 0
