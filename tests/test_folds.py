"""Folds by composed functions against folds row by row, and counts before moments."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.operators import folds
from emberlog.operators import incidents as I  # noqa: E741

DAY = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("sizes", [[1], [1, 2, 3], [7, 1, 40], [129]])
def test_reduced_equals_one_by_one(sizes):
    rng = np.random.default_rng(sum(sizes))
    start = np.cumsum([0, *sizes[:-1]])
    clamp = np.stack([rng.normal(0, 1, sum(sizes)), np.full(sum(sizes), -1.0), np.full(sum(sizes), 2.0)], axis=1)
    move = np.concatenate([rng.integers(0, 3, (sum(sizes), 3)), rng.integers(0, 2, (sum(sizes), 3))], axis=1).astype(float)
    for steps, compose in ((clamp, folds.clamps), (move, folds.transitions)):
        found = folds.reduced(steps, start, compose)
        for k, n in enumerate(sizes):
            whole = steps[start[k]][None]
            for s in steps[start[k] + 1 : start[k] + n]:
                whole = compose(whole, s[None])
            assert np.allclose(found[k], whole[0])


def test_weights_of_a_hot_indicator(spark):
    """One indicator has nearly all outcomes, over many tasks and batches; equal times are ordered by id."""
    rng = random.Random(3)
    rows = [(k, DAY + dt.timedelta(seconds=rng.randrange(5000)), rng.choice([*I.VERDICTS, "true_negative"]), ["hot"] if k % 50 else ["hot", "rare"]) for k in range(6000)]
    rows.append((None, None, "true_positive", ["late", None]))
    df = spark.createDataFrame(rows, "incident_id long, created_at timestamp_ntz, verdict string, fired_indicators array<string>").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = {r.indicator: r for r in I.feedback_weights(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name in ("hot", "rare"):
        w, counts = 1.0, dict.fromkeys(I.VERDICTS, 0)
        for _, _, v, _ in sorted((r for r in rows if r[1] and name in r[3] and r[2] in I.VERDICTS), key=lambda r: (r[1], r[0])):
            w, counts[v] = min(max(w + I.VERDICTS[v] * 0.05, 0.1), 5.0), counts[v] + 1
        r = found[name]
        assert r.weight == pytest.approx(w, abs=1e-4) and [r.true_positives, r.false_positives, r.false_negatives] == [counts[v] for v in ("true_positive", "false_positive", "false_negative")]
    assert found["late"].weight == found[None].weight == 1.05


def test_outcomes_are_forwarded_once(spark, tmp_path):
    rows = [(k, DAY + dt.timedelta(hours=k), "true_positive", ["a"]) for k in range(4)]
    df = spark.createDataFrame(rows, "incident_id long, created_at timestamp_ntz, verdict string, fired_indicators array<string>")
    for batch in ("x", "x", "y"):
        out = I.log_outcomes(df.where("incident_id < 2") if batch == "x" else df.where("incident_id >= 2"), f"file://{tmp_path}/o", batch)
    assert [(r.weight, r.total_fired) for r in out.collect()] == [(1.2, 4)]


def test_replay_of_a_hot_id(spark):
    rng = random.Random(4)
    rows = [(0 if k % 20 else k, DAY + dt.timedelta(seconds=rng.randrange(400)), rng.choice(["submit", "approve", "none", None] if k % 3 else ["submit"])) for k in range(3000)]
    events = spark.createDataFrame(rows, "id long, at timestamp_ntz, action string")
    found = {r.id: (r.status, r.rejected) for r in I.replay_transitions(spark.range(0, 200), events, I.REPORT_MOVES, "draft").collect()}
    for i in range(200):
        status, rejected = "draft", 0
        own = [r for r in rows if r[0] == i]
        for _, _, a in sorted(own, key=lambda r: (r[1], r[2] is not None, r[2] or "")):
            to = I.REPORT_MOVES.get(a, {}).get(status)
            status, rejected = to or status, rejected + (to is None)
        assert found[i] == (status, rejected), i
    assert I.replay_transitions(spark.range(2), events.limit(0), I.REPORT_MOVES, "draft").where("status = 'draft' and rejected = 0").count() == 2


def test_counts_before_moments(spark):
    rng = random.Random(5)
    at = lambda: DAY + dt.timedelta(seconds=rng.randrange(3 * 86400))
    logs = [(rng.choice("ab"), at(), rng.choice(["ERROR", "INFO", "FATAL"])) for _ in range(900)]
    logs += [("a", DAY + dt.timedelta(hours=5), "ERROR")] * 3
    asked = [(k, rng.choice("abc"), at(), bool(k % 2)) for k in range(60)] + [(60, "a", DAY + dt.timedelta(hours=5), True), (61, "a", DAY + dt.timedelta(hours=5), False)]
    df = spark.createDataFrame(logs, "service_name string, timestamp timestamp_ntz, severity string")
    moments = spark.createDataFrame(asked, "moment long, service_name string, at timestamp_ntz, inclusive boolean")
    expected = {m: sum(s == x and sev != "INFO" and (t < when or inc and t == when) for x, t, sev in logs) for m, s, when, inc in asked}
    assert {r.moment: r.n for r in I.counts_before(df, moments).collect()} == expected
    assert I.counts_before(df.limit(0), moments).agg(F.sum("n")).first()[0] == 0
