"""Baselines, anomalies, velocity, drift, pattern matches and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions import text as T
from emberlog.functions import vectors as V
from emberlog.operators import cells
from emberlog.operators.errors import errors, within

# Thresholds, weights, templates.
Z_LIMIT, Z_CRITICAL = 3.0, 6.0
WARNING, CRITICAL = 60.0, 80.0
WEIGHTS = (0.30, 0.40, 0.30)
COUNT_CAP, FIRST_CAP, SECOND_CAP = 500, 50, 25
TEMPLATES = {
    "spike": "🔴 %s is experiencing an error spike. Current error rate is %.0f errors/hour — %.1f× above the normal baseline of %.1f ± %.1f.",
    "new_error_type": "⚠️ %s is producing a new type of error not seen before: '%s'. This may indicate a newly introduced code path or dependency failure.",
    "service_silence": "🔇 %s has gone unexpectedly silent — no log records in the last %d minutes. The service may be down, unresponsive, or its log pipeline may be broken.",
    "cluster_drift": "📈 Error cluster '%s' in %s is drifting. The error pattern is evolving toward new failure modes (centroid shift: %.2f).",
}
ACTIONS = {
    "critical": ["Page on-call SRE immediately", "Review error logs for the last 15 minutes", "Check recent deployments for this service", "Prepare rollback plan"],
    "other": ["Monitor error rate closely for the next 10 minutes", "Review error logs for the last 15 minutes", "Check recent deployments for this service"],
}


def hourly_counts(logs: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Errors of each service and hour in the days up to an hour before as_of; hours without errors have no row."""
    own = errors(logs).where((F.col("timestamp") >= as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col("timestamp") < as_of - F.expr("INTERVAL 1 HOUR")))
    return own.groupBy("service_name", F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))


def zero_filled(hours: DataFrame, services: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """hourly_counts with a row for every hour of the look-back of every service."""
    spine = services.select("service_name").distinct().withColumn(
        "hour",
        F.explode(
            F.sequence(
                F.date_trunc("hour", as_of - F.expr(f"INTERVAL {days} DAYS")).cast("timestamp_ntz"),
                F.date_trunc("hour", as_of - F.expr("INTERVAL 2 HOURS")).cast("timestamp_ntz"),
                F.expr("INTERVAL 1 HOUR"),
            )
        ),
    )
    return spine.join(hours, ["service_name", "hour"], "left").select("service_name", "hour", F.coalesce("n", F.lit(0)).alias("n"))


def baseline(samples: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """Mean and population deviation by keys: (0, 1) below three samples, and a deviation of 0 becomes 1."""
    few = F.count("*") < 3
    return samples.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.when(few, 0.0).otherwise(F.avg(value)).alias("mean"),
        F.when(few, 1.0).otherwise(F.coalesce(F.nullif(F.stddev_pop(value), F.lit(0.0)), F.lit(1.0))).alias("std"),
    )


def explain(kind: Column, service: Column, context: Column) -> Column:
    """Sentences for anomalies; context: observed, z, mean, std, message, minutes, label, drift."""
    return (
        F.when(kind == "spike", F.format_string(TEMPLATES["spike"], service, context["observed"], context["z"], context["mean"], context["std"]))
        .when(kind == "new_error_type", F.format_string(TEMPLATES["new_error_type"], service, F.substring(context["message"], 1, 120)))
        .when(kind == "service_silence", F.format_string(TEMPLATES["service_silence"], service, context["minutes"]))
        .when(kind == "cluster_drift", F.format_string(TEMPLATES["cluster_drift"], context["label"], service, context["drift"]))
        .otherwise(F.concat(F.lit("Anomaly detected in "), service, F.lit(": "), kind))
    )


def spikes(logs: DataFrame, as_of: Column, z_limit: float = Z_LIMIT) -> DataFrame:
    """Services whose errors of the last hour are z_limit deviations away from their hourly baseline, up or down."""
    base = baseline(hourly_counts(logs, as_of), ["service_name"])
    now = within(errors(logs), as_of, "1 HOUR").groupBy("service_name").agg(F.count("*").alias("observed"))
    z = F.abs(F.col("observed") - F.col("mean")) / F.col("std")
    return (
        base.join(now, "service_name", "full_outer")
        .select(
            "service_name", F.coalesce("observed", F.lit(0)).cast("double").alias("observed"),
            F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("std", F.lit(1.0)).alias("std"),
        )
        .withColumn("z", z).where(F.col("z") >= z_limit)
        .withColumn("severity", F.when(F.col("z") > Z_CRITICAL, "critical").otherwise("warning"))
    )


def new_error_types(groups: DataFrame, flagged: DataFrame, as_of: Column, minutes: int = 60) -> DataFrame:
    """Groups that occurred once, first within the look-back, and aren't flagged (service_name, fingerprint) yet."""
    own = groups.where((F.col("occurrence_count") == 1) & (F.col("first_seen") >= as_of - F.expr(f"INTERVAL {minutes} MINUTES")))
    return own.join(flagged, ["service_name", "fingerprint"], "left_anti")


def silences(logs: DataFrame, open_silences: DataFrame, as_of: Column, minutes: int = 15, least: int = 10) -> DataFrame:
    """Services without a record for minutes that had least records in the 7 days before, unless their silence is open already."""
    start = as_of - F.expr(f"INTERVAL {minutes} MINUTES")
    week = logs.where((F.col("timestamp") >= as_of - F.expr("INTERVAL 7 DAYS")) & (F.col("timestamp") <= as_of))
    counts = week.groupBy("service_name").agg(
        F.count_if(F.col("timestamp") >= start).alias("recent"), F.count_if(F.col("timestamp") < start).alias("history")
    )
    return counts.where((F.col("recent") == 0) & (F.col("history") >= least)).join(open_silences, "service_name", "left_anti")


def velocity_windows(logs: DataFrame, seconds: int = 60, *keys: str) -> DataFrame:
    """Errors of tumbling windows by service and severity, and their first and second differences to the windows before that had errors (0 where there are too few)."""
    keys = keys or ("service_name", "severity")
    counts = errors(logs).groupBy(*keys, F.window(F.col("timestamp").cast("timestamp"), f"{seconds} seconds").alias("w")).agg(F.count("*").alias("error_count"))
    by = W.partitionBy(*keys).orderBy("window_start")
    one, two = F.lag("error_count", 1).over(by), F.lag("error_count", 2).over(by)
    return counts.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "error_count").select(
        *keys, "window_start", "error_count",
        F.coalesce(F.col("error_count") - one, F.lit(0)).alias("first_derivative"),
        F.coalesce(F.col("error_count") - 2 * one + two, F.lit(0)).alias("second_derivative"),
    )


def velocity_score(count: Column, first: Column, second: Column) -> Column:
    zero = F.lit(0)
    part = lambda x, cap: F.least(F.greatest(x, zero) / cap, F.lit(1.0))
    return F.round(F.least(30 * part(count, COUNT_CAP) + 30 * part(first, FIRST_CAP) + 40 * part(second, SECOND_CAP), F.lit(100.0)), 2)


def baseline_scores(windows: DataFrame, as_of: Column, days: int = 28) -> DataFrame:
    """windows with the mean and deviation of earlier windows of the same service, severity, hour and weekday in the look-back before as_of, and a score of at most 100.

    Windows at as_of's latest hour are scored against the others; hour and weekday are the window's own.
    """
    keys = ["service_name", "severity", "hour", "weekday"]
    own = windows.where((F.col("window_start") >= as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col("window_start") < as_of))
    own = own.withColumn("hour", F.hour("window_start")).withColumn("weekday", F.weekday("window_start"))
    latest = own.withColumn("_n", F.row_number().over(W.partitionBy("service_name", "severity").orderBy(F.desc("window_start")))).where("_n = 1")
    history = own.join(latest.select("service_name", "severity", F.col("window_start").alias("_last")), ["service_name", "severity"]).where(F.col("window_start") < F.col("_last"))
    base = baseline(history, keys, "error_count")
    mean, std = F.coalesce("mean", F.lit(0.0)), F.coalesce("std", F.lit(1.0))
    z = F.abs(F.col("error_count") - mean) / std
    return latest.join(base, keys, "left").select(
        "service_name", "severity", "window_start", "error_count", mean.alias("mean"), std.alias("std"),
        F.round(F.least(z / Z_LIMIT * 100, F.lit(100.0)), 2).alias("baseline_score"),
    )


def drift_scores(vectors: DataFrame, recent: int = 20, before: int = 100) -> DataFrame:
    """Per service: how far the mean of its newest vectors (highest ids) turned away from the mean of the ones before; 0 if either is missing."""
    ranked = vectors.withColumn("_n", F.row_number().over(W.partitionBy("service_id").orderBy(F.desc("id")))).where(F.col("_n") <= recent + before)
    part = ranked.withColumn("part", F.when(F.col("_n") <= recent, "new").otherwise("old"))
    means = V.centroids(part, ["service_id", "part"], "embedding", None)
    both = means.groupBy("service_id").agg(
        F.max(F.when(F.col("part") == "new", F.col("centroid"))).alias("a"), F.max(F.when(F.col("part") == "old", F.col("centroid"))).alias("b")
    )
    turned = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.least(F.greatest((1 - V.cosine(F.col("a"), F.col("b"), 1.0)) * 100, F.lit(0.0)), F.lit(100.0)))
    return both.select("service_id", F.round(F.coalesce(turned, F.lit(0.0)), 2).alias("drift_score"))


def match_patterns(queries: DataFrame, vectors: DataFrame, k: int = 5, threshold: float = 0.75, tile: int = cells.TILE, pivots: int = cells.PIVOTS) -> DataFrame:
    """Each query vector (query_id, service_id, embedding) against the k most similar vectors of its service, itself not among them; matches from threshold (above 0) on give a score, the best label, its confidence and the alerts.

    Exact, by branch and bound over cells of vectors: a query opens only cells that can hold one of its matches.
    """
    q = queries.select(F.col("id").alias("query_id"), "service_id")
    own = cells.split(vectors, "service_id", tile, pivots)
    found, _ = cells.nearest(own, cells.unit_length(queries, "service_id"), k, threshold, tile)
    top = found.join(vectors.select("id", "label", "alert_id"), "id")
    good = top.where(F.col("similarity") >= threshold).groupBy("query_id").agg(
        F.avg("similarity").alias("mean"),
        F.max_by("label", F.struct("similarity", -F.col("id"))).alias("matched_pattern"),
        F.round(F.max("similarity"), 4).alias("confidence"),
        F.array_sort(F.collect_set("alert_id")).alias("alert_ids"),
        F.count("*").alias("matches"),
    )
    score = F.when(F.col("mean").isNotNull(), F.round(F.least((F.col("mean") - threshold) / (1 - threshold) * 100, F.lit(100.0)), 2))
    return q.select("query_id", "service_id").join(good, "query_id", "left").select(
        "query_id", "service_id", F.coalesce(score, F.lit(0.0)).alias("similarity_score"), "matched_pattern",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("alert_ids", F.array().cast("array<string>")).alias("alert_ids"),
        F.coalesce("matches", F.lit(0)).alias("matches"),
    )


def risk_score(velocity: Column, similarity: Column, base: Column, weights: tuple[float, float, float] = WEIGHTS) -> Column:
    if abs(sum(weights) - 1) > 1e-6:
        raise ValueError("the weights of a risk score must sum up to 1")
    total = velocity * weights[0] + similarity * weights[1] + base * weights[2]
    return F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)), 2)


def risk_tier(score: Column, warning: float = WARNING, critical: float = CRITICAL) -> Column:
    return F.when(score >= critical, "critical").when(score >= warning, "warning").otherwise("normal")


def recommended_actions(tier: Column) -> Column:
    table = {t: F.array(*(F.struct(F.lit(i + 1).alias("priority"), F.lit(a).alias("action")) for i, a in enumerate(x))) for t, x in ACTIONS.items()}
    return F.when(tier == "critical", table["critical"]).otherwise(table["other"])


def alert_text(service: Column, score: Column, tier: Column, pattern: Column, velocity: Column, base: Column) -> Column:
    return F.format_string(
        "Service '%s' is showing elevated risk (score %.1f, tier: %s). Matched pattern: %s. Velocity signal is %.1f/100, baseline deviation is %.1f/100.",
        service, score, tier, F.coalesce(pattern, F.lit("unknown")), velocity, base,
    )


def threshold_text(service: Column, score: Column, tier: Column) -> Column:
    return F.format_string(
        "[Threshold-based alert — AI inference unavailable] Service '%s' has crossed the %s threshold with a raw risk score of %.1f. Manual investigation is recommended.",
        service, tier, score,
    )


def risk_cycle(logs: DataFrame, vectors: DataFrame, as_of: Column) -> DataFrame:
    """One scoring round over all services: velocity of the latest window, baseline score, pattern match (drift where a service has no vectors), risk, tier."""
    windows = velocity_windows(logs).where(F.col("severity") == "ERROR")
    last = windows.withColumn("_n", F.row_number().over(W.partitionBy("service_name").orderBy(F.desc("window_start")))).where("_n = 1")
    velocity = last.select("service_name", velocity_score(F.col("error_count"), F.col("first_derivative"), F.col("second_derivative")).alias("velocity_score"))
    base = baseline_scores(windows, as_of).select("service_name", "baseline_score")
    newest = vectors.withColumn("_n", F.row_number().over(W.partitionBy("service_id").orderBy(F.desc("id")))).where("_n = 1").drop("_n")
    match = match_patterns(newest, vectors).select(F.col("service_id").alias("service_name"), "similarity_score", "matched_pattern")
    drift = drift_scores(vectors).select(F.col("service_id").alias("service_name"), "drift_score")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    joined = velocity.join(base, "service_name", "left").join(match, "service_name", "left").join(drift, "service_name", "left")
    scored = joined.select(
        "service_name", zero("velocity_score").alias("velocity_score"), F.coalesce("similarity_score", "drift_score", F.lit(0.0)).alias("similarity_score"),
        zero("baseline_score").alias("baseline_score"), "matched_pattern",
    ).withColumn("risk_score", risk_score(F.col("velocity_score"), F.col("similarity_score"), F.col("baseline_score")))
    return scored.withColumn("risk_tier", risk_tier(F.col("risk_score")))


def keyword_search(logs: DataFrame, words: list[str]) -> DataFrame:
    return logs.where(T.matches_all(F.col("message"), words))
