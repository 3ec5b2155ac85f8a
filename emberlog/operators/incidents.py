"""Root causes, deployments, health, outcomes, policies, reports and state transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions import text as T
from emberlog.operators import folds
from emberlog.operators.errors import errors
from emberlog.sources import commits, sinks

# Fixed values.
CAUSE_SEVERITIES = ["ERROR", "CRITICAL", "FATAL", "WARNING", "WARN"]
LEAD_SECONDS, LEAD_RATIO = 30, 0.5
RATE_JUMP, SIZE_JUMP = 0.50, 2.0
LEARNING_RATE, LEAST_WEIGHT, MOST_WEIGHT = 0.05, 0.1, 5.0
DEFAULT_TIER, TIERS = "propose", ["observe", "propose", "auto"]
#: Verdict: change of an indicator's weight in learning rates.
VERDICTS = {"true_positive": 1.0, "false_positive": -1.0, "false_negative": -0.5}
REPORT_SECTIONS = {
    "summary": "Summary", "timeline": "Timeline", "impact_analysis": "Impact Analysis", "root_cause": "Root Cause", "resolution": "Resolution",
    "preventive_actions": "Preventive Actions",
}


# --- root causes


def causes(logs: DataFrame) -> DataFrame:
    """All errors and warnings of all services, in no order: id, timestamp, service, severity, message (300 characters)."""
    own = logs.where(F.col("severity").isin(CAUSE_SEVERITIES))
    return own.select("id", "timestamp", F.col("service_name").alias("service"), "severity", F.substring(F.coalesce("message", F.lit("")), 1, 300).alias("message"))


def timeline(logs: DataFrame, services: list[str], start: Column, end: Column, limit: int | None = 200) -> DataFrame:
    """The first limit errors and warnings of services from start to end (both included): id, timestamp, service, severity, message (300 characters)."""
    own = causes(logs.where(F.col("service_name").isin(services) & F.col("timestamp").between(start, end))).orderBy("timestamp", "id")
    return own.limit(limit) if limit else own


def dependencies(events: DataFrame, lead: int = LEAD_SECONDS, ratio: float = LEAD_RATIO) -> DataFrame:
    """src, dst, lead_ratio: services whose events another service's events follow within lead seconds more often than ratio.

    An event looks into its own time bucket of lead seconds and the next one.
    Of a service's events in a bucket the last decides for events of the
    same bucket, and the first for those of the bucket before, so an event
    meets one row of each service, however many events follow it.
    """
    bucket = F.floor(F.unix_micros(F.col("timestamp").cast("timestamp")) / (lead * 1_000_000)).cast("long")
    own = events.select(F.col("service").alias("src"), F.col("timestamp").alias("t"), bucket.alias("bucket"))
    ends = events.groupBy(F.col("service").alias("dst"), bucket.alias("slot")).agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    here, before = ends.select("dst", F.col("slot").alias("bucket"), "last"), ends.select("dst", (F.col("slot") - 1).alias("bucket"), "first")
    later = here.join(before, ["dst", "bucket"], "full_outer")
    follows = own.join(later, "bucket").where(
        (F.col("src") != F.col("dst")) & ((F.col("last") > F.col("t")) | (F.col("first") <= F.col("t") + F.expr(f"INTERVAL {lead} SECONDS")))
    )
    followed = follows.groupBy("src", "dst").agg(F.count("*").alias("followed"))
    sizes = own.groupBy("src").agg(F.count("*").alias("n"))
    return followed.join(sizes, "src").where(F.col("followed") / F.col("n") > ratio).select("src", "dst", F.round(F.col("followed") / F.col("n"), 4).alias("lead_ratio"))


def causal_chain(events: DataFrame, edges: DataFrame) -> DataFrame:
    """A step for each service: those that follow no other first, then by first event. error_spike above five events."""
    by = F.struct("timestamp", "id")
    steps = events.groupBy("service").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first_ts"), F.min_by("severity", by).alias("severity"), F.min_by("message", by).alias("message")
    )
    ranked = events.withColumn("_n", F.row_number().over(W.partitionBy("service").orderBy("timestamp", "id"))).where("_n <= 5")
    ids = ranked.groupBy("service").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "id"))), lambda x: x["id"]).alias("supporting_log_ids"))
    below = edges.select(F.col("dst").alias("service"), F.lit(True).alias("is_downstream")).distinct()
    impact = edges.groupBy(F.col("src").alias("service")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ", ").alias("impact"))
    joined = steps.join(ids, "service").join(below, "service", "left").join(impact, "service", "left")
    down = F.coalesce("is_downstream", F.lit(False))
    text = F.concat(
        F.format_string("%d %s event(s) starting at %s. First message: %s", "n", "severity", F.date_format("first_ts", "yyyy-MM-dd'T'HH:mm:ss"), F.substring("message", 1, 120)),
        F.when(F.col("impact").isNotNull(), F.concat(F.lit(" [Downstream impact on: "), "impact", F.lit("]"))).otherwise(""),
    )
    return joined.select(
        F.row_number().over(W.orderBy(down, "first_ts", "service")).alias("step"), "service",
        F.when(F.col("n") > 5, "error_spike").otherwise("new_error").alias("event_type"), "first_ts", text.alias("description"), "supporting_log_ids",
        F.when(down, 0.5).otherwise(0.7).alias("confidence"),
    )


# --- deployments


def previous_deployments(snapshots: DataFrame) -> DataFrame:
    """Snapshots with the version and time of the one before of the same service."""
    by = W.partitionBy("service_name").orderBy("deployed_at", "id")
    return snapshots.withColumn("previous_version", F.lag("version").over(by)).withColumn("previous_at", F.lag("deployed_at").over(by))


def counts_before(logs: DataFrame, moments: DataFrame) -> DataFrame:
    """moment, n: how many errors of its service came before each moment (moment, service_name, at; and at it, if inclusive).

    Errors are summed up by service and minute and then cumulatively, so a
    service has as many rows as minutes, whatever its errors; a moment looks up
    the sum of the minutes before its own. Errors of its own minute meet it one
    by one and correct that. So no error is multiplied by the deployments of its service.
    """
    minute = lambda c: F.date_trunc("minute", c).cast("timestamp_ntz")
    own = errors(logs).select("service_name", "timestamp", minute("timestamp").alias("minute"))
    asked = moments.withColumn("minute", minute("at"))
    none = F.lit(None).cast(moments.schema["moment"].dataType).alias("moment")
    counted = own.groupBy("service_name", "minute").agg(F.count("*").alias("n")).withColumn("moment", none)
    line = counted.unionByName(asked.select("service_name", "minute", F.lit(0).cast("long").alias("n"), "moment"))
    earlier = W.partitionBy("service_name").orderBy(F.unix_seconds(F.col("minute").cast("timestamp"))).rangeBetween(W.unboundedPreceding, -1)
    sums = line.withColumn("n", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where("moment is not null").select("moment", "n")
    before = (F.col("timestamp") < F.col("at")) | (F.col("inclusive") & (F.col("timestamp") == F.col("at")))
    edge = asked.join(own, ["service_name", "minute"]).where(before).groupBy("moment").agg(F.count("*").alias("edge"))
    return sums.join(edge, "moment", "left").select("moment", (F.col("n") + F.coalesce("edge", F.lit(0))).alias("n"))


def rate_regressions(logs: DataFrame, snapshots: DataFrame, hours: float = 2.0, jump: float = RATE_JUMP) -> DataFrame:
    """Deployments after which errors per hour rose by jump or more against the same time before. Errors at the time of deployment count as after it, and so do those at the window's end."""
    span = F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")
    d = previous_deployments(snapshots).select("id", "service_name", "version", "previous_version", "deployed_at")
    at = lambda k, when, inclusive=False: F.struct(F.lit(k).alias("k"), when.alias("at"), F.lit(inclusive).alias("inclusive"))
    edges = F.explode(F.array(at(0, F.col("deployed_at") - span), at(1, F.col("deployed_at")), at(2, F.col("deployed_at") + span, True)))
    moments = d.select("id", "service_name", edges.alias("e")).select(F.struct("id", "e.k").alias("moment"), "service_name", "e.at", "e.inclusive")
    value = lambda k: F.max(F.when(F.col("moment.k") == k, F.col("n")))
    counted = counts_before(logs, moments).groupBy("moment.id").agg((value(1) - value(0)).alias("before"), (value(2) - value(1)).alias("after"))
    rated = d.join(counted, "id").select(
        "id", "service_name", "version", "previous_version",
        F.round(F.col("before") / max(hours, 0.001), 4).alias("baseline_rate"), F.round(F.col("after") / max(hours, 0.001), 4).alias("head_rate"),
    )
    delta = (F.col("head_rate") - F.col("baseline_rate")) / F.col("baseline_rate")
    found = rated.where((F.col("baseline_rate") > 0) & (F.col("head_rate") > 0)).withColumn("delta", F.round(delta, 4)).where(delta >= jump)
    text = F.format_string(
        "%s: error rate increased %.1f%% after deploying %s (was %.1f/h, now %.1f/h).",
        "service_name", F.round(F.col("delta") * 100, 1), "version", F.round("baseline_rate", 1), F.round("head_rate", 1),
    )
    return found.withColumn("confidence", F.least("delta", F.lit(1.0))).withColumn("explanation", text)


def new_groups_after(groups: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Error groups first seen since a service's latest deployment."""
    last = snapshots.groupBy("service_name").agg(F.max_by("version", "deployed_at").alias("version"), F.max("deployed_at").alias("deployed_at"))
    return groups.join(last, "service_name").where(F.col("first_seen") >= F.col("deployed_at")).select("service_name", "fingerprint", "version", "occurrence_count")


def size_jumps(before: DataFrame, after: DataFrame, keys: list[str], factor: float = SIZE_JUMP) -> DataFrame:
    """Clusters (keys, n) that grew to factor times their size or more."""
    grown = before.withColumnRenamed("n", "n_before").join(after.withColumnRenamed("n", "n_after"), keys)
    return grown.where(F.col("n_after") >= factor * F.col("n_before")).withColumn("factor", F.round(F.col("n_after") / F.col("n_before"), 4))


def cluster_growth(members: DataFrame, deployments: DataFrame, keys: list[str], factor: float = SIZE_JUMP) -> DataFrame:
    """keys, n_before, n_after, factor: clusters that grew to factor times their size or more by the members (keys, at) that came since their service's deployment (the first of keys, at). Clusters without members before are new, not grown."""
    since = deployments.groupBy(keys[0]).agg(F.max("at").alias("since"))
    sizes = members.where(F.col("label") >= 0).join(since, keys[0]).groupBy(*keys).agg(F.count_if(F.col("at") < F.col("since")).alias("n_before"), F.count("*").alias("n_after"))
    grown = sizes.where((F.col("n_before") > 0) & (F.col("n_after") >= factor * F.col("n_before")))
    return grown.withColumn("factor", F.round(F.col("n_after") / F.col("n_before"), 4))


def config_diff(snapshots: DataFrame, base: str, head: str) -> DataFrame:
    """Keys whose values differ between each service's base and head versions; a missing key is null."""
    def entries(version: str, name: str) -> DataFrame:
        return snapshots.where(F.col("version") == version).select("service_name", F.explode("config_snapshot").alias("key", name))

    both = entries(base, "base_value").join(entries(head, "head_value"), ["service_name", "key"], "full_outer")
    return both.where(~F.col("base_value").eqNullSafe(F.col("head_value")))


def compare_snapshots(snapshots: DataFrame, base: str, head: str) -> DataFrame:
    """Per service: whether version and deployer changed, and the seconds between both deployments."""
    cols = ["service_name", "version", "deployed_by", "deployed_at"]
    b = snapshots.where(F.col("version") == base).select(cols[0], *(F.col(c).alias(f"b_{c}") for c in cols[1:]))
    h = snapshots.where(F.col("version") == head).select(cols[0], *(F.col(c).alias(f"h_{c}") for c in cols[1:]))
    seconds = F.abs(F.unix_seconds(F.col("h_deployed_at").cast("timestamp")) - F.unix_seconds(F.col("b_deployed_at").cast("timestamp")))
    return b.join(h, "service_name").select(
        "service_name", (~F.col("b_version").eqNullSafe(F.col("h_version"))).alias("version_changed"),
        (~F.col("b_deployed_by").eqNullSafe(F.col("h_deployed_by"))).alias("deployer_changed"), seconds.alias("seconds_between"),
    )


# --- health


def health_states(services: DataFrame, risk: DataFrame, anomalies: DataFrame, clusters: DataFrame) -> DataFrame:
    """100 - 20 (warning) or 50 (critical) - 5 for each open anomaly (30 at most) - 2 for each active cluster (20 at most), 0 at least.

    services: service_id, name; risk: service_id, risk_tier; anomalies and clusters: service_id, n.
    """
    joined = (
        services.join(risk.select("service_id", "risk_tier"), "service_id", "left")
        .join(anomalies.select("service_id", F.col("n").alias("open_anomalies")), "service_id", "left")
        .join(clusters.select("service_id", F.col("n").alias("active_clusters")), "service_id", "left")
        .fillna(0, ["open_anomalies", "active_clusters"]).fillna("normal", ["risk_tier"])
    )
    tier = F.when(F.col("risk_tier") == "critical", 50).when(F.col("risk_tier") == "warning", 20).otherwise(0)
    score = 100 - tier - F.least(5 * F.col("open_anomalies"), F.lit(30)) - F.least(2 * F.col("active_clusters"), F.lit(20))
    return joined.withColumn("health_score", F.greatest(score, F.lit(0)).cast("double"))


def fleet_summary(states: DataFrame) -> DataFrame:
    h = F.col("health_score")
    return states.agg(
        F.count("*").alias("total_services"), F.count_if(h >= 80).alias("healthy"), F.count_if((h >= 50) & (h < 80)).alias("warning"),
        F.count_if(h < 50).alias("critical"), F.sum("open_anomalies").alias("open_anomalies"), F.sum("active_clusters").alias("active_clusters"),
        F.min_by("name", F.struct("health_score", "name")).alias("worst_service"),
    )


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, fields: list[str], name: str) -> DataFrame:
    """The first k rows of each key as an ordered list of structs."""
    ranked = df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k)
    rows = F.array_sort(F.collect_list(F.struct("_n", *fields)))
    return ranked.groupBy(*keys).agg(F.transform(rows, lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(name))


# --- outcomes and policies


def feedback_weights(outcomes: DataFrame, rate: float = LEARNING_RATE) -> DataFrame:
    """Weights of indicators after all outcomes in order of time and id, with counters, precision and recall (4 digits).

    Clamping makes a step depend on those before, but each step is a
    function x -> min(max(x + d, low), high), and such functions compose to
    one of the same form (folds.clamps). So an indicator may have any number of outcomes; no list of them is made.
    """
    delta = F.lit(0.0)
    for verdict, d in VERDICTS.items():
        delta = F.when(F.col("verdict") == verdict, d * rate).otherwise(delta)
    step = F.array(delta, F.lit(LEAST_WEIGHT), F.lit(MOST_WEIGHT))
    rows = outcomes.where(F.col("verdict").isin(*VERDICTS)).select("incident_id", "created_at", "verdict", F.explode("fired_indicators").alias("indicator"), step.alias("step"))
    folded = folds.fold(rows, ["indicator"], ["created_at", "incident_id"], folds.clamps)
    count = lambda v: F.count_if(F.col("verdict") == v)
    counts = rows.groupBy("indicator").agg(count("true_positive").alias("true_positives"), count("false_positive").alias("false_positives"), count("false_negative").alias("false_negatives"))
    d, low, high = (F.col("step")[k] for k in range(3))
    tp = F.col("true_positives")
    ratio = lambda other: F.round(F.coalesce(F.try_divide(tp, tp + F.col(other)), F.lit(0.0)), 4)
    return counts.join(folded, counts["indicator"].eqNullSafe(folded["indicator"])).select(
        counts["indicator"], F.round(F.least(F.greatest(1.0 + d, low), high), 4).alias("weight"), "true_positives", "false_positives", "false_negatives",
        (tp + F.col("false_positives") + F.col("false_negatives")).alias("total_fired"), ratio("false_positives").alias("precision"), ratio("false_negatives").alias("recall"),
    )


def log_outcomes(new: DataFrame, path: str, batch: str) -> DataFrame:
    """Stores a batch of outcomes once, however often it is delivered, and forwards all that were ever stored to the weights, which are returned."""
    spark = new.sparkSession
    if commits.find(spark, path, batch) is None:
        attempt = commits.new_attempt()
        sinks.append(new, commits.folder(path, "outcomes", attempt))
        commits.publish(spark, path, batch, attempt, ["outcomes"])
    return feedback_weights(commits.read(spark, path, "outcomes", new.schema))


def resolve_autonomy(requests: DataFrame, policies: DataFrame, default: str = DEFAULT_TIER) -> DataFrame:
    """requests (tool_name, environment, service_id) with autonomy_tier: the service's own policy, else the one for all services, else the default; an unknown tier counts as propose."""
    keys = ["tool_name", "environment"]
    own = policies.where(F.col("service_id").isNotNull()).select(*keys, "service_id", F.col("autonomy_tier").alias("_own"))
    general = policies.where(F.col("service_id").isNull()).select(*keys, F.col("autonomy_tier").alias("_general"))
    tier = F.coalesce("_own", "_general", F.lit(default))
    joined = requests.join(own, [*keys, "service_id"], "left").join(general, keys, "left")
    return joined.withColumn("autonomy_tier", F.when(tier.isin(TIERS), tier).otherwise("propose")).drop("_own", "_general")


# --- reports and state


def premortem_text(service: Column, score: Column, tier: Column, pattern: Column) -> Column:
    return F.format_string(
        "# Pre-mortem: %s\n\n**Risk score:** %.1f (%s)\n\n**Matched pattern:** %s\n\n## Likely failure\n\nReview the signals above before the next change.\n",
        service, score, tier, F.coalesce(pattern, F.lit("unknown")),
    )


def report_markdown(report: dict[str, Column]) -> Column:
    """A report as Markdown: title, seven header lines and six sections; dashes and a note stand for what is missing."""
    dash = lambda k: F.coalesce(F.nullif(report[k], F.lit("")), F.lit("—"))
    head = [
        F.concat(F.lit("# "), F.coalesce(report["title"], F.lit("Incident Report")), F.lit("\n")),
        F.concat(F.lit("**Incident ID:** "), dash("incident_id"), F.lit("  ")),
        F.concat(F.lit("**Severity:** "), F.upper(dash("severity")), F.lit("  ")),
        F.concat(F.lit("**Status:** "), dash("status"), F.lit("  ")),
        F.concat(F.lit("**Started:** "), dash("started_at"), F.lit("  ")),
        F.concat(F.lit("**Resolved:** "), dash("resolved_at"), F.lit("  ")),
        F.concat(F.lit("**Affected services:** "), dash("affected_services"), F.lit("  ")),
        F.concat(F.lit("**Generated:** "), dash("created_at"), F.lit("  ")),
        F.lit(""),
    ]
    sections = [
        F.concat(F.lit(f"## {title}\n\n"), F.coalesce(F.nullif(report[k], F.lit("")), F.lit("_Not available._")), F.lit("\n\n")) for k, title in REPORT_SECTIONS.items()
    ]
    return F.concat_ws("\n", *head, *sections)


def replay_transitions(rows: DataFrame, events: DataFrame, allowed: dict[str, dict[str, str]], initial: str) -> DataFrame:
    """id and status of rows after their events (id, at, action) in order; actions that the present status doesn't allow, or that aren't known, have no effect (and count as rejected).

    allowed: action -> {status before: status after}. An action is a table of moves between
    statuses, and tables compose (folds.transitions), so an id may have any number of events.
    """
    states = list(dict.fromkeys([initial, *(x for moves in allowed.values() for pair in moves.items() for x in pair)]))
    table = lambda moves: F.array(*(F.lit(float(states.index(moves.get(s, s)))) for s in states), *(F.lit(float(s not in moves)) for s in states))
    step = table({})
    for action, moves in allowed.items():
        step = F.when(F.col("action") == action, table(moves)).otherwise(step)
    done = folds.fold(events.withColumn("step", step), ["id"], ["at", "action"], folds.transitions)
    names = F.array(*map(F.lit, states))
    final = F.get(names, F.coalesce(F.col("step")[0], F.lit(0.0)).cast("int"))
    rejected = F.coalesce(F.col("step")[len(states)], F.lit(0.0)).cast("int")
    return rows.select("id").join(done, "id", "left").select("id", final.alias("status"), rejected.alias("rejected"))


ALERT_MOVES = {"approve": {"open": "approved"}, "dismiss": {"open": "dismissed"}, "edit": {"open": "open"}}
ANOMALY_MOVES = {"resolve": {"open": "resolved"}}
REGRESSION_MOVES = {"acknowledge": {"open": "acknowledged"}}
REPORT_MOVES = {"approve": {"draft": "approved", "pending_review": "approved"}, "submit": {"draft": "pending_review"}}
AUDIT_MOVES = {"reverse": {"open": "reversed"}}


def page(df: DataFrame, order: list[Column], number: int, size: int, filters: list[Column] = ()) -> DataFrame:
    """One page of the filtered rows in order, with the number of all of them in total_rows. The order ends in a unique column."""
    for f in filters:
        df = df.where(f)
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total_rows", total)


def patch(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the values of changes that aren't null."""
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return base.join(new, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns))


def delete_rows(base: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """base without the rows whose key gone has; a null key is never deleted."""
    return base.join(gone.select(key).distinct(), key, "left_anti")


def short(text: Column, n: int = 200) -> Column:
    return T.cut(text, n)


def regression_text(service: Column, kind: Column, delta: Column) -> Column:
    """The one-line explanation of a regression without a model; delta is a share."""
    return F.format_string("%s: %s — error rate increased %.1f%% post-deploy.", service, kind, F.round(delta * 100, 1))


def list_rows(df: DataFrame, order: list[Column], limit: int, **filters: object) -> DataFrame:
    """The first rows in order, filtered by those columns whose value is given."""
    for name, value in filters.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df.orderBy(*order).limit(limit)


def enrich_reports(reports: DataFrame, alerts: DataFrame, services: DataFrame) -> DataFrame:
    """reports (report_id, alert_id) with their alert's score and service's name; reports without either go."""
    joined = reports.join(alerts.select("alert_id", "service_id", "risk_score"), "alert_id", "left").join(services.select("service_id", "name"), "service_id", "left")
    return joined.where(F.col("risk_score").isNotNull() & F.col("name").isNotNull()).select("report_id", "alert_id", "name", "risk_score")


def draft_premortems(alerts: DataFrame) -> DataFrame:
    """A draft for each critical alert (id, service_name, risk_score, risk_tier, matched_pattern, autonomy_tier), unless its tier only observes."""
    own = alerts.where((F.col("risk_tier") == "critical") & (F.col("autonomy_tier") != "observe"))
    return own.select("id", F.lit("draft").alias("status"), premortem_text(F.col("service_name"), F.col("risk_score"), F.col("risk_tier"), F.col("matched_pattern")).alias("body"))
