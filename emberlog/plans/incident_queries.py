"""Queries over incidents, deployments, health, outcomes and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import incidents as I  # noqa: E741
from emberlog.operators.errors import dedup_groups
from emberlog.operators.signals import spikes
from emberlog.plans import domain as D
from emberlog.plans.analysis_queries import BASE, GROUPS, HOURS, SPIKES, STATS, L
from emberlog.sources.shared import fresh_path

QUERIES, SQL = {}, {}
START, END = "2024-01-10 00:00:00", "2024-01-12 00:00:00"
SERVICES = ["svc-1", "svc-2", "svc-3", "svc-4"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(x: str):
    return F.lit(x).cast("timestamp_ntz")


CAUSES = f"""tl AS (SELECT id, "timestamp", service_name AS service, severity, substr(coalesce(message, ''), 1, 300) AS message FROM logs WHERE severity IN ('ERROR', 'CRITICAL', 'FATAL', 'WARNING', 'WARN')
  AND service_name IN ('svc-1', 'svc-2', 'svc-3', 'svc-4') AND "timestamp" BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' ORDER BY "timestamp", id LIMIT 200)"""


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.timeline(D.logs(spark, sf_dir), SERVICES, _t(START), _t(END))


@query(f"WITH {L}, {CAUSES} SELECT * FROM tl")
def rca_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timeline(spark, sf_dir)


DEPS = """nn AS (SELECT service AS src, count(*) AS n FROM tl GROUP BY ALL), pp AS (SELECT a.src, b.src AS dst FROM nn a, nn b WHERE a.src <> b.src),
ff AS (SELECT pp.src, pp.dst, count(*) AS followed FROM pp JOIN tl a ON a.service = pp.src WHERE EXISTS (SELECT 1 FROM tl b WHERE b.service = pp.dst AND b."timestamp" > a."timestamp" AND b."timestamp" <= a."timestamp" + INTERVAL {lead} SECONDS) GROUP BY ALL),
deps AS (SELECT ff.src, dst, round(followed / n, 4) AS lead_ratio FROM ff JOIN nn ON ff.src = nn.src WHERE followed / n > {ratio})"""


CHAIN = """st AS (SELECT service, count(*) AS n, min("timestamp") AS first_ts, arg_min(severity, ("timestamp", id)) AS severity, arg_min(message, ("timestamp", id)) AS message FROM tl GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY "timestamp", id) AS r FROM tl), ids AS (SELECT service, string_agg(id::VARCHAR, ',' ORDER BY r) AS supporting FROM rk WHERE r <= 5 GROUP BY ALL),
im AS (SELECT src AS service, string_agg(DISTINCT dst, ', ' ORDER BY dst) AS impact FROM deps GROUP BY ALL), dn AS (SELECT DISTINCT dst AS service FROM deps)
SELECT row_number() OVER (ORDER BY dn.service IS NOT NULL, first_ts, st.service)::INT AS step, st.service, CASE WHEN n > 5 THEN 'error_spike' ELSE 'new_error' END AS event_type, first_ts,
n || ' ' || severity || ' event(s) starting at ' || strftime(first_ts, '%Y-%m-%dT%H:%M:%S') || '. First message: ' || substr(message, 1, 120) || CASE WHEN impact IS NOT NULL THEN ' [Downstream impact on: ' || impact || ']' ELSE '' END AS description,
supporting, CASE WHEN dn.service IS NULL THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM st JOIN ids ON st.service = ids.service LEFT JOIN im ON st.service = im.service LEFT JOIN dn ON st.service = dn.service"""


def _chain(events: DataFrame) -> DataFrame:
    c = I.causal_chain(events, I.dependencies(events, 1800, 0.45))
    return c.withColumn("supporting", F.array_join(F.transform("supporting_log_ids", lambda x: x.cast("string")), ",")).withColumn("confidence", F.col("confidence").cast("double")).drop("supporting_log_ids")


# Dependencies and the chain see the whole table: every service, no window, no limit.

ALL_CAUSES = """tl AS (SELECT id, "timestamp", service_name AS service, severity, substr(coalesce(message, ''), 1, 300) AS message FROM logs WHERE severity IN ('ERROR', 'CRITICAL', 'FATAL', 'WARNING', 'WARN'))"""
ALL_DEPS = """nn AS (SELECT service AS src, count(*) AS n FROM tl GROUP BY ALL), aa AS (SELECT a.service AS src, a."timestamp" AS t, d.src AS dst FROM tl a JOIN nn d ON a.service <> d.src),
ff AS (SELECT aa.src, aa.dst, count(*) AS followed FROM aa ASOF JOIN tl b ON b.service = aa.dst AND aa.t < b."timestamp" WHERE b."timestamp" <= aa.t + INTERVAL {lead} SECONDS GROUP BY ALL),
deps AS (SELECT ff.src, dst, round(followed / n, 4) AS lead_ratio FROM ff JOIN nn ON ff.src = nn.src WHERE followed / n > {ratio})"""


@query(f"WITH {L}, {ALL_CAUSES}, {ALL_DEPS.format(lead=1800, ratio=0.3)} SELECT * FROM deps")
def service_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With half an hour of lead and a ratio of 0.3, which these sparse events reach."""
    return I.dependencies(I.causes(D.logs(spark, sf_dir)), 1800, 0.3)


@query(f"WITH {L}, {ALL_CAUSES}, {ALL_DEPS.format(lead=1800, ratio=0.45)}, {CHAIN}")
def causal_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(I.causes(D.logs(spark, sf_dir)))


# --- deployments


@query(f"WITH {L}, {D.DEPLOYMENTS} SELECT id, version, lag(version) OVER w AS previous_version, lag(deployed_at) OVER w AS previous_at FROM deployments WINDOW w AS (PARTITION BY service_name ORDER BY deployed_at, id)")
def deploy_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.previous_deployments(D.deployments(spark, sf_dir)).select("id", "version", "previous_version", "previous_at")


@query(f"""{BASE}, {D.DEPLOYMENTS}, r AS (SELECT d.id, d.service_name, d.version, count(*) FILTER (WHERE e."timestamp" >= deployed_at - INTERVAL 6 HOURS AND e."timestamp" < deployed_at) AS b,
count(*) FILTER (WHERE e."timestamp" >= deployed_at AND e."timestamp" <= deployed_at + INTERVAL 6 HOURS) AS h FROM deployments d JOIN errs e ON d.service_name = e.service_name GROUP BY ALL),
q AS (SELECT *, round(b / 6, 4) AS baseline_rate, round(h / 6, 4) AS head_rate FROM r), f AS (SELECT *, (head_rate - baseline_rate) / baseline_rate AS d FROM q WHERE baseline_rate > 0 AND head_rate > 0)
SELECT id, baseline_rate, head_rate, round(d, 4) AS delta, round(least(d, 1), 4)::DOUBLE AS confidence FROM f WHERE d >= 0.5""")
def deploy_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = I.rate_regressions(D.logs(spark, sf_dir), D.deployments(spark, sf_dir), 6)
    return r.select("id", "baseline_rate", "head_rate", "delta", F.round("confidence", 4).alias("confidence"))


@query(f"{BASE}, {GROUPS}, {D.DEPLOYMENTS}, l AS (SELECT service_name, arg_max(version, deployed_at) AS version, max(deployed_at) AS deployed_at FROM deployments GROUP BY ALL) SELECT g.service_name, fingerprint, version, occurrence_count FROM groups g JOIN l ON g.service_name = l.service_name WHERE first_seen >= deployed_at")
def new_clusters_after_deploy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.new_groups_after(dedup_groups(D.logs(spark, sf_dir)), D.deployments(spark, sf_dir))


@query(f"""WITH {L}, c AS (SELECT service_name, severity, count(*) FILTER (WHERE deployment_version = 'v3') AS a, count(*) FILTER (WHERE deployment_version = 'v4') AS b FROM logs GROUP BY ALL)
SELECT service_name, severity, b AS n_before, a AS n_after, round(a / b, 4) AS factor FROM c WHERE a >= 2 * b AND a > 0 AND b > 0""")
def cluster_size_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by service and severity; the short week v4 stands for the time before."""
    own = D.logs(spark, sf_dir)
    size = lambda v: own.where(F.col("deployment_version") == v).groupBy("service_name", "severity").agg(F.count("*").alias("n"))
    return I.size_jumps(size("v4"), size("v3"), ["service_name", "severity"])


@query(f"""WITH {L}, {D.DEPLOYMENTS}, b AS (SELECT d.service_name, k, v FROM config c JOIN deployments d ON c.id = d.id WHERE d.version = 'v1'), h AS (SELECT d.service_name, k, v FROM config c JOIN deployments d ON c.id = d.id WHERE d.version = 'v2')
SELECT coalesce(b.service_name, h.service_name) AS service_name, coalesce(b.k, h.k) AS key, b.v AS base_value, h.v AS head_value FROM b FULL JOIN h ON b.service_name = h.service_name AND b.k = h.k WHERE b.v IS DISTINCT FROM h.v""")
def config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.config_diff(D.deployments(spark, sf_dir), "v1", "v2")


@query(f"""WITH {L}, {D.DEPLOYMENTS} SELECT b.service_name, b.version <> h.version AS version_changed, b.deployed_by <> h.deployed_by AS deployer_changed,
abs(epoch(date_trunc('second', h.deployed_at)) - epoch(date_trunc('second', b.deployed_at)))::BIGINT AS seconds_between FROM deployments b JOIN deployments h ON b.service_name = h.service_name WHERE b.version = 'v1' AND h.version = 'v2'""")
def snapshot_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.compare_snapshots(D.deployments(spark, sf_dir), "v1", "v2")


# --- health

TIERS = """rt AS (SELECT service_name AS service_id, CASE WHEN count(*) % 3 = 0 THEN 'critical' WHEN count(*) % 3 = 1 THEN 'warning' ELSE 'normal' END AS risk_tier FROM logs GROUP BY ALL),"""
STATES = """hs AS (SELECT s.service_id, s.name, coalesce(rt.risk_tier, 'normal') AS risk_tier, coalesce(an.n, 0) AS open_anomalies, coalesce(cl.n, 0) AS active_clusters,
  greatest(100 - CASE rt.risk_tier WHEN 'critical' THEN 50 WHEN 'warning' THEN 20 ELSE 0 END - least(5 * coalesce(an.n, 0), 30) - least(2 * coalesce(cl.n, 0), 20), 0)::DOUBLE AS health_score
  FROM services s LEFT JOIN rt ON s.service_id = rt.service_id LEFT JOIN an ON s.service_id = an.service_id LEFT JOIN cl ON s.service_id = cl.service_id WHERE s.is_active)"""


def _states(spark: SparkSession, sf_dir: str, anomalies: DataFrame, clusters: DataFrame) -> DataFrame:
    n = F.count("*") % 3
    risk = D.logs(spark, sf_dir).groupBy(F.col("service_name").alias("service_id")).agg(F.when(n == 0, "critical").when(n == 1, "warning").otherwise("normal").alias("risk_tier"))
    return I.health_states(D.services(spark, sf_dir).where("is_active"), risk, anomalies, clusters)


# From the detectors' results over all rows: spikes at 0.5 deviations, as in spike_zscore, and error groups.

HEALTH = f"""{BASE}, {GROUPS}, {HOURS}, {STATS}, {SPIKES}, {D.SERVICES}, {TIERS}
an AS (SELECT service_name AS service_id, count(*) AS n FROM z WHERE abs(observed - mean) / std >= 0.5 GROUP BY ALL),
cl AS (SELECT service_name AS service_id, count(*) AS n FROM groups GROUP BY ALL),
{STATES}"""


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.logs(spark, sf_dir)
    n = lambda df: df.groupBy(F.col("service_name").alias("service_id")).agg(F.count("*").alias("n"))
    return _states(spark, sf_dir, n(spikes(own, D.as_of(), 0.5)), n(dedup_groups(own)))


@query(f"{HEALTH} SELECT service_id, name, risk_tier, open_anomalies, active_clusters, health_score FROM hs ORDER BY health_score, service_id")
def health_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _health(spark, sf_dir).select("service_id", "name", "risk_tier", "open_anomalies", "active_clusters", "health_score").orderBy("health_score", "service_id")


@query(f"""{HEALTH} SELECT count(*) AS total_services, count(*) FILTER (WHERE health_score >= 80) AS healthy, count(*) FILTER (WHERE health_score >= 50 AND health_score < 80) AS warning, count(*) FILTER (WHERE health_score < 50) AS critical,
sum(open_anomalies)::BIGINT AS open_anomalies, sum(active_clusters)::BIGINT AS active_clusters, arg_min(name, (health_score, name)) AS worst_service FROM hs""")
def fleet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.fleet_summary(_health(spark, sf_dir))


@query(f"""{BASE}, {GROUPS}, r AS (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY occurrence_count DESC, fingerprint) AS n FROM groups)
SELECT service_name, string_agg(occurrence_count::VARCHAR, ',' ORDER BY n) AS counts, string_agg(substr(fingerprint, 1, 8), ',' ORDER BY n) AS prints FROM r WHERE n <= 5 GROUP BY service_name""")
def service_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest error groups of each service."""
    t = I.top_per_key(dedup_groups(D.logs(spark, sf_dir)), ["service_name"], [F.desc("occurrence_count"), F.asc("fingerprint")], 5, ["occurrence_count", "fingerprint"], "top")
    return t.select(
        "service_name", F.array_join(F.transform("top", lambda x: x["occurrence_count"].cast("string")), ",").alias("counts"), F.array_join(F.transform("top", lambda x: F.substring(x["fingerprint"], 1, 8)), ",").alias("prints")
    )


# --- outcomes, policies, state

FOLD = f"""{D.OUTCOMES}, o AS (SELECT indicator, verdict, CASE verdict WHEN 'true_positive' THEN 0.05 WHEN 'false_positive' THEN -0.05 ELSE -0.025 END::DOUBLE AS d, row_number() OVER (PARTITION BY indicator ORDER BY created_at, incident_id) AS n FROM outcomes WHERE verdict <> 'true_negative'),
l AS (SELECT indicator, list(d ORDER BY n) AS ds, count(*) FILTER (WHERE verdict = 'true_positive') AS tp, count(*) FILTER (WHERE verdict = 'false_positive') AS fp, count(*) FILTER (WHERE verdict = 'false_negative') AS fn FROM o GROUP BY indicator)"""


@query(f"WITH {FOLD} SELECT indicator, round(list_reduce(list_concat([1.0::DOUBLE], ds), lambda a, x: least(greatest(a + x, 0.1), 5.0)), 4)::DOUBLE AS weight, tp AS true_positives, fp AS false_positives, fn AS false_negatives, tp + fp + fn AS total_fired FROM l")
def feedback_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.feedback_weights(D.outcomes(spark, sf_dir)).drop("precision", "recall")


@query(f"WITH {FOLD} SELECT indicator, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall FROM l")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.feedback_weights(D.outcomes(spark, sf_dir)).select("indicator", "precision", "recall")


@query(f"""WITH {L}, {D.SERVICES}, rq AS (SELECT 'restart' AS tool_name, environment, service_id FROM services UNION ALL SELECT 'rollback', environment, service_id FROM services)
SELECT tool_name, environment, service_id, CASE WHEN tool_name = 'restart' AND service_id = 'svc-2' THEN 'auto' WHEN tool_name = 'restart' AND environment = 'prod' THEN 'observe' WHEN tool_name = 'rollback' AND service_id = 'svc-3' THEN 'propose' ELSE 'propose' END AS autonomy_tier FROM rq""")
def autonomy_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.services(spark, sf_dir).select("environment", "service_id")
    asks = s.withColumn("tool_name", F.explode(F.array(F.lit("restart"), F.lit("rollback"))))
    rows = [("restart", "prod", "svc-2", "auto"), ("restart", "prod", None, "observe"), ("rollback", "staging", "svc-3", "whatever")]
    policies = spark.createDataFrame(rows, "tool_name string, environment string, service_id string, autonomy_tier string")
    return I.resolve_autonomy(asks, policies).select("tool_name", "environment", "service_id", "autonomy_tier")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.read(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "signup", "approve").when(F.col("event_type") == "purchase", "dismiss").otherwise("edit")
    return e.select(F.col("user_id").alias("id"), F.col("ts").alias("at"), action.alias("action"))


@query("""WITH e AS (SELECT user_id AS id, ts, CASE event_type WHEN 'signup' THEN 'approve' WHEN 'purchase' THEN 'dismiss' ELSE 'edit' END AS action FROM events),
f AS (SELECT id, min(ts) FILTER (WHERE action <> 'edit') AS t, arg_min(action, (ts, action)) FILTER (WHERE action <> 'edit') AS a FROM e GROUP BY id)
SELECT f.id, CASE f.a WHEN 'approve' THEN 'approved' WHEN 'dismiss' THEN 'dismissed' ELSE 'open' END AS status, count(*) FILTER (WHERE e.ts > f.t)::INT AS rejected FROM f JOIN e ON e.id = f.id GROUP BY ALL""")
def alert_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert per user; the first approval or dismissal settles it and what follows is refused."""
    events = _events(spark, sf_dir)
    return I.replay_transitions(events.select("id").distinct(), events, I.ALERT_MOVES, "open")


@query("""SELECT user_id AS id, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'resolved' ELSE 'open' END AS status, greatest(count(*) FILTER (WHERE event_type = 'error') - 1, 0)::INT AS rejected FROM events GROUP BY user_id""")
def anomaly_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.read(spark, sf_dir, "events")
    events = e.where("event_type = 'error'").select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.lit("resolve").alias("action"))
    return I.replay_transitions(e.select(F.col("user_id").alias("id")).distinct(), events, I.ANOMALY_MOVES, "open")


# Of a settled row whatever comes later is refused.
_SETTLED = """WITH e AS (SELECT user_id AS id, ts, {action} AS action FROM events), f AS (SELECT id, min(ts) FILTER (WHERE action = '{last}') AS t FROM e GROUP BY id)
SELECT f.id, CASE WHEN f.t IS NULL THEN '{before}' ELSE '{after}' END AS status, count(*) FILTER (WHERE e.ts > f.t OR e.action = 'other')::INT AS rejected FROM f JOIN e ON e.id = f.id GROUP BY ALL"""


def _settled(spark: SparkSession, sf_dir: str, settles: str, action: str, moves: dict) -> DataFrame:
    """Events of a kind settle the row of their user, those of other kinds are no action at all."""
    e = D.read(spark, sf_dir, "events")
    events = e.select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.when(F.col("event_type") == settles, action).otherwise("other").alias("action"))
    return I.replay_transitions(events.select("id").distinct(), events, moves, "open")


@query(_SETTLED.format(action="CASE event_type WHEN 'purchase' THEN 'acknowledge' ELSE 'other' END", last="acknowledge", before="open", after="acknowledged").replace("e.ts > f.t OR", "e.ts > f.t AND e.action <> 'other' OR"))
def regression_acknowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settled(spark, sf_dir, "purchase", "acknowledge", I.REGRESSION_MOVES)


@query(_SETTLED.format(action="CASE event_type WHEN 'signup' THEN 'reverse' ELSE 'other' END", last="reverse", before="open", after="reversed").replace("e.ts > f.t OR", "e.ts > f.t AND e.action <> 'other' OR"))
def audit_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settled(spark, sf_dir, "signup", "reverse", I.AUDIT_MOVES)


@query("""WITH e AS (SELECT user_id AS id, ts, CASE event_type WHEN 'signup' THEN 'approve' ELSE 'submit' END AS action FROM events),
f AS (SELECT id, min(ts) FILTER (WHERE action = 'approve') AS a, min(ts) FILTER (WHERE action = 'submit') AS s FROM e GROUP BY id)
SELECT f.id, CASE WHEN a IS NOT NULL THEN 'approved' WHEN s IS NOT NULL THEN 'pending_review' ELSE 'draft' END AS status,
count(*) FILTER (WHERE e.ts > a OR (e.action = 'submit' AND e.ts > s AND (a IS NULL OR e.ts < a)))::INT AS rejected FROM f JOIN e ON e.id = f.id GROUP BY ALL""")
def report_approve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report per user: a draft, submitted once, approved once from either status."""
    e = D.read(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "signup", "approve").otherwise("submit")
    events = e.select(F.col("user_id").alias("id"), F.col("ts").alias("at"), action.alias("action"))
    return I.replay_transitions(events.select("id").distinct(), events, I.REPORT_MOVES, "draft")


@query(f"WITH {FOLD} SELECT indicator, round(list_reduce(list_concat([1.0::DOUBLE], ds), lambda a, x: least(greatest(a + x, 0.1), 5.0)), 4)::DOUBLE AS weight, tp + fp + fn AS total_fired FROM l")
def outcome_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes logged in three batches, one of them delivered twice: the weights that they lead to."""
    o, path = D.outcomes(spark, sf_dir), fresh_path(spark, "outcome-log")
    for k in (0, 1, 1, 2):
        weights = I.log_outcomes(o.where(F.col("incident_id") % 3 == k), path, f"batch {k}")
    return weights.select("indicator", "weight", "total_fired")


@query("SELECT event_id, ts, user_id, (SELECT count(*) FROM events WHERE event_type = 'error') AS total_rows FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return I.page(e, [F.desc("ts"), F.desc("event_id")], 3, 50, [F.col("event_type") == "error"]).drop("event_type")


@query(f"WITH {D.OUTCOMES} SELECT incident_id, verdict, created_at, (SELECT count(*) FROM outcomes WHERE verdict = 'false_positive') AS total_rows FROM outcomes WHERE verdict = 'false_positive' ORDER BY created_at DESC, incident_id LIMIT 20 OFFSET 20")
def outcomes_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.outcomes(spark, sf_dir).select("incident_id", "verdict", "created_at")
    return I.page(o, [F.desc("created_at"), F.asc("incident_id")], 2, 20, [F.col("verdict") == "false_positive"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'patched' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changes = o.where(F.col("o_orderkey") % 3 == 0).select("o_orderkey", F.lit("patched").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"))
    return I.patch(o, changes, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'")
def report_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return I.delete_rows(o, o.where("o_orderstatus = 'P'"), "o_orderkey").select("o_orderkey", "o_totalprice")


_N = "chr(10)"
_SECTIONS = " || chr(10) || ".join(
    f"'## {title}' || chr(10) || chr(10) || " + ("c_name" if key == "summary" else "'_Not available._'") + " || chr(10) || chr(10)" for key, title in I.REPORT_SECTIONS.items()
)


@query(f"""SELECT c_custkey, '# ' || c_name || {_N} || {_N} || '**Incident ID:** ' || c_custkey || '  ' || {_N} || '**Severity:** ' || upper(c_mktsegment) || '  ' || {_N} || '**Status:** draft  ' || {_N} || '**Started:** —  ' || {_N} || '**Resolved:** —  ' || {_N}
|| '**Affected services:** svc-1, svc-2  ' || {_N} || '**Generated:** 2024-01-31  ' || {_N} || {_N} || {_SECTIONS} AS markdown FROM customer""")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    report = {
        "title": F.col("c_name"), "incident_id": F.col("c_custkey").cast("string"), "severity": F.col("c_mktsegment"), "status": F.lit("draft"), "started_at": none,
        "resolved_at": none, "affected_services": F.lit("svc-1, svc-2"), "created_at": F.lit("2024-01-31"), **dict.fromkeys(I.REPORT_SECTIONS, none), "summary": F.col("c_name"),
    }
    return D.read(spark, sf_dir, "customer").select("c_custkey", I.report_markdown(report).alias("markdown"))


@query(f"""{BASE}, {D.DEPLOYMENTS}, r AS (SELECT d.id, d.service_name, count(*) FILTER (WHERE e."timestamp" >= deployed_at - INTERVAL 6 HOURS AND e."timestamp" < deployed_at) AS b,
count(*) FILTER (WHERE e."timestamp" >= deployed_at AND e."timestamp" <= deployed_at + INTERVAL 6 HOURS) AS h FROM deployments d JOIN errs e ON d.service_name = e.service_name GROUP BY ALL),
f AS (SELECT id, service_name, round((round(h / 6, 4) - round(b / 6, 4)) / round(b / 6, 4), 4) AS d FROM r WHERE b > 0 AND h > 0)
SELECT id, service_name || ': error_rate_increase — error rate increased ' || printf('%.1f', round(d * 100, 1)) || '% post-deploy.' AS explanation FROM f WHERE d >= 0.5""")
def regression_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = I.rate_regressions(D.logs(spark, sf_dir), D.deployments(spark, sf_dir), 6)
    return r.select("id", I.regression_text(F.col("service_name"), F.lit("error_rate_increase"), F.col("delta")).alias("explanation"))


@query(f"""WITH {L} SELECT id, "timestamp", severity, service_name FROM logs WHERE severity = 'CRITICAL' AND environment = 'prod' ORDER BY "timestamp" DESC, id DESC LIMIT 100""")
def filtered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional filters apply only where a value is given."""
    rows = I.list_rows(D.logs(spark, sf_dir), [F.desc("timestamp"), F.desc("id")], 100, severity="CRITICAL", service_name=None, environment="prod")
    return rows.select("id", "timestamp", "severity", "service_name")


@query(f"""WITH {L}, {D.SERVICES}, al AS (SELECT id AS alert_id, service_name AS service_id, duration_ms AS risk_score FROM logs)
SELECT o_orderkey AS report_id, al.alert_id, name, risk_score FROM orders JOIN al ON o_orderkey = al.alert_id JOIN services s ON s.service_id = al.service_id""")
def report_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record as an alert."""
    return _enriched(spark, sf_dir, D.logs(spark, sf_dir))


def _enriched(spark: SparkSession, sf_dir: str, logs: DataFrame) -> DataFrame:
    alerts = logs.select(F.col("id").alias("alert_id"), F.col("service_name").alias("service_id"), F.col("duration_ms").alias("risk_score"))
    reports = D.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_orderkey").alias("alert_id"))
    return I.enrich_reports(reports, alerts, D.services(spark, sf_dir))


@query(f"""WITH {L} SELECT service_name, count(DISTINCT severity) AS severities, list_aggregate(list_sort(list(DISTINCT environment)), 'string_agg', ',') AS environments FROM logs GROUP BY service_name""")
def affected_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.logs(spark, sf_dir).groupBy("service_name").agg(
        F.countDistinct("severity").alias("severities"), F.array_join(F.array_sort(F.collect_set("environment")), ",").alias("environments")
    )


@query(f"""WITH {L} SELECT id, extra_fields FROM logs WHERE CAST(json_extract_string(extra_fields, '$.k') AS INT) = 42 AND hour("timestamp") = 7 AND isodow("timestamp") <= 5""")
def json_and_time_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.logs(spark, sf_dir).where((F.get_json_object("extra_fields", "$.k").cast("int") == 42) & (F.hour("timestamp") == 7) & (F.weekday("timestamp") <= 4))
    return own.select("id", "extra_fields")
