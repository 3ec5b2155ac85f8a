"""Queries over records: groups, clusters, anomalies, risk, incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import vectors as V
from emberlog.functions.providers import with_completion
from emberlog.operators import errors as E
from emberlog.operators import incidents as I  # noqa: E741
from emberlog.operators import parsing as P
from emberlog.operators import rollups as R
from emberlog.operators import signals as S
from emberlog.plans import domain as D
from emberlog.plans.log_queries import NORMAL
from emberlog.sources.shared import fresh_path, stored

L, AT = D.LOGS, f"TIMESTAMP '{D.AS_OF}'"
ERR = "errs AS (SELECT * FROM logs WHERE severity IN ('ERROR', 'CRITICAL', 'FATAL'))"
BASE = f"WITH {L}, {ERR}"
EPS, FIRST_EPS, KNN = 0.78, 0.70, 0.20
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def cos(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


# --- groups and clusters

GROUPS = f"""groups AS (SELECT service_name, sha256({NORMAL}) AS fingerprint, count(*) AS occurrence_count, min("timestamp") AS first_seen, max("timestamp") AS last_seen,
  arg_max(message, ("timestamp", id)) AS canonical_message, arg_max(severity, ("timestamp", id)) AS severity, list_sort(list(DISTINCT id)) AS ids FROM errs GROUP BY ALL)"""


@query(f"{BASE}, {GROUPS} SELECT service_name, fingerprint, occurrence_count, first_seen, last_seen, canonical_message, severity, array_to_string(ids, ',') AS ids FROM groups")
def dedup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = E.dedup_groups(D.logs(spark, sf_dir), with_ids=True)
    return g.select("service_name", "fingerprint", "occurrence_count", "first_seen", "last_seen", "canonical_message", "severity", F.array_join("source_record_ids", ",").alias("ids"))


@query(f"{BASE}, {GROUPS} SELECT service_name, fingerprint, occurrence_count FROM groups ORDER BY occurrence_count DESC, service_name, fingerprint LIMIT 200")
def dedup_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = E.dedup_groups(D.logs(spark, sf_dir)).select("service_name", "fingerprint", "occurrence_count")
    return g.orderBy(F.desc("occurrence_count"), "service_name", "fingerprint").limit(200)


@query(f"""{BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY "timestamp" DESC, id DESC) AS n FROM errs WHERE "timestamp" BETWEEN {AT} - INTERVAL 7 DAYS AND {AT}),
g AS (SELECT service_name, sha256({NORMAL}) AS fp, count(*) AS n FROM r WHERE n <= 1000 GROUP BY ALL),
k AS (SELECT DISTINCT service_name, sha256({NORMAL}) AS fp FROM errs WHERE "timestamp" < {AT} - INTERVAL 7 DAYS)
SELECT g.service_name, sum(n)::BIGINT AS processed, count(*) FILTER (WHERE k.fp IS NULL) AS new_groups, sum(CASE WHEN k.fp IS NULL THEN n - 1 ELSE n END)::BIGINT AS merged
FROM g LEFT JOIN k ON g.service_name = k.service_name AND g.fp = k.fp GROUP BY g.service_name""")
def dedup_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.logs(spark, sf_dir)
    before = own.where(F.col("timestamp") < D.as_of() - F.expr("INTERVAL 7 DAYS"))
    return E.dedup_pass(own, E.dedup_groups(before), D.as_of(), minutes=7 * 24 * 60)


@query(f"{BASE}, {GROUPS} SELECT service_name, fingerprint, occurrence_count, first_seen, last_seen FROM groups")
def dedup_recounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors in three batches that overlap, one of them delivered twice: each record counts once."""
    own, path = D.logs(spark, sf_dir), fresh_path(spark, "members")
    for batch, some in (("a", F.col("id") % 3 < 2), ("b", F.col("id") % 3 > 0), ("a", F.col("id") % 3 < 2), ("c", F.col("id") % 2 == 0)):
        groups = E.count_batch(own.where(some), path, batch)
    return groups


PAIRS = f"""pairs AS (SELECT a.service_id, a.id AS src, b.id AS dst, 1 - {cos('a.embedding', 'b.embedding')} AS d FROM vectors a JOIN vectors b ON a.service_id = b.service_id AND a.id < b.id)"""


@query(f"WITH {D.VECTORS}, {PAIRS} SELECT src, dst FROM pairs WHERE d <= {EPS} UNION ALL SELECT dst, src FROM pairs WHERE d <= {EPS}")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pairs_within(D.indicator_vectors(spark, sf_dir), "service_id", EPS)


DBSCAN = f"""{D.VECTORS}, {PAIRS}, e AS (SELECT service_id, src, dst FROM pairs WHERE d <= {EPS} UNION ALL SELECT service_id, dst, src FROM pairs WHERE d <= {EPS}),
cores AS (SELECT service_id, src AS id FROM e GROUP BY ALL HAVING count(*) >= 2),
ce AS (SELECT e.* FROM e JOIN cores a ON e.src = a.id JOIN cores b ON e.dst = b.id),
reach(id, r) AS (SELECT id, id FROM cores UNION SELECT ce.dst, reach.r FROM reach JOIN ce ON reach.id = ce.src),
roots AS (SELECT id, min(r) AS root FROM reach GROUP BY id),
named AS (SELECT v.service_id, roots.id, dense_rank() OVER (PARTITION BY v.service_id ORDER BY root) - 1 AS label FROM roots JOIN vectors v ON v.id = roots.id),
border AS (SELECT e.src AS id, min(named.label) AS label FROM e JOIN named ON e.dst = named.id GROUP BY e.src),
labels AS (SELECT v.service_id, v.id, coalesce(named.label, border.label, -1)::INT AS label, v.embedding FROM vectors v LEFT JOIN named ON v.id = named.id LEFT JOIN border ON v.id = border.id)"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.dbscan(D.indicator_vectors(spark, sf_dir), eps=EPS)


@query(f"WITH RECURSIVE {DBSCAN} SELECT service_id, id, label FROM labels")
def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir)


CENTRE = """parts AS (SELECT service_id, label, u.i AS i, avg(u.x) AS m FROM (SELECT service_id, label, unnest([{'i': k, 'x': embedding[k]} FOR k IN range(1, len(embedding) + 1)]) AS u FROM labels WHERE label >= 0) GROUP BY ALL),
centre AS (SELECT service_id, label, list(round(m, 6) ORDER BY i) AS c FROM parts GROUP BY ALL)"""
CLUSTERS = f"""{CENTRE}, clusters AS (SELECT l.service_id, l.label, count(*) AS member_count, round(avg({cos('l.embedding', 'c.c')}), 4) AS confidence_score FROM labels l JOIN centre c ON l.service_id = c.service_id AND l.label = c.label GROUP BY ALL)"""


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = D.indicator_vectors(spark, sf_dir).select("id", "embedding")
    return E.cluster_summary(_labels(spark, sf_dir).join(vectors, "id"))


@query(f"WITH RECURSIVE {DBSCAN}, {CLUSTERS} SELECT service_id, label, member_count, confidence_score FROM clusters")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir).select("service_id", "label", "member_count", "confidence_score")


@query(f"WITH RECURSIVE {DBSCAN}, {CLUSTERS} SELECT service_id, label, member_count FROM clusters ORDER BY member_count DESC, service_id, label LIMIT 100")
def cluster_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir).select("service_id", "label", "member_count").orderBy(F.desc("member_count"), "service_id", "label").limit(100)


@query(f"""WITH RECURSIVE {DBSCAN}, {CLUSTERS}, p AS (SELECT service_id, count(*) AS processed, count(*) FILTER (WHERE label < 0) AS noise FROM labels GROUP BY ALL),
g AS (SELECT service_id, count(*) AS clusters, avg(confidence_score) AS s FROM clusters GROUP BY ALL)
SELECT p.service_id, processed, coalesce(clusters, 0) AS clusters, noise, round(coalesce(s, 0), 3) AS silhouette FROM p LEFT JOIN g ON p.service_id = g.service_id""")
def cluster_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = D.indicator_vectors(spark, sf_dir)
    labels = stored(E.dbscan(vectors, eps=EPS), "pass")  # counted and summed up, but found once
    clusters = E.cluster_summary(labels.join(vectors.select("id", "embedding"), "id"))
    return E.cluster_pass_summary(labels, clusters).withColumn("silhouette", F.round("silhouette", 3))


@query(f"""WITH RECURSIVE {DBSCAN}, m AS (SELECT service_id, max(id) - 20 AS since FROM vectors GROUP BY ALL),
c AS (SELECT l.service_id, label, count(*) FILTER (WHERE id < since) AS n_before, count(*) AS n_after FROM labels l JOIN m ON l.service_id = m.service_id WHERE label >= 0 GROUP BY ALL)
SELECT *, round(n_after / n_before, 4) AS factor FROM c WHERE n_before > 0 AND n_after >= 1.02 * n_before""")
def cluster_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters that grew by a fiftieth since the deployment of their service, for which an id stands."""
    labels = _labels(spark, sf_dir).withColumn("at", F.col("id"))
    deployed = D.indicator_vectors(spark, sf_dir).groupBy("service_id").agg((F.max("id") - 20).alias("at"))
    return I.cluster_growth(labels, deployed, ["service_id", "label"], 1.02)


def _counted(eps: float) -> str:
    own = DBSCAN.replace(f"d <= {EPS}", f"d <= {eps}")
    return f"(WITH RECURSIVE {own} SELECT service_id, label, count(*) AS n FROM labels WHERE label >= 0 GROUP BY ALL)"


@query(f"""WITH a AS {_counted(FIRST_EPS)}, b AS {_counted(EPS)} SELECT coalesce(b.service_id, a.service_id) AS service_id, coalesce(b.label, a.label) AS label,
coalesce(b.n, a.n)::BIGINT AS member_count, b.label IS NOT NULL AS is_active FROM a FULL JOIN b ON a.service_id = b.service_id AND a.label = b.label""")
def cluster_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of all vectors in a pass with a small radius, and then those of a pass with the usual one: some are new, some gone."""
    vectors = D.indicator_vectors(spark, sf_dir)
    before, after = (
        E.dbscan(vectors, eps=eps).where("label >= 0").groupBy("service_id", "label").agg(F.count("*").alias("member_count")) for eps in (FIRST_EPS, EPS)
    )
    return E.merge_clusters(before, after)


@query("""SELECT label, array_to_string(list(round(m, 4)::DECIMAL(18,4) ORDER BY i), ',') AS centroid FROM (SELECT label, u.i AS i, avg(u.x) AS m FROM
(SELECT label, unnest([{'i': k, 'x': embedding[k]::DOUBLE} FOR k IN range(1, len(embedding) + 1)]) AS u FROM embeddings) GROUP BY ALL) GROUP BY label""")
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.centroids(D.read(spark, sf_dir, "embeddings"), ["label"], "embedding", None)
    return c.select("label", F.array_join(F.transform("centroid", lambda x: F.round(x, 4).cast("decimal(18,4)").cast("string")), ",").alias("centroid"))


@query("""WITH p AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS a, lag([x::DOUBLE FOR x IN embedding]) OVER (ORDER BY vec_id) AS b FROM embeddings)
SELECT vec_id, round(list_sum([round(0.9 * b[i] + 0.1 * a[i], 6) FOR i IN range(1, 65)]), 4) AS total FROM p WHERE b IS NOT NULL""")
def ema_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = D.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    before = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("b"))
    moved = v.join(before, "vec_id").withColumn("m", V.ema(F.col("b"), F.col("embedding")))
    return moved.select("vec_id", F.round(F.aggregate("m", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query()
def stub_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.stub_embeddings(D.read(spark, sf_dir, "benchmark").select("item_id", "text"), "text").select("item_id", "embedding")


@query("SELECT item_id, 'stub ' || substr(md5(text), 1, 8) AS completion, len([x FOR x IN regexp_split_to_array(text, '\\s+') IF x <> ''])::INT AS tokens FROM benchmark")
def stub_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stub provider's answers to whole texts, and the words that a prompt has."""
    own = with_completion(D.read(spark, sf_dir, "benchmark").select("item_id", "text"), F.col("text"), F.lit(None).cast("string"))
    words = F.array_remove(F.split("text", r"\s+"), "")
    return own.select("item_id", "completion", F.size(words).alias("tokens"))


# --- baselines and anomalies

HOURS = f"""hours AS (SELECT service_name, date_trunc('hour', "timestamp") AS hour, count(*) AS n FROM errs WHERE "timestamp" >= {AT} - INTERVAL 14 DAYS AND "timestamp" < {AT} - INTERVAL 1 HOUR GROUP BY ALL)"""
STATS = """base AS (SELECT service_name, count(*) AS samples, CASE WHEN count(*) < 3 THEN 0.0 ELSE avg(n) END AS mean, CASE WHEN count(*) < 3 THEN 1.0 ELSE coalesce(nullif(stddev_pop(n), 0), 1.0) END AS std FROM hours GROUP BY ALL)"""


@query(f"{BASE}, {HOURS} SELECT * FROM hours")
def hourly_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hourly_counts(D.logs(spark, sf_dir), D.as_of())


@query(f"{BASE}, {HOURS}, {STATS} SELECT service_name, samples, round(mean, 6) AS mean, round(std, 6) AS std FROM base")
def baseline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.baseline(S.hourly_counts(D.logs(spark, sf_dir), D.as_of()), ["service_name"])
    return b.select("service_name", "samples", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"""{BASE}, {HOURS}, spine AS (SELECT DISTINCT service_name, h.hour FROM logs, (SELECT unnest(generate_series({AT} - INTERVAL 14 DAYS, {AT} - INTERVAL 2 HOURS, INTERVAL 1 HOUR)) AS hour) h),
f AS (SELECT s.service_name, s.hour, coalesce(n, 0) AS n FROM spine s LEFT JOIN hours h ON s.service_name = h.service_name AND s.hour = h.hour)
SELECT service_name, count(*) AS samples, round(avg(n), 6) AS mean, round(coalesce(nullif(stddev_pop(n), 0), 1.0), 6) AS std FROM f GROUP BY ALL""")
def baseline_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.logs(spark, sf_dir)
    b = S.baseline(S.zero_filled(S.hourly_counts(own, D.as_of()), own, D.as_of()), ["service_name"])
    return b.select("service_name", "samples", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _kept(spark: SparkSession, sf_dir: str) -> str:
    """Minute counts of all records, which came in four batches, one of them twice."""
    own, path = D.logs(spark, sf_dir), fresh_path(spark, "minutes")
    for k in (0, 1, 1, 2, 3):
        R.add(own.where(F.col("id") % 4 == k), path, f"batch {k}")
    return path


@query(f"{BASE}, {HOURS}, {STATS} SELECT service_name, samples, round(mean, 6) AS mean, round(std, 6) AS std FROM base")
def baseline_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """baseline_stats without a second look at records."""
    b = R.baselines(spark, _kept(spark, sf_dir), D.as_of())
    return b.select("service_name", "samples", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


SPIKES = f"""now_ AS (SELECT service_name, count(*) AS observed FROM errs WHERE "timestamp" >= {AT} - INTERVAL 1 HOUR AND "timestamp" <= {AT} GROUP BY ALL),
z AS (SELECT coalesce(b.service_name, n.service_name) AS service_name, coalesce(observed, 0)::DOUBLE AS observed, coalesce(mean, 0.0) AS mean, coalesce(std, 1.0) AS std FROM base b FULL JOIN now_ n ON b.service_name = n.service_name)"""


@query(f"{BASE}, {HOURS}, {STATS}, {SPIKES} SELECT service_name, observed, round(abs(observed - mean) / std, 6) AS z, CASE WHEN abs(observed - mean) / std > 6 THEN 'critical' ELSE 'warning' END AS severity FROM z WHERE abs(observed - mean) / std >= 0.5")
def spike_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At 0.5 deviations, so that even services: test data have rows."""
    return S.spikes(D.logs(spark, sf_dir), D.as_of(), 0.5).select("service_name", "observed", F.round("z", 6).alias("z"), "severity")


@query(f"""{BASE}, {GROUPS}, flagged AS (SELECT DISTINCT service_name, fingerprint FROM groups WHERE service_name = 'svc-3')
SELECT service_name, fingerprint FROM groups WHERE occurrence_count = 1 AND first_seen >= {AT} - INTERVAL 20 DAYS AND service_name <> 'svc-3'""")
def new_error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = E.dedup_groups(D.logs(spark, sf_dir))
    flagged = g.where("service_name = 'svc-3'").select("service_name", "fingerprint")
    return S.new_error_types(g, flagged, D.as_of(), 20 * 24 * 60).select("service_name", "fingerprint")


SILENT = f"""s AS (SELECT service_name, count(*) FILTER (WHERE "timestamp" >= {AT} - INTERVAL 120 MINUTES) AS recent, count(*) FILTER (WHERE "timestamp" < {AT} - INTERVAL 120 MINUTES) AS history
  FROM logs WHERE "timestamp" BETWEEN {AT} - INTERVAL 7 DAYS AND {AT} GROUP BY ALL)"""


@query(f"WITH {L}, {SILENT} SELECT service_name, recent, history FROM s WHERE recent = 0 AND history >= 10 AND service_name <> 'svc-1'")
def service_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("svc-1",)], "service_name string")
    return S.silences(D.logs(spark, sf_dir), known, D.as_of(), 120)


@query(f"""{BASE}, {HOURS}, {STATS}, {SPIKES}, {SILENT}, x AS (SELECT service_name, 'spike' AS kind FROM z WHERE abs(observed - mean) / std >= 0.5 UNION ALL SELECT service_name, 'service_silence' FROM s WHERE recent = 0 AND history >= 10)
SELECT service_name, kind, CASE kind WHEN 'service_silence' THEN '🔇 ' || service_name || ' has gone unexpectedly silent — no log records in the last 120 minutes. The service may be down, unresponsive, or its log pipeline may be broken.' ELSE 'spike' END AS explanation FROM x""")
def anomaly_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors' events in one feed; sentences of silences, names of spikes."""
    own = D.logs(spark, sf_dir)
    spikes = S.spikes(own, D.as_of(), 0.5).select("service_name", F.lit("spike").alias("kind"))
    none = spark.createDataFrame([], "service_name string")
    silent = S.silences(own, none, D.as_of(), 120).select("service_name", F.lit("service_silence").alias("kind"))
    context = F.struct(F.lit(120).alias("minutes"), *(F.lit(0.0).alias(c) for c in ("observed", "z", "mean", "std", "drift")), *(F.lit("").alias(c) for c in ("message", "label")))
    sentence = S.explain(F.col("kind"), F.col("service_name"), context)
    return spikes.unionByName(silent).select("service_name", "kind", F.when(F.col("kind") == "spike", "spike").otherwise(sentence).alias("explanation"))


# --- velocity, risk

WINDOWS = """c AS (SELECT service_name, severity, time_bucket(INTERVAL 1 MINUTE, "timestamp") AS window_start, count(*) AS error_count FROM errs GROUP BY ALL),
w AS (SELECT *, coalesce(error_count - lag(error_count, 1) OVER q, 0) AS first_derivative, coalesce(error_count - 2 * lag(error_count, 1) OVER q + lag(error_count, 2) OVER q, 0) AS second_derivative FROM c WINDOW q AS (PARTITION BY service_name, severity ORDER BY window_start))"""
VSCORE = "round(least(30 * least(greatest(error_count, 0) / 500.0, 1) + 30 * least(greatest(first_derivative, 0) / 50.0, 1) + 40 * least(greatest(second_derivative, 0) / 25.0, 1), 100), 2)::DOUBLE"


@query(f"{BASE}, {WINDOWS} SELECT * FROM w")
def velocity_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.velocity_windows(D.logs(spark, sf_dir))


@query(f"{BASE}, {WINDOWS} SELECT service_name, severity, window_start, {VSCORE} AS velocity_score FROM w")
def velocity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.velocity_windows(D.logs(spark, sf_dir))
    return w.select("service_name", "severity", "window_start", S.velocity_score(F.col("error_count"), F.col("first_derivative"), F.col("second_derivative")).alias("velocity_score"))


@query(f"{BASE}, {WINDOWS}, r AS (SELECT *, row_number() OVER (PARTITION BY service_name, severity ORDER BY window_start DESC) AS n FROM w) SELECT service_name, severity, window_start, error_count FROM r WHERE n = 1")
def window_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.velocity_windows(D.logs(spark, sf_dir))
    return P.latest_per_key(w, ["service_name", "severity"], [F.desc("window_start")]).select("service_name", "severity", "window_start", "error_count")


BSCORE = f"""o AS (SELECT *, hour(window_start) AS h, isodow(window_start) AS d, max(window_start) OVER (PARTITION BY service_name, severity) AS last FROM w WHERE window_start >= {AT} - INTERVAL 28 DAYS AND window_start < {AT}),
hb AS (SELECT service_name, severity, h, d, CASE WHEN count(*) < 3 THEN 0.0 ELSE avg(error_count) END AS mean, CASE WHEN count(*) < 3 THEN 1.0 ELSE coalesce(nullif(stddev_pop(error_count), 0), 1.0) END AS std FROM o WHERE window_start < last GROUP BY ALL),
bs AS (SELECT o.service_name, o.severity, o.window_start, error_count, coalesce(mean, 0.0) AS mean, coalesce(std, 1.0) AS std, round(least(abs(error_count - coalesce(mean, 0.0)) / coalesce(std, 1.0) / 3.0 * 100, 100), 2)::DOUBLE AS baseline_score
  FROM o LEFT JOIN hb ON o.service_name = hb.service_name AND o.severity = hb.severity AND o.h = hb.h AND o.d = hb.d WHERE o.window_start = o.last)"""


@query(f"{BASE}, {WINDOWS}, {BSCORE} SELECT service_name, severity, window_start, error_count, round(mean, 6) AS mean, round(std, 6) AS std, baseline_score FROM bs")
def baseline_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.baseline_scores(S.velocity_windows(D.logs(spark, sf_dir)), D.as_of())
    return b.select("service_name", "severity", "window_start", "error_count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "baseline_score")


@query(f"{BASE}, {WINDOWS}, {BSCORE} SELECT service_name, severity, window_start, error_count, round(mean, 6) AS mean, round(std, 6) AS std, baseline_score FROM bs")
def baseline_score_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """baseline_score without a second look at records."""
    b = R.baseline_scores(spark, _kept(spark, sf_dir), D.as_of())
    return b.select("service_name", "severity", "window_start", "error_count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "baseline_score")


DRIFT = f"""rv AS (SELECT *, row_number() OVER (PARTITION BY service_id ORDER BY id DESC) AS n FROM vectors),
dp AS (SELECT service_id, n <= 20 AS new, u.i AS i, avg(u.x) AS m FROM (SELECT service_id, n, unnest([{{'i': k, 'x': embedding[k]}} FOR k IN range(1, len(embedding) + 1)]) AS u FROM rv WHERE n <= 120) GROUP BY ALL),
dm AS (SELECT service_id, list(m ORDER BY i) FILTER (WHERE new) AS a, list(m ORDER BY i) FILTER (WHERE NOT new) AS b FROM dp GROUP BY ALL),
drift AS (SELECT service_id, round(coalesce(least(greatest((1 - {cos('a', 'b')}) * 100, 0), 100), 0), 2)::DOUBLE AS drift_score FROM dm)"""


@query(f"WITH {D.VECTORS}, {DRIFT} SELECT * FROM drift")
def drift_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drift_scores(D.indicator_vectors(spark, sf_dir))


@query(f"WITH {D.VECTORS}, {DRIFT} SELECT service_id, drift_score FROM drift WHERE drift_score >= 30")
def cluster_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drift_scores(D.indicator_vectors(spark, sf_dir)).where("drift_score >= 30")


def knn_sql(threshold: float, where: str = "a.id % 50 = 0") -> str:
    return f"""nn AS (SELECT a.id AS query_id, a.service_id, b.id, b.label, b.alert_id, {cos('a.embedding', 'b.embedding')} AS s FROM vectors a JOIN vectors b ON a.service_id = b.service_id AND a.id <> b.id WHERE {where}),
nk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS n FROM nn),
nm AS (SELECT query_id, round(least((avg(s) - {threshold}) / {1 - threshold} * 100, 100), 2)::DOUBLE AS score, arg_max(label, (s, -id)) AS matched_pattern, round(max(s), 4) AS confidence,
  array_to_string(list_sort(list(DISTINCT alert_id) FILTER (WHERE alert_id IS NOT NULL)), ',') AS alerts, count(*) AS matches FROM nk WHERE n <= 5 AND s >= {threshold} GROUP BY ALL)"""


@query(f"""WITH {D.VECTORS}, {knn_sql(KNN)} SELECT a.id AS query_id, a.service_id, coalesce(score, 0) AS similarity_score, matched_pattern, coalesce(confidence, 0) AS confidence, coalesce(alerts, '') AS alerts, coalesce(matches, 0) AS matches
FROM vectors a LEFT JOIN nm ON a.id = nm.query_id WHERE a.id % 50 = 0""")
def knn_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 50 against all vectors of its service, at a similarity that these vectors reach."""
    v = D.indicator_vectors(spark, sf_dir)
    m = S.match_patterns(v.where(F.col("id") % 50 == 0), v, threshold=KNN)
    return m.withColumn("alerts", F.array_join("alert_ids", ",")).drop("alert_ids")


RISK = f"""{D.VECTORS}, {WINDOWS}, {BSCORE}, {DRIFT}, lw AS (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY window_start DESC) AS n FROM w WHERE severity = 'ERROR'),
vs AS (SELECT service_name, {VSCORE} AS velocity_score FROM lw WHERE n = 1), newest AS (SELECT max(id) AS m FROM vectors GROUP BY service_id), {knn_sql(0.75, 'a.id IN (SELECT m FROM newest)')},
ms AS (SELECT v.service_id, coalesce(nm.score, 0) AS similarity_score FROM newest JOIN vectors v ON v.id = newest.m LEFT JOIN nm ON nm.query_id = v.id),
rs AS (SELECT vs.service_name, velocity_score, coalesce(ms.similarity_score, drift_score, 0)::DOUBLE AS similarity_score, coalesce(bs.baseline_score, 0)::DOUBLE AS baseline_score
  FROM vs LEFT JOIN bs ON vs.service_name = bs.service_name AND bs.severity = 'ERROR' LEFT JOIN ms ON ms.service_id = vs.service_name LEFT JOIN drift ON drift.service_id = vs.service_name),
risk AS (SELECT *, round(least(greatest(velocity_score * 0.30 + similarity_score * 0.40 + baseline_score * 0.30, 0), 100), 2)::DOUBLE AS risk_score FROM rs),
tiers AS (SELECT *, CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'warning' ELSE 'normal' END AS risk_tier FROM risk)"""


@query(f"{BASE}, {RISK} SELECT service_name, velocity_score, similarity_score, baseline_score, risk_score, risk_tier FROM tiers")
def risk_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = S.risk_cycle(D.logs(spark, sf_dir), D.indicator_vectors(spark, sf_dir), D.as_of())
    return r.select("service_name", "velocity_score", "similarity_score", "baseline_score", "risk_score", "risk_tier")


@query("""SELECT event_id, round(least(greatest(floor(least(value, 100))::DECIMAL(18, 4) * 0.3 + (event_id % 101) * 0.4 + (user_id % 101) * 0.3, 0), 100), 2)::DOUBLE AS risk_score FROM events""")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.read(spark, sf_dir, "events")
    score = S.risk_score(F.floor(F.least("value", F.lit(100))), F.col("event_id") % 101, F.col("user_id") % 101)
    return e.select("event_id", score.alias("risk_score"))


SNAP = """snaps AS (SELECT event_id AS id, 'svc-' || (user_id % 10) AS service_name, ts AS evaluated_at, round(least(value, 100), 2) AS risk_score FROM events)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("svc-"), F.col("user_id") % 10).alias("service_name"), F.col("ts").alias("evaluated_at"), F.round(F.least("value", F.lit(100.0)), 2).alias("risk_score")
    )


@query(f"WITH {SNAP}, r AS (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY evaluated_at DESC, id DESC) AS n FROM snaps) SELECT service_name, evaluated_at, risk_score FROM r WHERE n = 1")
def risk_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.latest_per_key(_snapshots(spark, sf_dir), ["service_name"], [F.desc("evaluated_at"), F.desc("id")])
    return s.select("service_name", "evaluated_at", "risk_score")


@query(f"WITH {SNAP} SELECT * FROM snaps WHERE service_name = 'svc-2' ORDER BY evaluated_at DESC, id DESC LIMIT 500")
def risk_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(spark, sf_dir).where("service_name = 'svc-2'").orderBy(F.desc("evaluated_at"), F.desc("id")).limit(500)


@query(f"WITH {SNAP} SELECT id, risk_score, CASE WHEN risk_score >= 80 THEN 'critical' ELSE 'warning' END AS tier, CASE WHEN risk_score >= 80 THEN 'Page on-call SRE immediately' ELSE 'Monitor error rate closely for the next 10 minutes' END AS first_action, CASE WHEN risk_score >= 80 THEN 4 ELSE 3 END AS actions FROM snaps WHERE risk_score >= 60 ORDER BY evaluated_at DESC, id DESC LIMIT 200")
def alerts_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest open alerts with what to do."""
    s = _snapshots(spark, sf_dir).where("risk_score >= 60").orderBy(F.desc("evaluated_at"), F.desc("id")).limit(200)
    tier = S.risk_tier(F.col("risk_score"))
    actions = S.recommended_actions(tier)
    return s.select("id", "risk_score", tier.alias("tier"), F.get(actions, F.lit(0))["action"].alias("first_action"), F.size(actions).alias("actions"))


@query(f"""WITH {SNAP}, actions AS (SELECT 'critical' AS tier, * FROM (VALUES (1, 'Page on-call SRE immediately'), (2, 'Review error logs for the last 15 minutes'), (3, 'Check recent deployments for this service'), (4, 'Prepare rollback plan')) t(priority, action)
UNION ALL SELECT 'warning', * FROM (VALUES (1, 'Monitor error rate closely for the next 10 minutes'), (2, 'Review error logs for the last 15 minutes'), (3, 'Check recent deployments for this service')) t(priority, action))
SELECT service_name, tier, priority, action, count(*) AS alerts FROM (SELECT *, CASE WHEN risk_score >= 80 THEN 'critical' ELSE 'warning' END AS tier FROM snaps WHERE risk_score >= 60) JOIN actions USING (tier) GROUP BY ALL""")
def recommended_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do about all alerts of each service: an action and the alerts that ask for it, added up by tier first."""
    alerts = _snapshots(spark, sf_dir).where("risk_score >= 60").groupBy("service_name", S.risk_tier(F.col("risk_score")).alias("tier")).agg(F.count("*").alias("alerts"))
    return alerts.withColumn("a", F.explode(S.recommended_actions(F.col("tier")))).select("service_name", "tier", "a.priority", "a.action", "alerts")


def _fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', round({x}, {digits}))"


@query(f"""WITH {SNAP}, a AS (SELECT * FROM snaps WHERE risk_score >= 60) SELECT id, '# Pre-mortem: ' || service_name || chr(10) || chr(10) || '**Risk score:** ' || {_fixed('risk_score', 1)} || ' (' || CASE WHEN risk_score >= 80 THEN 'critical' ELSE 'warning' END || ')' || chr(10) || chr(10)
|| '**Matched pattern:** unknown' || chr(10) || chr(10) || '## Likely failure' || chr(10) || chr(10) || 'Review the signals above before the next change.' || chr(10) AS body FROM a""")
def premortem_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _snapshots(spark, sf_dir).where("risk_score >= 60")
    return s.select("id", I.premortem_text(F.col("service_name"), F.round("risk_score", 1), S.risk_tier(F.col("risk_score")), F.lit(None).cast("string")).alias("body"))


@query(f"""WITH {SNAP} SELECT id, 'Service ''' || service_name || ''' is showing elevated risk (score ' || {_fixed('risk_score', 1)} || ', tier: ' || CASE WHEN risk_score >= 80 THEN 'critical' ELSE 'warning' END || '). Matched pattern: unknown. Velocity signal is ' || {_fixed('risk_score', 1)} || '/100, baseline deviation is 0.0/100.' AS ai_text,
'[Threshold-based alert — AI inference unavailable] Service ''' || service_name || ''' has crossed the ' || CASE WHEN risk_score >= 80 THEN 'critical' ELSE 'warning' END || ' threshold with a raw risk score of ' || {_fixed('risk_score', 1)} || '. Manual investigation is recommended.' AS plain_text FROM snaps WHERE risk_score >= 60""")
def alert_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _snapshots(spark, sf_dir).where("risk_score >= 60")
    tier, score = S.risk_tier(F.col("risk_score")), F.round("risk_score", 1)
    return s.select("id", S.alert_text(F.col("service_name"), score, tier, F.lit(None).cast("string"), score, F.lit(0.0)).alias("ai_text"), S.threshold_text(F.col("service_name"), score, tier).alias("plain_text"))


@query(f"""WITH p AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS a, CASE WHEN vec_id % 10 = 0 THEN [0.0::DOUBLE FOR x IN embedding] ELSE lag([x::DOUBLE FOR x IN embedding]) OVER (ORDER BY vec_id) END AS b FROM embeddings)
SELECT vec_id, CASE WHEN list_dot_product(b, b) > 0 THEN round({cos('a', 'b')}, 6) ELSE 0.0 END::DOUBLE AS dedup, CASE WHEN list_dot_product(b, b) > 0 THEN round({cos('a', 'b')}, 6) ELSE 1.0 END::DOUBLE AS drift,
CASE WHEN list_dot_product(b, b) > 0 THEN round(1 - {cos('a', 'b')}, 6) ELSE 1.0 END::DOUBLE AS distance FROM p""")
def cosine_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the one before; every tenth partner is the zero vector, for which the three uses differ."""
    v = D.read(spark, sf_dir, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("a"))
    before = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("a").alias("b"))
    pairs = v.join(before, "vec_id", "left").withColumn("b", F.when(F.col("vec_id") % 10 == 0, F.transform("a", lambda x: F.lit(0.0))).otherwise(F.col("b")))
    a, b = F.col("a"), F.col("b")
    return pairs.select("vec_id", F.round(V.cosine(a, b), 6).alias("dedup"), F.round(V.cosine(a, b, 1.0), 6).alias("drift"), F.round(V.cosine_distance(a, b), 6).alias("distance"))


@query("""SELECT item_id, 'stub ' || substr(md5('Label: ' || text), 1, 8) AS label FROM benchmark""")
def provider_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster labels from the stub provider, with the cut message as fallback."""
    b = D.read(spark, sf_dir, "benchmark").select("item_id", "text")
    return with_completion(b, F.concat(F.lit("Label: "), "text"), E.auto_label(F.col("text")), out="label").select("item_id", "label")


@query(f"""WITH {SNAP} SELECT id, 'draft' AS status, '# Pre-mortem: ' || service_name || chr(10) || chr(10) || '**Risk score:** ' || {_fixed('risk_score', 1)} || ' (critical)' || chr(10) || chr(10)
|| '**Matched pattern:** p' || (id % 4) || chr(10) || chr(10) || '## Likely failure' || chr(10) || chr(10) || 'Review the signals above before the next change.' || chr(10) AS body FROM snaps WHERE risk_score >= 80 AND id % 3 <> 0""")
def premortem_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _snapshots(spark, sf_dir).withColumn("risk_tier", S.risk_tier(F.col("risk_score"))).withColumn("risk_score", F.round("risk_score", 1))
    tier = F.when(F.col("id") % 3 == 0, "observe").when(F.col("id") % 3 == 1, "propose").otherwise("auto")
    return I.draft_premortems(s.withColumn("autonomy_tier", tier).withColumn("matched_pattern", F.concat(F.lit("p"), F.col("id") % 4)))
