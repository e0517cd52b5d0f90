"""Registered queries on request traces, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotwise.ensemble_sql import ensemble_sql
from slotwise.functions.fnv import OFFSET, PUBLISHED_OFFSET, fnv1a_64
from slotwise.operators import drift, ensemble, gated, labels, learn, ranks, replay
from slotwise.operators import requests as req
from slotwise.plans import compare, schedules
from slotwise.sources.scratch import written
from slotwise.sources.trace import event_trace, profile_lines

CAPACITIES = (4, 25, 100)
GAP_NAMES = [f"g{i}" for i in range(1, req.GAPS + 1)]
HISTORY = ["f_short", "f_mid", "f_long", "f_cum"]

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

TRACE = """
n AS (SELECT greatest(1, count(*) // 10) AS size FROM events),
trace AS (
  SELECT event_id, seq, ts, object_id, value, (seq // size + 1)::INT AS slot FROM (
    SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS seq, epoch_us(ts) / 1e6 AS ts, event_type || ':' || json_extract_string(props, '$.k') AS object_id, value FROM events), n
), objects AS (SELECT slot, object_id, count(*) AS freq, min(seq) AS first_seq FROM trace GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY slot ORDER BY freq DESC, first_seq) AS place, count(*) OVER (PARTITION BY slot) AS n_objects FROM objects
), top AS (SELECT *, (place <= least(n_objects, greatest(1, floor(n_objects * 0.2))))::INT AS y FROM ranked),
history AS (
  SELECT slot, object_id, freq, first_seq, coalesce(sum(freq) OVER (m RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f_short, coalesce(sum(freq) OVER (m RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f_mid,
    coalesce(sum(freq) OVER (m RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f_long, coalesce(sum(freq) OVER (m RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f_cum
  FROM objects WINDOW m AS (PARTITION BY object_id ORDER BY slot)
)"""
_LAGS = ", ".join(f"coalesce(ts - lag(ts, {i}) OVER m, 1e6) AS g{i}" for i in range(1, 7))
GAPS_SQL = f"""
gapped AS (SELECT *, {_LAGS}, least(row_number() OVER m - 1, 6)::INT AS hist_len FROM trace WINDOW m AS (PARTITION BY object_id ORDER BY seq)),
ends AS (SELECT slot, object_id, count(*) AS freq, min(seq) AS first_seq, max_by(struct_pack({", ".join(f"g{i} := g{i}" for i in range(1, 7))}, hist_len := hist_len), seq) AS l, min_by(struct_pack(g1 := g1, hist_len := hist_len), seq) AS f FROM gapped GROUP BY ALL)"""
LATE = """
late AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 5 = 0 THEN ts - 3600 * (value + 1) ELSE ts END AS raw_ts FROM trace),
counted AS (SELECT *, sum((raw_ts IS NULL)::INT) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS c FROM late),
clamped AS (SELECT * EXCLUDE (ts), c + max(CASE WHEN raw_ts IS NULL AND seq = 0 THEN 0 ELSE raw_ts - c END) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ts FROM counted)"""


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = f"WITH {TRACE.strip()}{',' + sql if not sql.lstrip().upper().startswith('SELECT') else ' ' + sql}"
        return function

    return register


def _objects(spark: SparkSession, d: str) -> DataFrame:
    return req.slot_objects(event_trace(spark, d))


def _top(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_top_share(_objects(spark, d))


def _gapped(spark: SparkSession, d: str) -> DataFrame:
    return req.with_gaps(event_trace(spark, d))


def _features(spark: SparkSession, d: str) -> DataFrame:
    """slot, object_id, freq, first_seq, last and first gaps, history and label: what learners see."""
    objects = req.slot_gaps(_gapped(spark, d))
    return labels.label_top_share(req.with_history(objects))


@query("SELECT seq, slot, object_id, ts FROM trace")
def trace_slots(spark: SparkSession, d: str) -> DataFrame:
    return event_trace(spark, d).select("seq", "slot", "object_id", "ts")


def _late(spark: SparkSession, d: str) -> DataFrame:
    """The trace with some timestamps set back and some missing."""
    raw = F.when(F.col("event_id") % 97 == 0, None).when(F.col("event_id") % 5 == 0, F.col("ts") - 3600 * (F.col("value") + 1)).otherwise(F.col("ts"))
    return event_trace(spark, d).withColumn("raw_ts", raw)


@query(LATE + " SELECT seq, slot, round(raw_ts, 6) AS raw_ts, round(ts, 6) AS ts FROM clamped")
def ts_clamp(spark: SparkSession, d: str) -> DataFrame:
    return req.clamp_time(_late(spark, d)).select("seq", "slot", F.round("raw_ts", 6).alias("raw_ts"), F.round("ts", 6).alias("ts"))


@query(LATE + " SELECT slot, count(*) AS n_requests, sum(coalesce((raw_ts < ts)::INT, 0))::BIGINT AS n_late, sum((raw_ts IS NULL)::INT)::BIGINT AS n_null, round(avg(coalesce((raw_ts < ts)::INT, 0)), 9) AS late_share FROM clamped GROUP BY slot")
def clamp_stats(spark: SparkSession, d: str) -> DataFrame:
    return req.clamp_counters(req.clamp_time(_late(spark, d)))


@query(LATE + " SELECT object_id, count(*) AS n_inversions FROM (SELECT object_id, raw_ts, lag(raw_ts) OVER (PARTITION BY object_id ORDER BY seq) AS b FROM late) WHERE raw_ts < b GROUP BY 1")
def time_inversions(spark: SparkSession, d: str) -> DataFrame:
    return req.time_inversions(_late(spark, d))


@query("SELECT slot, object_id, freq, first_seq, y FROM top")
def slot_topk_labels(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).select("slot", "object_id", "freq", "first_seq", "y")


@query("SELECT slot, object_id, freq, (rank() OVER (PARTITION BY slot ORDER BY freq DESC) <= least(n_objects, greatest(1, floor(n_objects * 0.2))))::INT AS y FROM ranked")
def labels_include_ties(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_top_share(_objects(spark, d), include_ties=True).select("slot", "object_id", "freq", "y")


@query("SELECT slot, object_id, freq, (place <= least(n_objects, 25))::INT AS y FROM ranked")
def labels_capacity(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_capacity(_objects(spark, d), 25).select("slot", "object_id", "freq", "y")


COVER = "cover AS (SELECT *, (sum(freq) OVER (PARTITION BY slot ORDER BY freq DESC, first_seq ROWS UNBOUNDED PRECEDING) - freq < 0.5 * sum(freq) OVER (PARTITION BY slot))::INT AS z FROM objects)"


@query(COVER + " SELECT slot, object_id, freq, z AS y FROM cover")
def labels_coverage(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_coverage(_objects(spark, d)).select("slot", "object_id", "freq", "y")


@query("""k AS (SELECT *, least(n_objects, greatest(1, floor(n_objects * 0.2)))::INT AS k FROM ranked), atk AS (SELECT *, max(CASE WHEN place = k THEN freq END) OVER (PARTITION BY slot) AS freq_at_k FROM k)
SELECT slot, any_value(n_objects) AS n_objects, any_value(k) AS k, any_value(freq_at_k) AS freq_at_k, count(*) FILTER (freq = freq_at_k) AS tie_count, round(sum(CASE WHEN place <= k THEN freq ELSE 0 END) / sum(freq), 9) AS coverage, round(count(*) FILTER (freq = freq_at_k) / any_value(n_objects), 9) AS tie_rate FROM atk GROUP BY slot""")
def label_info(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_info(_objects(spark, d))


@query(COVER + """ SELECT slot, sum(y)::BIGINT AS n_top, sum(z)::BIGINT AS n_cover, round(sum(y * z) / sum(greatest(y, z)), 9) AS jaccard, round(avg(CASE WHEN y = 1 THEN top.freq END), 9) AS top_mean, round(quantile_cont(CASE WHEN y = 1 THEN top.freq END, 0.5), 9) AS top_p50
FROM top JOIN cover USING (slot, object_id) GROUP BY slot""")
def label_audit(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_audit(_objects(spark, d))


@query("SELECT slot, y, count(*) AS n, round(avg(freq), 9) AS mean_freq, round(stddev_pop(freq), 6) AS std_freq, min(freq) AS min_freq, max(freq) AS max_freq FROM top GROUP BY ALL")
def class_stats(spark: SparkSession, d: str) -> DataFrame:
    return labels.class_stats(_top(spark, d))


@query(GAPS_SQL + f" SELECT slot, object_id, freq, {', '.join(f'round(l.g{i}, 6) AS g{i}' for i in range(1, 7))}, l.hist_len AS hist_len, round(f.g1, 6) AS first_g1, f.hist_len AS first_hist_len FROM ends")
def gap_features(spark: SparkSession, d: str) -> DataFrame:
    found = req.slot_gaps(_gapped(spark, d))
    return found.select("slot", "object_id", "freq", *[F.round(g, 6).alias(g) for g in GAP_NAMES], "hist_len", F.round("first_g1", 6).alias("first_g1"), "first_hist_len")


_REAL = "list_filter([g1, g2, g3, g4, g5, g6], lambda g: g <> 1e6)"


@query(GAPS_SQL + f""" SELECT slot, sum((len([x FOR x IN {_REAL.replace('list_filter', 'list_filter')} IF x < 0]) > 0)::INT)::BIGINT AS n_negative,
  sum(((g1 <> 1e6 AND g2 <> 1e6 AND g1 > g2) OR (g2 <> 1e6 AND g3 <> 1e6 AND g2 > g3) OR (g3 <> 1e6 AND g4 <> 1e6 AND g3 > g4) OR (g4 <> 1e6 AND g5 <> 1e6 AND g4 > g5) OR (g5 <> 1e6 AND g6 <> 1e6 AND g5 > g6))::INT)::BIGINT AS n_disorder,
  {", ".join(f"round(quantile_cont(CASE WHEN g1 <> 1e6 THEN g1 END, {p}), 6) AS g1_p{int(100 * p)}" for p in (0.5, 0.9, 0.99))} FROM gapped GROUP BY slot""")
def gap_audit(spark: SparkSession, d: str) -> DataFrame:
    return req.gap_audit(_gapped(spark, d))


@query("SELECT slot, object_id, freq, f_short, f_mid, f_long, f_cum FROM history")
def freq_windows(spark: SparkSession, d: str) -> DataFrame:
    return req.with_history(_objects(spark, d)).select("slot", "object_id", "freq", *HISTORY)


@query(GAPS_SQL + " SELECT slot, object_id, y, round(l.g1 + 2 * l.g2 + 3 * l.g3 + 4 * l.g4 + 5 * l.g5 + 6 * l.g6 + 7 * f_short + 8 * f_mid + 9 * f_long + 10 * f_cum, 5) AS checksum, 10 AS n_features FROM ends JOIN history USING (slot, object_id) JOIN top USING (slot, object_id)")
def feature_a2(spark: SparkSession, d: str) -> DataFrame:
    x = _features(spark, d).withColumn("x", req.feature_vector("A2"))
    return x.select("slot", "object_id", "y", F.round(F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b), 5).alias("checksum"), F.size("x").alias("n_features"))


_PAIRS = """shares AS (SELECT slot, {key} AS key, sum(freq)::DOUBLE AS w FROM {of} GROUP BY ALL), p AS (SELECT *, w / sum(w) OVER (PARTITION BY slot) AS p FROM shares),
pairs AS (SELECT coalesce(a.slot, b.slot + 1) AS slot, coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q, coalesce(a.w, 0) AS w, coalesce(b.w, 0) AS v FROM p a FULL JOIN p b ON a.slot = b.slot + 1 AND a.key = b.key),
sums AS (SELECT slot, (sum(p * (ln(p + 1e-12) - ln((p + q) / 2 + 1e-12))) + sum(q * (ln(q + 1e-12) - ln((p + q) / 2 + 1e-12)))) / 2 / ln(2) AS jsd, sum(least(w, v)) / sum(greatest(w, v)) AS overlap, sum(abs(p - q)) / 2 AS tv
  FROM pairs WHERE slot > 1 AND slot <= (SELECT max(slot) FROM trace) GROUP BY slot)"""


@query(_PAIRS.format(key="object_id", of="(SELECT * FROM top WHERE y = 1)") + " SELECT slot, round(jsd, 6) AS jsd, round(overlap, 9) AS overlap, round(tv, 9) AS tv, round(0.4 * jsd + 0.6 * (1 - overlap), 6) AS drift_raw FROM sums")
def drift_jsd(spark: SparkSession, d: str) -> DataFrame:
    return drift.slot_drift(_top(spark, d).where("y = 1"))


@query(_PAIRS.format(key="floor(log2(least(freq, 1024)))", of="(SELECT slot, freq AS freq0, freq FROM objects)").replace("sum(freq)::DOUBLE", "count(*)::DOUBLE") + " SELECT slot, round(jsd, 6) AS hist_jsd FROM sums")
def freq_hist_jsd(spark: SparkSession, d: str) -> DataFrame:
    return drift.shape_drift(_objects(spark, d))


@query("""t AS (SELECT slot, object_id FROM top WHERE y = 1), s AS (SELECT slot, count(*) AS n FROM t GROUP BY 1), b AS (SELECT a.slot, count(*) AS n FROM t a JOIN t b ON a.slot = b.slot + 1 AND a.object_id = b.object_id GROUP BY 1)
SELECT s.slot, coalesce(b.n, 0) AS n_kept, round(coalesce(b.n, 0) / (s.n + p.n - coalesce(b.n, 0)), 9) AS jaccard, round(coalesce(b.n, 0) / p.n, 9) AS retention, round((s.n - coalesce(b.n, 0)) / s.n, 9) AS new_share, round((p.n - coalesce(b.n, 0)) / p.n, 9) AS drop_share
FROM s JOIN s p ON s.slot = p.slot + 1 LEFT JOIN b ON b.slot = s.slot""")
def topk_churn(spark: SparkSession, d: str) -> DataFrame:
    return labels.churn(_top(spark, d))


@query("""g AS (SELECT object_id, slot, slot - row_number() OVER (PARTITION BY object_id ORDER BY slot) AS g FROM top WHERE y = 1), r AS (SELECT object_id, min(slot) AS first_slot, count(*) AS n_slots FROM g GROUP BY object_id, g)
SELECT *, first_slot - lag(first_slot + n_slots) OVER (PARTITION BY object_id ORDER BY first_slot) AS gap FROM r""")
def streaks(spark: SparkSession, d: str) -> DataFrame:
    return labels.streaks(_top(spark, d))


_METRICS = """scored AS (SELECT h.slot, h.f_short AS score, t.y, h.first_seq FROM history h JOIN top t USING (slot, object_id)),
r AS (SELECT *, rank() OVER (PARTITION BY slot ORDER BY score) + (count(*) OVER (PARTITION BY slot, score) - 1) / 2 AS r, row_number() OVER o AS place, sum(y) OVER (o ROWS UNBOUNDED PRECEDING) AS hits, least(count(*) OVER (PARTITION BY slot), greatest(1, floor(count(*) OVER (PARTITION BY slot) * 0.2))) AS k
  FROM scored WINDOW o AS (PARTITION BY slot ORDER BY score DESC, first_seq)),
m AS (SELECT slot, count(*) AS n, sum(y)::BIGINT AS pos, sum(r * y) AS ranks, sum(CASE WHEN y = 1 THEN hits / place END) AS precisions, max(k) AS k, sum(CASE WHEN place <= k THEN y ELSE 0 END) AS at_k FROM r GROUP BY slot)
SELECT slot, n, pos, round((ranks - pos * (pos + 1) / 2) / (pos * (n - pos)), 9) AS auc, round(precisions / pos, 9) AS ap, round(at_k / k, 9) AS prec_at_k, round(at_k / pos, 9) AS recall_at_k FROM m"""


@query(_METRICS)
def score_metrics(spark: SparkSession, d: str) -> DataFrame:
    """How well the frequency in the slot before foretells the label."""
    rows = labels.label_top_share(req.with_history(_objects(spark, d)))
    return labels.score_metrics(rows.withColumn("score", F.col("f_short")))


@query("""c AS (SELECT slot, (f_short > 0)::INT AS p, y FROM history JOIN top USING (slot, object_id)), s AS (SELECT slot, sum(p * y)::BIGINT AS tp, sum(p * (1 - y))::BIGINT AS fp, sum((1 - p) * y)::BIGINT AS fn, sum((1 - p) * (1 - y))::BIGINT AS tn FROM c GROUP BY slot),
q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM s)
SELECT slot, tp, fp, fn, tn, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round(pr, 9) AS precision, round(re, 9) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 9) AS f1 FROM q""")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = labels.label_top_share(req.with_history(_objects(spark, d)))
    return labels.confusion(rows.withColumn("predicted", (F.col("f_short") > 0).cast("int")))


@query("""r AS (SELECT slot, freq::DOUBLE AS x, f_cum::DOUBLE AS y, rank() OVER (PARTITION BY slot ORDER BY freq) + (count(*) OVER (PARTITION BY slot, freq) - 1) / 2 AS rx, rank() OVER (PARTITION BY slot ORDER BY f_cum) + (count(*) OVER (PARTITION BY slot, f_cum) - 1) / 2 AS ry FROM history WHERE slot > 1)
SELECT slot, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY slot""")
def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    rows = req.with_history(_objects(spark, d)).where("slot > 1").select("slot", F.col("freq").cast("double").alias("x"), F.col("f_cum").cast("double").alias("y"))
    return labels.correlations(rows, "x", "y")


_NB = ["f_short", "f_mid"]
_NB_SQL = """rows AS (SELECT slot, object_id, y, f_short, f_mid FROM history JOIN top USING (slot, object_id)),
sums AS (SELECT slot, y, count(*) AS n, sum(f_short) AS s1, sum(f_short * f_short) AS q1, sum(f_mid) AS s2, sum(f_mid * f_mid) AS q2 FROM rows GROUP BY ALL),
moments AS (SELECT slot, y, n::DOUBLE AS n, s1::DOUBLE / n AS m_f_short, s2::DOUBLE / n AS m_f_mid, greatest((n * q1 - s1 * s1)::DOUBLE / (n::DOUBLE * n), 1e-9) AS v_f_short, greatest((n * q2 - s2 * s2)::DOUBLE / (n::DOUBLE * n), 1e-9) AS v_f_mid FROM sums)"""


@query(_NB_SQL + " SELECT slot, y, n, round(m_f_short, 6) AS m_f_short, round(m_f_mid, 6) AS m_f_mid, round(v_f_short, 6) AS v_f_short, round(v_f_mid, 6) AS v_f_mid FROM moments")
def nb_fit_slot(spark: SparkSession, d: str) -> DataFrame:
    rows = labels.label_top_share(req.with_history(_objects(spark, d)))
    return learn.count_moments(rows, _NB).select("slot", "y", "n", *[F.round(f"{k}_{f}", 6).alias(f"{k}_{f}") for k in "mv" for f in _NB])


@query(_NB_SQL + """, wide AS (SELECT a.slot + 1 AS slot, ln(a.n / b.n) AS prior, a.m_f_short AS ms0, b.m_f_short AS ms1, a.v_f_short AS vs0, b.v_f_short AS vs1, a.m_f_mid AS mm0, b.m_f_mid AS mm1, a.v_f_mid AS vm0, b.v_f_mid AS vm1
  FROM moments a JOIN moments b ON a.slot = b.slot AND a.y = 0 AND b.y = 1),
j AS (SELECT r.slot, object_id, y, prior + 0.5 * (ln(vs1 / vs0) + ((f_short - ms1) ** 2 / vs1 - (f_short - ms0) ** 2 / vs0)) + 0.5 * (ln(vm1 / vm0) + ((f_mid - mm1) ** 2 / vm1 - (f_mid - mm0) ** 2 / vm0)) AS against FROM rows r JOIN wide USING (slot))
SELECT slot, object_id, y, round(1 / (1 + exp(greatest(-700, least(700, against)))), 6) AS p FROM j""")
def nb_score(spark: SparkSession, d: str) -> DataFrame:
    rows = labels.label_top_share(req.with_history(_objects(spark, d)))
    return learn.score_next_slot(rows, learn.count_moments(rows, _NB), _NB).select("slot", "object_id", "y", F.round("p", 6).alias("p"))


@query("SELECT n AS n_objects, p::DOUBLE AS percent, floor(n * p::DOUBLE / 100)::BIGINT AS capacity FROM (SELECT count(DISTINCT object_id) AS n FROM trace), (VALUES (0.8), (1), (2), (3), (4), (5)) v(p)")
def capacities(spark: SparkSession, d: str) -> DataFrame:
    return req.capacities(event_trace(spark, d))


LRU_SQL = """used AS (SELECT seq, object_id, lag(seq) OVER (PARTITION BY object_id ORDER BY seq) AS prev FROM trace WHERE slot > 2),
far AS (SELECT a.seq, count(b.seq) AS distance FROM used a LEFT JOIN used b ON b.seq > a.prev AND b.seq < a.seq AND b.prev IS NOT NULL AND b.prev > a.prev WHERE a.prev IS NOT NULL GROUP BY a.seq),
reuse AS (SELECT used.seq, CASE WHEN used.prev IS NOT NULL THEN used.seq - used.prev - 1 - far.distance END AS distance FROM used LEFT JOIN far USING (seq))"""
LRU_RUNS = "lru AS (SELECT c AS capacity, sum(coalesce((distance < c)::INT, 0))::BIGINT AS hits, count(*) AS requests, round(sum(coalesce((distance < c)::INT, 0)) / count(*), 9) AS hit_ratio FROM reuse, (VALUES (4::BIGINT), (25::BIGINT), (100::BIGINT)) v(c) GROUP BY c)"
STATIC_RUNS = """prior AS (SELECT slot + 1 AS slot, object_id, row_number() OVER (PARTITION BY slot ORDER BY freq DESC, first_seq) AS place FROM objects),
asked AS (SELECT t.slot, c AS capacity, (p.place IS NOT NULL AND p.place <= c)::INT AS hit FROM trace t LEFT JOIN prior p ON t.slot = p.slot AND t.object_id = p.object_id, (VALUES (4::BIGINT), (25::BIGINT), (100::BIGINT)) v(c) WHERE t.slot > 2)"""


def _distances(spark: SparkSession, d: str) -> DataFrame:
    trace = event_trace(spark, d)
    return replay.lru_distances(trace.where("slot > 2"), max(CAPACITIES), stretch=10_000)


@query(LRU_SQL + ", " + LRU_RUNS + " SELECT * FROM lru")
def lru_curve(spark: SparkSession, d: str) -> DataFrame:
    return replay.lru_curve(_distances(spark, d), CAPACITIES)


def _static(spark: SparkSession, d: str) -> DataFrame:
    """slot, capacity, hit of a cache that holds the top objects of the slot before: requests joined with residents."""
    trace = event_trace(spark, d)
    order = Window.partitionBy("slot").orderBy(F.desc("freq"), "first_seq")
    resident = req.slot_objects(trace).withColumn("place", F.row_number().over(order)).where(f"place <= {max(CAPACITIES)}").select((F.col("slot") + 1).alias("slot"), "object_id", "place")
    asked = trace.where("slot > 2").select("slot", "object_id").join(resident, ["slot", "object_id"], "left")
    return asked.select("slot", "place", F.explode(F.array(*[F.lit(c).cast("long") for c in CAPACITIES])).alias("capacity")).select("slot", "capacity", F.coalesce((F.col("place") <= F.col("capacity")).cast("int"), F.lit(0)).alias("hit"))


@query(STATIC_RUNS + " SELECT slot, capacity, sum(hit)::BIGINT AS hits, count(*) AS requests, round(avg(hit), 9) AS hit_ratio FROM asked GROUP BY ALL")
def static_topc_hits(spark: SparkSession, d: str) -> DataFrame:
    return _static(spark, d).groupBy("slot", "capacity").agg(F.sum("hit").alias("hits"), F.count("*").alias("requests"), F.round(F.avg("hit"), 9).alias("hit_ratio"))


_COMPARED = f"{LRU_SQL}, {LRU_RUNS}, {STATIC_RUNS}, st AS (SELECT capacity, round(avg(hit), 9) AS hit_ratio FROM asked GROUP BY 1), cmp AS (SELECT capacity, st.hit_ratio AS hr_a, lru.hit_ratio AS hr_b, round(st.hit_ratio - lru.hit_ratio, 9) AS delta_hr, round((st.hit_ratio - lru.hit_ratio) / greatest(1e-12, 1 - lru.hit_ratio), 9) AS rmr, CASE WHEN abs(st.hit_ratio - lru.hit_ratio) < 1e-6 THEN 'tie' WHEN st.hit_ratio > lru.hit_ratio THEN 'win' ELSE 'lose' END AS outcome FROM st JOIN lru USING (capacity))"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    static = _static(spark, d).groupBy("capacity").agg(F.round(F.avg("hit"), 9).alias("hit_ratio"))
    lru = replay.lru_curve(_distances(spark, d), CAPACITIES).select("capacity", "hit_ratio")
    return static.withColumn("variant", F.lit("static")).unionByName(lru.withColumn("variant", F.lit("lru")))


@query(_COMPARED + " SELECT * FROM cmp")
def rmr_table(spark: SparkSession, d: str) -> DataFrame:
    return compare.compare_runs(_runs(spark, d), "static", "lru")


@query(_COMPARED + " SELECT round(avg(delta_hr), 9) AS mean_delta, round(avg(rmr), 9) AS mean_rmr, count(*) FILTER (outcome = 'win') AS win, count(*) FILTER (outcome = 'tie') AS tie, count(*) FILTER (outcome = 'lose') AS lose FROM cmp")
def variant_summary(spark: SparkSession, d: str) -> DataFrame:
    return compare.summarize_outcomes(compare.compare_runs(_runs(spark, d), "static", "lru"))


@query(_COMPARED + ' SELECT \'static\' AS variant, max(hr_a) FILTER (capacity = 4) AS "4", max(hr_a) FILTER (capacity = 25) AS "25", max(hr_a) FILTER (capacity = 100) AS "100" FROM cmp UNION ALL SELECT \'lru\', max(hr_b) FILTER (capacity = 4), max(hr_b) FILTER (capacity = 25), max(hr_b) FILTER (capacity = 100) FROM cmp')
def hit_ratio_pivot(spark: SparkSession, d: str) -> DataFrame:
    return compare.hit_ratio_pivot(_runs(spark, d), CAPACITIES)


_SERIES = STATIC_RUNS + ", s AS (SELECT slot, round(avg(hit), 9) AS hr FROM asked WHERE capacity = 25 GROUP BY 1)"


def _series(spark: SparkSession, d: str) -> DataFrame:
    return _static(spark, d).where("capacity = 25").groupBy("slot").agg(F.round(F.avg("hit"), 9).alias("hr"))


@query(_SERIES + " SELECT slot, hr, round(avg(hr) OVER (ORDER BY slot ROWS 4 PRECEDING), 9) AS hr_smooth FROM s")
def smoothed_hits(spark: SparkSession, d: str) -> DataFrame:
    return compare.trailing_mean(_series(spark, d), "hr")


@query(_SERIES + ", i AS (SELECT *, row_number() OVER (ORDER BY slot) AS n FROM s) SELECT a.slot, round(sum(CASE WHEN b.n = 1 THEN 1 ELSE 0.2 END * 0.8 ** (a.n - b.n) * b.hr), 9) AS hr_ema FROM i a JOIN i b ON b.n <= a.n GROUP BY a.slot")
def hit_ratio_ema(spark: SparkSession, d: str) -> DataFrame:
    return compare.exponential_mean(_series(spark, d), "hr")


@query("""a AS (SELECT slot, object_id FROM ranked WHERE place <= 25), f AS (SELECT a.slot, a.object_id, coalesce(sum(o.freq), 0) AS hits FROM a LEFT JOIN objects o ON o.object_id = a.object_id AND o.slot BETWEEN a.slot + 1 AND a.slot + 3 GROUP BY ALL),
q AS (SELECT a.slot, sum(o.freq) AS future FROM (SELECT DISTINCT slot FROM a) a JOIN objects o ON o.slot BETWEEN a.slot + 1 AND a.slot + 3 GROUP BY 1)
SELECT f.slot, count(*) AS admit_k, any_value(future)::BIGINT AS future_requests, sum(hits)::BIGINT AS future_hits, count(*) FILTER (hits > 0) AS unique_hits, round(sum(hits) / any_value(future), 9) AS hit_share, round(sum(hits) / count(*), 9) AS hits_per_admit FROM f JOIN q USING (slot) GROUP BY f.slot""")
def post_admit_hits(spark: SparkSession, d: str) -> DataFrame:
    """Of each slot's 25 most frequent objects: requests for them within the next three slots."""
    objects = _objects(spark, d)
    order = Window.partitionBy("slot").orderBy(F.desc("freq"), "first_seq")
    admitted = objects.withColumn("place", F.row_number().over(order)).where("place <= 25").select("slot", "object_id")
    ahead = objects.select(F.explode(F.array(*[F.col("slot") - i for i in (1, 2, 3)])).alias("slot"), "object_id", "freq")  # three copies make the range join an equi join
    total = ahead.groupBy("slot").agg(F.sum("freq").alias("future_requests"))
    hits = admitted.join(ahead, ["slot", "object_id"], "left").groupBy("slot", "object_id").agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("hits"))
    sums = hits.groupBy("slot").agg(F.count("*").alias("admit_k"), F.sum("hits").alias("future_hits"), F.sum((F.col("hits") > 0).cast("long")).alias("unique_hits"))
    return sums.join(total, "slot").select("slot", "admit_k", "future_requests", "future_hits", "unique_hits", F.round(F.col("future_hits") / F.col("future_requests"), 9).alias("hit_share"), F.round(F.col("future_hits") / F.col("admit_k"), 9).alias("hits_per_admit"))


@query("SELECT slot, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS top FROM trace GROUP BY slot")
def slot_value_summary(spark: SparkSession, d: str) -> DataFrame:
    trace = event_trace(spark, d)
    high = ranks.quantiles(trace, "value", {"p95": 0.95, "p99": 0.99}, ["slot"]).select("slot", F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99"))
    return trace.groupBy("slot").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("top")).join(high, "slot", "left").select("slot", "mean", "p95", "p99", "top")


@query("SELECT len(string_split_regex(trim(props), '\\s+'))::INT AS fields, count(*) AS n_lines FROM events GROUP BY 1")
def raw_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile_lines(spark.read.parquet(f"{d}/events.parquet").select(F.col("props").alias("value")))


@query("SELECT count(*) AS n_rows, count(DISTINCT object_id) AS n_objects, min(seq) AS first_seq, max(seq) AS last_seq, max(slot) AS n_slots FROM trace")
def trace_validation(spark: SparkSession, d: str) -> DataFrame:
    return event_trace(spark, d).agg(F.count("*").alias("n_rows"), F.countDistinct("object_id").alias("n_objects"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max("slot").alias("n_slots"))


_FNV = "list_reduce(list_prepend({0}::HUGEINT, list_transform(string_split(object_id, ''), lambda c: ascii(c)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
_SIGNED = "(CASE WHEN {0} >= 9223372036854775808::HUGEINT THEN {0} - 18446744073709551616::HUGEINT ELSE {0} END)::BIGINT"


@query(f"hashed AS (SELECT DISTINCT object_id, {_FNV.format(OFFSET)} AS a, {_FNV.format(PUBLISHED_OFFSET)} AS b FROM trace) SELECT object_id, {_SIGNED.format('a')} AS fnv1a, {_SIGNED.format('b')} AS fnv1a_published FROM hashed")
def object_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes from the sketches' offset basis and from the published one."""
    objects = event_trace(spark, d).select("object_id").distinct()
    return objects.select("object_id", fnv1a_64("object_id").alias("fnv1a"), fnv1a_64("object_id", PUBLISHED_OFFSET).alias("fnv1a_published"))


@query()
def replay_policies(spark: SparkSession, d: str) -> DataFrame:
    return replay.replay_policies(event_trace(spark, d).where("slot > 2"), CAPACITIES)


FEATURES = [*GAP_NAMES, *HISTORY]


def _vector_rows(spark: SparkSession, d: str) -> DataFrame:
    """What a slot's training sees: each object's last gaps (as logs), history and label."""
    return _features(spark, d).withColumns({g: F.log1p(g) for g in GAP_NAMES})


def _request_rows(spark: SparkSession, d: str) -> DataFrame:
    """What scoring sees: each request's own gaps (as logs) and its object's history."""
    gapped = _gapped(spark, d)
    history = req.with_history(req.slot_objects(gapped)).select("slot", "object_id", *HISTORY)
    return gapped.select("slot", "seq", "object_id", *[F.log1p(g).alias(g) for g in GAP_NAMES]).join(history, ["slot", "object_id"])


#: What learners see, as SQL: an object's last gaps of the slot (as logs), history and label.
LEARNT = GAPS_SQL + ", d AS (SELECT slot, object_id, y, first_seq, l.hist_len AS last_hist_len, f.hist_len AS first_hist_len, f_short, f_mid, f_long, f_cum, " + ", ".join(f"l.g{i} AS g{i}, f.g{i} AS first_g{i}" for i in range(1, 7)) + " FROM (SELECT slot, object_id, l, f FROM ends) JOIN history USING (slot, object_id) JOIN (SELECT slot, object_id, y FROM top) USING (slot, object_id))"
LEARNT = LEARNT.replace("min_by(struct_pack(g1 := g1, hist_len := hist_len), seq)", "min_by(struct_pack(" + ", ".join(f"g{i} := g{i}" for i in range(1, 7)) + ", hist_len := hist_len), seq)")
NSE = LEARNT + ", " + ensemble_sql([*[f"ln(1 + g{i})" for i in range(1, 7)], *HISTORY])


@query(NSE + " SELECT slot, created, round(weight, 6) AS weight FROM nse_weight")
def nse_weights(spark: SparkSession, d: str) -> DataFrame:
    return ensemble.fit_ensembles(_vector_rows(spark, d), FEATURES).weight_table(spark).withColumn("weight", F.round("weight", 6))


@query(NSE + ", s AS (SELECT slot, object_id, sum(CASE WHEN margin > 0 THEN weight ELSE 0 END) AS ones, sum(weight) AS every, sum(weight / (1 + exp(-margin))) / sum(weight) AS score, count(*) AS n FROM nse_judged GROUP BY ALL) SELECT d.slot, d.object_id, round(coalesce(score, 0.5), 6) AS score, coalesce((2 * ones >= every)::INT, 1) AS vote, coalesce(n, 0)::INT AS n_members FROM d LEFT JOIN s USING (slot, object_id)")
def nse_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each slot's objects, at their last request, by the ensemble of the slots before."""
    rows = _vector_rows(spark, d)
    found = ensemble.score_requests(rows.withColumn("seq", F.col("first_seq")), ensemble.fit_ensembles(rows, FEATURES), FEATURES)
    return found.select("slot", "object_id", F.round("score", 6).alias("score"), "vote", "n_members")


def _scores(spark: SparkSession, d: str, learner: str = "nb", features: list[str] = FEATURES) -> DataFrame:
    return ensemble.score_requests(_request_rows(spark, d), ensemble.fit_ensembles(_vector_rows(spark, d), features, learner), features)


def _scored(spark: SparkSession, d: str, learner: str = "nb", features: list[str] = FEATURES) -> DataFrame:
    """Scores with labels; an object without a label has 0."""
    return _scores(spark, d, learner, features).join(_top(spark, d).select("slot", "object_id", "y"), ["slot", "object_id"], "left").na.fill({"y": 0})


@query()
def guard_slot_log(spark: SparkSession, d: str) -> DataFrame:
    return replay.guard_slot_log(_scored(spark, d), drift.slot_drift(_top(spark, d).where("y = 1")))


@query()
def guard_runs(spark: SparkSession, d: str) -> DataFrame:
    """Each variant's totals over its cache slots."""
    log = guard_slot_log(spark, d).where("phase = 'cache'")
    return log.groupBy("variant", "capacity").agg(F.sum("hits").alias("hits"), F.sum("requests").alias("requests"), F.sum("selected").alias("admitted"), F.avg("precision").alias("precision"), (F.sum("polluted") / F.sum("applied")).alias("pollution")).withColumns({"hit_ratio": F.col("hits") / F.col("requests"), "hit_yield": F.col("hits") / F.col("admitted")})


@query()
def drift_detector_runs(spark: SparkSession, d: str) -> DataFrame:
    """The drift-driven variant under each sequential detector of the miss rate."""
    placed, raw = replay.placed_objects(_scored(spark, d)), drift.slot_drift(_top(spark, d).where("y = 1"))
    runs = [replay.guard_object_log(placed, raw, ("drift_only",), (100,), detector=k).withColumn("detector", F.lit(k)) for k in ("adwin", "page_hinkley")]
    return runs[0].unionByName(runs[1])


@query()
def gbt_admission(spark: SparkSession, d: str) -> DataFrame:
    """LRU that inserts a miss only if boosted trees fitted on the period before (two slots) give it half a chance at least."""
    judged = ensemble.period_admission(_vector_rows(spark, d), _request_rows(spark, d), FEATURES, warmup=2, every=2)
    return replay.replay_policies(judged.where("slot > 2"), CAPACITIES, policies=("LRU",), admit="admit")


@query()
def learned_admission(spark: SparkSession, d: str) -> DataFrame:
    """LRU that inserts a miss only if the ensemble of the slots before votes for its request, by the gaps alone."""
    return replay.replay_policies(_scores(spark, d, features=GAP_NAMES).where("slot > 2"), CAPACITIES, policies=("LRU",), admit="vote")


def _label_log(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).groupBy("slot").agg(F.sum("y").alias("selected")).withColumns({"variant": F.lit("labels"), "capacity": F.lit(100).cast("long")})


@query(
    """chosen AS (SELECT slot, sum(y)::BIGINT AS selected FROM top GROUP BY slot),
    total AS (SELECT sum(selected)::BIGINT AS total, count(*) AS n, max(slot) AS last, round_even(sum(selected) / count(*), 0)::BIGINT AS mean FROM chosen)
    SELECT 'labels' AS variant, 100::BIGINT AS capacity, slot, CASE WHEN slot = last THEN greatest(0, total - mean * (n - 1)) ELSE mean END::BIGINT AS scheduled FROM chosen, total"""
)
def even_schedule(spark: SparkSession, d: str) -> DataFrame:
    return schedules.even_schedule(_label_log(spark, d))


@query("""chosen AS (SELECT slot, sum(y)::BIGINT AS selected, row_number() OVER (ORDER BY slot) AS place, row_number() OVER (ORDER BY md5('7:' || slot), slot) AS drawn FROM top GROUP BY slot)
    SELECT 'labels' AS variant, 100::BIGINT AS capacity, a.slot, b.selected AS scheduled FROM chosen a JOIN chosen b ON a.place = b.drawn""")
def permuted_schedule(spark: SparkSession, d: str) -> DataFrame:
    return schedules.permuted_schedule(_label_log(spark, d))


@query("SELECT 'labels' AS variant, 100::BIGINT AS capacity, slot, sum(y)::BIGINT AS scheduled FROM top GROUP BY slot")
def matched_schedule(spark: SparkSession, d: str) -> DataFrame:
    return schedules.matched_schedule(_label_log(spark, d))


@query()
def scheduled_runs(spark: SparkSession, d: str) -> DataFrame:
    """Unguarded runs that admit as many as the guarded one: slot by slot, evenly, and in another order of slots."""
    placed, raw = replay.placed_objects(_scored(spark, d)), written(drift.slot_drift(_top(spark, d).where("y = 1")), "slot-drift")
    log = written(replay.guard_object_log(placed, raw, ("guard",), (100,)).where("phase = 'cache'"), "guard-log")
    made = {"matched": schedules.matched_schedule(log), "even": schedules.even_schedule(log), "permuted": schedules.permuted_schedule(log)}
    runs = [replay.guard_object_log(placed, raw, ("no_guard",), (100,), schedule=s).withColumn("schedule", F.lit(k)) for k, s in made.items()]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@query()
def guard_grid(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the guarded variant over a grid of its gate and gains: a run a combination."""
    grid = replay.grid_variants(replay.VARIANTS["guard"], gate=(0.02, 0.05, 0.2), miss_gain=(0.0, 0.5), gate_if_poor=(False, True))
    log = replay.guard_slot_log(_scored(spark, d), drift.slot_drift(_top(spark, d).where("y = 1")), grid, (100,)).where("phase = 'cache'")
    return log.groupBy("variant", "capacity").agg(F.sum("hits").alias("hits"), F.sum("requests").alias("requests"), F.sum("selected").alias("admitted"))


@query()
def gated_slot_log(spark: SparkSession, d: str) -> DataFrame:
    return gated.gated_slot_log(_scored(spark, d))


@query()
def svm_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, "svm")


@query()
def tree_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, "tree")
