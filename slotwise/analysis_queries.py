"""Registered queries on slot logs and audits: runs of two residence rules that SQL can replay, and what the analyses make of them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotwise import queries as q
from slotwise.ensemble_sql import ensemble_sql
from slotwise.functions.formats import decode_tag, encode_tag
from slotwise.operators import drift, ensemble, labels, learn, ranks
from slotwise.operators import requests as req
from slotwise.sources.scratch import written
from slotwise.plans import analysis, compare, sequential
from slotwise.sources.trace import event_trace

query = q.query
BASELINE, STATIC = "frozen", "static"

LOG = """prior AS (SELECT slot + 1 AS slot, object_id, place FROM ranked), warm AS (SELECT object_id, place FROM ranked WHERE slot = 2),
size_of AS (SELECT unnest([4::BIGINT, 25, 100]) AS c),
req AS (SELECT 'static' AS variant, c AS capacity, t.slot, t.object_id, (p.place IS NOT NULL AND p.place <= c)::INT AS hit FROM trace t LEFT JOIN prior p ON t.slot = p.slot AND t.object_id = p.object_id, size_of WHERE t.slot > 2
  UNION ALL SELECT 'frozen', c, t.slot, t.object_id, (p.place IS NOT NULL AND p.place <= c)::INT FROM trace t LEFT JOIN warm p ON t.object_id = p.object_id, size_of WHERE t.slot > 2),
log AS (SELECT variant, capacity, slot, count(*) AS requests, sum(hit)::BIGINT AS hits, round(avg(hit), 9) AS hr, count(DISTINCT object_id) FILTER (hit = 0) AS candidates, count(DISTINCT object_id) FILTER (hit = 1) AS selected FROM req GROUP BY ALL),
runs AS (SELECT variant, capacity, round(avg(hr), 9) AS hit_ratio FROM log GROUP BY ALL)"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """variant, capacity, slot, object_id, hit: residents are the top objects of the slot before (static), or of slot 2 for good (frozen)."""
    trace = event_trace(spark, d)
    order = Window.partitionBy("slot").orderBy(F.desc("freq"), "first_seq")
    top = req.slot_objects(trace).withColumn("place", F.row_number().over(order)).where(f"place <= {max(q.CAPACITIES)}")
    asked = trace.where("slot > 2").select("slot", "object_id")
    static = asked.join(top.select((F.col("slot") + 1).alias("slot"), "object_id", "place"), ["slot", "object_id"], "left").withColumn("variant", F.lit("static"))
    frozen = asked.join(top.where("slot = 2").select("object_id", "place"), "object_id", "left").withColumn("variant", F.lit("frozen"))
    sizes = F.explode(F.array(*[F.lit(c).cast("long") for c in q.CAPACITIES])).alias("capacity")
    both = static.unionByName(frozen).select("variant", sizes, "slot", "object_id", "place")
    return both.select("variant", "capacity", "slot", "object_id", F.coalesce((F.col("place") <= F.col("capacity")).cast("int"), F.lit(0)).alias("hit"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Slot log of both rules; from counts per object, so requests are aggregated once, map-side."""
    objects = _requests(spark, d).groupBy("variant", "capacity", "slot", "object_id").agg(F.count("*").alias("n"), F.max("hit").alias("hit"))
    sums = objects.groupBy("variant", "capacity", "slot").agg(F.sum("n").alias("requests"), F.sum(F.col("n") * F.col("hit")).alias("hits"), F.sum((F.col("hit") == 0).cast("long")).alias("candidates"), F.sum((F.col("hit") == 1).cast("long")).alias("selected"))
    return sums.withColumn("hr", F.round(F.col("hits") / F.col("requests"), 9))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).groupBy("variant", "capacity").agg(F.round(F.avg("hr"), 9).alias("hit_ratio"))


@query(LOG + " SELECT * FROM log")
def slot_logs(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d)


@query(LOG + " SELECT variant, capacity, count(*) AS n_slots, round(avg(hr), 9) AS mean_hr, round(avg(candidates), 9) AS mean_candidates, round(avg((hr > 0.1)::INT), 9) AS share_good FROM (SELECT *, hr > 0.1 AS good FROM log) GROUP BY ALL")
def run_averages(spark: SparkSession, d: str) -> DataFrame:
    return analysis.run_averages(_log(spark, d).withColumn("good", F.col("hr") > 0.1), ("hr", "candidates"), ("good",))


@query(LOG + " SELECT variant, capacity, slot, hr, min(hr) OVER w AS least, max(hr) OVER w AS greatest, round(sum(hr) OVER w, 9) AS total FROM log WINDOW w AS (PARTITION BY variant, capacity ORDER BY slot ROWS UNBOUNDED PRECEDING)")
def running_extremes(spark: SparkSession, d: str) -> DataFrame:
    return analysis.running_extremes(_log(spark, d), "hr").select("variant", "capacity", "slot", "hr", "least", "greatest", "total")


@query(LOG + """, l AS (SELECT variant, capacity, lag(selected) OVER (PARTITION BY variant, capacity ORDER BY slot)::DOUBLE AS x, hr AS y FROM log)
SELECT variant, capacity, count(*) AS n_pairs, round(corr(x, y), 6) AS pearson FROM l WHERE x IS NOT NULL GROUP BY ALL""")
def lagged_correlation(spark: SparkSession, d: str) -> DataFrame:
    return analysis.lagged_correlation(_log(spark, d), "selected", "hr")


@query(LOG + " SELECT r.variant, r.capacity, r.hit_ratio, round(r.hit_ratio - b.hit_ratio, 9) AS gain FROM runs r LEFT JOIN runs b ON b.variant = 'frozen' AND b.capacity = r.capacity")
def gain_matrix(spark: SparkSession, d: str) -> DataFrame:
    return analysis.gain_matrix(_runs(spark, d), BASELINE)


@query(LOG + " SELECT variant, capacity, round(avg(selected), 9) AS selected_per_slot, round(avg(candidates), 9) AS candidates_per_slot, round(sum(selected) / sum(candidates), 9) AS admit_rate, round(avg(1 - hits / requests), 9) AS miss_rate FROM log GROUP BY ALL")
def admission_intensity(spark: SparkSession, d: str) -> DataFrame:
    return analysis.admission_intensity(_log(spark, d))


@query(LOG + """, s AS (SELECT *, abs(hr - lag(hr) OVER (PARTITION BY variant, capacity ORDER BY slot)) AS step FROM log)
SELECT variant, capacity, round(avg(hr), 9) AS mean, round(stddev_pop(hr), 6) AS deviation, round(avg(step), 9) AS mean_step, min(hr) AS least FROM s GROUP BY ALL""")
def stability_matrix(spark: SparkSession, d: str) -> DataFrame:
    return analysis.stability(_log(spark, d))


_RANKS = "rank() OVER (PARTITION BY variant, capacity ORDER BY {0}) + (count(*) OVER (PARTITION BY variant, capacity, {0}) - 1) / 2 AS r_{0}"


@query(LOG + f", r AS (SELECT *, {_RANKS.format('candidates')}, {_RANKS.format('selected')} FROM log) SELECT variant, capacity, round(corr(candidates, selected), 6) AS pearson, round(corr(r_candidates, r_selected), 6) AS spearman FROM r GROUP BY ALL")
def control_correlations(spark: SparkSession, d: str) -> DataFrame:
    return analysis.control_correlations(_log(spark, d), "candidates", "selected")


@query(LOG + " SELECT capacity, arg_max(variant, (hit_ratio, variant <> 'static')) AS variant, max(hit_ratio) AS mean FROM runs GROUP BY capacity")
def best_variants(spark: SparkSession, d: str) -> DataFrame:
    return analysis.best_variants(_runs(spark, d))


@query(LOG + """, g AS (SELECT variant, split_part(object_id, ':', 1) AS dataset, capacity AS feature, round(avg(hit), 9) AS hit_ratio FROM req GROUP BY ALL)
SELECT dataset, feature, a.hit_ratio AS hit_ratio_a, b.hit_ratio AS hit_ratio_b, round(a.hit_ratio - b.hit_ratio, 9) AS delta, CASE WHEN abs(a.hit_ratio - b.hit_ratio) < 1e-6 THEN 'tie' WHEN a.hit_ratio > b.hit_ratio THEN 'win' ELSE 'lose' END AS outcome
FROM g a JOIN g b USING (dataset, feature) WHERE a.variant = 'static' AND b.variant = 'frozen'""")
def group_comparison(spark: SparkSession, d: str) -> DataFrame:
    """One rule against the other for each type of event and capacity."""
    keyed = _requests(spark, d).groupBy("variant", F.split("object_id", ":")[0].alias("dataset"), F.col("capacity").alias("feature")).agg(F.round(F.avg("hit"), 9).alias("hit_ratio"))
    return analysis.compare_by(keyed, ["dataset", "feature"], STATIC, BASELINE)


@query(LOG + """ SELECT a.capacity, a.hit_ratio AS hit_ratio_a, b.hit_ratio AS hit_ratio_b, round(a.hit_ratio - b.hit_ratio, 9) AS delta,
CASE WHEN b.hit_ratio IS NULL THEN 'missing' WHEN abs(a.hit_ratio - b.hit_ratio) < 1e-6 THEN 'tie' WHEN a.hit_ratio > b.hit_ratio THEN 'win' ELSE 'lose' END AS outcome
FROM runs a LEFT JOIN runs b ON b.variant = 'frozen' AND b.capacity = a.capacity AND b.capacity > 4 WHERE a.variant = 'static'""")
def rated_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Against a baseline that was not run at the smallest capacity."""
    return analysis.compare_by(_runs(spark, d).where("variant <> 'frozen' or capacity > 4"), ["capacity"], STATIC, BASELINE, keep=True)


@query(LOG + """, stats AS (SELECT slot, count(*) AS n_objects, max(freq) AS top_freq, round(sum(CASE WHEN y = 1 THEN freq ELSE 0 END) / sum(freq), 9) AS top_share FROM top GROUP BY slot)
SELECT log.variant, log.capacity, slot, hr, n_objects, top_freq, top_share FROM log LEFT JOIN stats USING (slot)""")
def log_with_trace(spark: SparkSession, d: str) -> DataFrame:
    """The slot logs beside what the trace was like in each slot."""
    stats = q._top(spark, d).groupBy("slot").agg(F.count("*").alias("n_objects"), F.max("freq").alias("top_freq"), F.round(F.sum(F.col("freq") * F.col("y")) / F.sum("freq"), 9).alias("top_share"))
    return _log(spark, d).join(stats, "slot", "left").select("variant", "capacity", "slot", "hr", "n_objects", "top_freq", "top_share")


@query(LOG + " SELECT variant, capacity, count(*) AS n_slots, round(sum(1 - hr), 9) AS miss_area FROM log WHERE slot BETWEEN 6 AND 8 GROUP BY ALL")
def shift_miss_area(spark: SparkSession, d: str) -> DataFrame:
    return analysis.shift_miss_area(_log(spark, d), 6, 3)


@query(LOG + " SELECT variant, capacity, slot, hr, round((row_number() OVER (PARTITION BY variant, capacity ORDER BY hr, slot) - 1) / (count(*) OVER (PARTITION BY variant, capacity) - 1), 9) AS share FROM log")
def hit_ratio_distribution(spark: SparkSession, d: str) -> DataFrame:
    return analysis.empirical_distribution(_log(spark, d), "hr")


_JSD = q._PAIRS.format(key="object_id", of="(SELECT * FROM top WHERE y = 1)")


@query(LOG + ", " + _JSD + " SELECT slot, capacity, round(greatest(0, least(1, 10.0 * (0.2 * (1 - hr) + 0.8 * round(jsd, 6)))), 6) AS drift FROM sums JOIN log USING (slot) WHERE variant = 'static'")
def older_drift(spark: SparkSession, d: str) -> DataFrame:
    moved = drift.slot_drift(q._top(spark, d).where("y = 1")).select("slot", "jsd")
    return _log(spark, d).where("variant = 'static'").join(moved, "slot").select("slot", "capacity", F.round(analysis.older_drift(1 - F.col("hr"), F.col("jsd")), 6).alias("drift"))


_EVENTS = """, placed AS (SELECT variant, capacity, slot, candidates::DOUBLE AS v, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY variant, capacity) AS n FROM log WINDOW w AS (PARTITION BY variant, capacity ORDER BY slot)),
c AS (SELECT variant, capacity, list([pos, slot::BIGINT] ORDER BY v DESC, pos DESC) AS c FROM placed WHERE pos >= 1 AND pos < n - 2 GROUP BY ALL),
p AS (SELECT variant, capacity, list_reduce(list_prepend([]::BIGINT[][], list_transform(c, lambda x: [x])), lambda s, x: CASE WHEN len(s) < 2 AND len(list_filter(s, lambda e: abs(e[1] - x[1][1]) <= 1)) = 0 THEN list_concat(s, x) ELSE s END) AS p FROM c),
e AS (SELECT variant, capacity, unnest(list_transform(p, lambda x: x[2])) AS event FROM p)
SELECT e.variant, e.capacity, o AS "offset", count(*) AS n_events, round(avg(hr), 9) AS mean FROM e, (SELECT unnest([-1, 0, 1, 2]) AS o) JOIN log ON log.variant = e.variant AND log.capacity = e.capacity AND log.slot = e.event + o GROUP BY ALL"""


@query(LOG + _EVENTS)
def event_study(spark: SparkSession, d: str) -> DataFrame:
    """Hit ratios around the slots of the most misses."""
    return analysis.event_study(_log(spark, d), "candidates", before=1, after=2, most=2, gap=1)


def _drawn_sql(draws: int, block: int) -> str:
    """Places of moving-block resamples, from a table s (k, n: each series and its length)."""
    return f"""drawn AS (SELECT k, n, d, b, floor(('0x' || substr(md5('7:' || d || ':' || b), 1, 8))::BIGINT / 4294967296.0 * greatest(1, n - {block} + 1))::BIGINT AS start FROM s, range({draws}) x(d), range(1000) y(b) WHERE b < ceil(n / {block})),
taken AS (SELECT k, d, least(start + o, n - 1) AS at FROM drawn, range({block}) z(o) WHERE b * {block} + o < n)"""


@query(LOG + f""", gain AS (SELECT a.capacity AS k, a.slot, a.hr AS a, b.hr AS b, row_number() OVER (PARTITION BY a.capacity ORDER BY a.slot) - 1 AS at FROM log a JOIN log b USING (capacity, slot) WHERE a.variant = 'static' AND b.variant = 'frozen'),
s AS (SELECT k, count(*) AS n FROM gain GROUP BY k), {_drawn_sql(500, 3)},
means AS (SELECT t.k, d, avg(a) - avg(b) AS delta, (avg(a) - avg(b)) / greatest(1e-12, 1 - avg(b)) AS rmr FROM taken t JOIN gain g ON g.k = t.k AND g.at = t.at GROUP BY t.k, d),
whole AS (SELECT k, count(*) AS n_slots, avg(a) - avg(b) AS delta, (avg(a) - avg(b)) / greatest(1e-12, 1 - avg(b)) AS rmr FROM gain GROUP BY k)
SELECT w.k AS capacity, any_value(n_slots) AS n_slots, {", ".join(f"round(any_value(w.{c}), 9) AS {c}, round(quantile_cont(m.{c}, 0.025), 9) AS {c}_low, round(quantile_cont(m.{c}, 0.975), 9) AS {c}_high" for c in ("delta", "rmr"))} FROM whole w JOIN means m USING (k) GROUP BY w.k""")
def bootstrap_gain(spark: SparkSession, d: str) -> DataFrame:
    found = analysis.bootstrap_gain(_log(spark, d), STATIC, BASELINE, block=3, draws=500)
    return found.select("capacity", "n_slots", *[F.round(f"{c}{end}", 9).alias(f"{c}{end}") for c in ("delta", "rmr") for end in ("", "_low", "_high")])


@query(LOG + f""", series AS (SELECT capacity AS k, slot, hr, row_number() OVER (PARTITION BY capacity ORDER BY slot) - 1 AS at FROM log WHERE variant = 'static'), s AS (SELECT k, count(*) AS n FROM series GROUP BY k), {_drawn_sql(500, 3)},
means AS (SELECT t.k, d, avg(hr) AS hr FROM taken t JOIN series g ON g.k = t.k AND g.at = t.at GROUP BY t.k, d)
SELECT k AS capacity, round((SELECT avg(hr) FROM series x WHERE x.k = means.k), 9) AS mean, round(quantile_cont(hr, 0.025), 9) AS low, round(quantile_cont(hr, 0.975), 9) AS high FROM means GROUP BY k""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    found = compare.bootstrap_interval(_log(spark, d).where("variant = 'static'"), "hr", "capacity")
    return found.select("capacity", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


_MISSES = LOG + ", v AS (SELECT variant, capacity, slot, round(1 - hr, 9) AS x, row_number() OVER (PARTITION BY variant, capacity ORDER BY slot) AS i FROM log)"
_NEXT = "FROM g JOIN v ON v.variant = g.variant AND v.capacity = g.capacity AND v.i = g.i + 1"


def _misses(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).withColumn("miss", F.round(1 - F.col("hr"), 9))


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", F.round("score", 6))


@query(_MISSES + f""", f AS (WITH RECURSIVE g AS (SELECT variant, capacity, slot, i, 0.3 * x AS ema, 0.3 * x AS mean, 0.0::DOUBLE AS var FROM v WHERE i = 1
  UNION ALL SELECT variant, capacity, slot, i, e, m, 0.9 * var + 0.1 * (e - m) ** 2 FROM (SELECT *, 0.9 * mean + 0.1 * e AS m FROM (SELECT v.variant, v.capacity, v.slot, v.i, 0.3 * v.x + 0.7 * g.ema AS e, g.mean, g.var {_NEXT}))) SELECT * FROM g)
SELECT variant, capacity, slot, round(1 / (1 + exp(-greatest(-3, least(3, (ema - mean) / (sqrt(var) + 1e-6))))), 6) AS score FROM f""")
def drift_scores(spark: SparkSession, d: str) -> DataFrame:
    """The normalised drift score of each run's miss ratios."""
    return _rounded(sequential.drift_scores(_misses(spark, d), "miss", analysis.RUN))


@query(_MISSES + f""", f AS (WITH RECURSIVE g AS (SELECT variant, capacity, slot, i, x AS mean, 0.0::DOUBLE AS var, 0.0::DOUBLE AS score FROM v WHERE i = 1
  UNION ALL SELECT variant, capacity, slot, i, m, w, least(2.5, greatest(0, (x - m) / sqrt(w + 1e-12))) / 2.5 FROM (SELECT v.variant, v.capacity, v.slot, v.i, v.x, g.mean + 0.1 * (v.x - g.mean) AS m, 0.9 * g.var + 0.1 * (v.x - g.mean) ** 2 AS w {_NEXT})) SELECT * FROM g)
SELECT variant, capacity, slot, round(score, 6) AS score FROM f""")
def one_sided_drift(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(sequential.one_sided_scores(_misses(spark, d), "miss", analysis.RUN))


@query(_MISSES + """, e AS (SELECT *, x - avg(x) OVER w - 0.005 AS e FROM v WINDOW w AS (PARTITION BY variant, capacity ORDER BY slot ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, sum(e) OVER (PARTITION BY variant, capacity ORDER BY slot ROWS UNBOUNDED PRECEDING) AS t FROM e),
p AS (SELECT *, (t - least(0, min(t) OVER (PARTITION BY variant, capacity ORDER BY slot ROWS UNBOUNDED PRECEDING))) / 0.05 AS p FROM t)
SELECT variant, capacity, slot, round(least(1, p), 6) AS score, p > 1 AS alarm FROM p""")
def page_hinkley(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(sequential.page_hinkley(_misses(spark, d), "miss", analysis.RUN, threshold=0.05))


_SPLITS = "list_transform(range(2, len(k) - 1), lambda c: abs(list_avg(k[1:c]) - list_avg(k[c + 1:])) / sqrt(0.5 * ln(2 / 0.9) * (1 / c + 1 / (len(k) - c))))"


@query(_MISSES + f""", f AS (WITH RECURSIVE g AS (SELECT variant, capacity, slot, i, [x] AS kept, 0.0::DOUBLE AS top FROM v WHERE i = 1
  UNION ALL SELECT variant, capacity, slot, i, CASE WHEN cut > 0 THEN k[cut + 2:] ELSE k END, coalesce(list_max(CASE WHEN cut > 0 THEN gaps[1:cut] ELSE gaps END), 0)
  FROM (SELECT *, coalesce(list_position(list_transform(gaps, lambda y: y > 1), true), 0) AS cut FROM (SELECT *, {_SPLITS} AS gaps FROM (SELECT v.variant, v.capacity, v.slot, v.i, list_append(g.kept, v.x) AS k {_NEXT})))) SELECT * FROM g)
SELECT variant, capacity, slot, round(least(1, top), 6) AS score FROM f""")
def adaptive_window(spark: SparkSession, d: str) -> DataFrame:
    """With a loose bound and short sides, since a run here has few slots."""
    return _rounded(sequential.adaptive_window_scores(_misses(spark, d), "miss", analysis.RUN, delta=0.9, least=2))


WEIGHTS = q.NSE + """, held AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY created) AS place, weight / sum(weight) OVER (PARTITION BY slot) AS share FROM nse_weight),
moved AS (SELECT coalesce(a.slot, b.slot + 1) AS slot, sum(abs(coalesce(a.share, 0) - coalesce(b.share, 0))) AS l1, count(a.share) AS n, count(b.share) AS m FROM held a FULL JOIN held b ON a.slot = b.slot + 1 AND a.place = b.place GROUP BY 1),
changes AS (SELECT s.slot, s.n_members, s.mean, s.deviation, s.least, s.greatest, s.frozen, CASE WHEN m > 0 THEN l1 END AS l1_change FROM (
  SELECT slot, count(*) AS n_members, avg(weight) AS mean, stddev_pop(weight) AS deviation, min(weight) AS least, max(weight) AS greatest, avg((weight <= 1e-6)::INT) AS frozen FROM nse_weight GROUP BY slot) s LEFT JOIN moved ON moved.slot = s.slot AND moved.n > 0)"""
_CHANGES = ("mean", "deviation", "least", "greatest", "frozen", "l1_change")


def _changes(spark: SparkSession, fitted: ensemble.Ensembles) -> DataFrame:
    return analysis.weight_changes(fitted.weight_table(spark))


@query(WEIGHTS + " SELECT slot, n_members, " + ", ".join(f"round({c}, 6) AS {c}" for c in _CHANGES) + " FROM changes")
def weight_changes(spark: SparkSession, d: str) -> DataFrame:
    found = _changes(spark, ensemble.fit_ensembles(q._vector_rows(spark, d), q.FEATURES))
    return found.select("slot", "n_members", *[F.round(c, 6).alias(c) for c in _CHANGES])


@query(q.NSE + " SELECT slot, n_members, n, n_wrong FROM nse_error")
def vote_errors(spark: SparkSession, d: str) -> DataFrame:
    """How often the ensemble's vote on a slot's training rows is wrong, before it learns from them."""
    return ensemble.fit_ensembles(q._vector_rows(spark, d), q.FEATURES).error_table(spark)


_DRIFT = q._PAIRS.format(key="object_id", of="objects").replace("pairs AS", "moves AS").replace("FROM pairs", "FROM moves").replace("sums AS", "drifts AS")
_SIGNALS = [("error", "drift"), ("error", "tv"), ("l1_change", "drift"), ("frozen", "drift")]


@query(WEIGHTS + f""", t AS (SELECT slot, object_id FROM top WHERE y = 1), size_of AS (SELECT slot, count(*) AS n FROM t GROUP BY 1), kept AS (SELECT a.slot, count(*) AS n FROM t a JOIN t b ON a.slot = b.slot + 1 AND a.object_id = b.object_id GROUP BY 1),
{_DRIFT},
signals AS (SELECT s.slot, round(1 - round(coalesce(k.n, 0) / (s.n + p.n - coalesce(k.n, 0)), 9), 9) AS drift, round(tv, 9) AS tv, round(n_wrong / e.n, 9) AS error, round(l1_change, 9) AS l1_change, round(frozen, 9) AS frozen
  FROM size_of s JOIN size_of p ON s.slot = p.slot + 1 LEFT JOIN kept k ON k.slot = s.slot JOIN drifts r ON r.slot = s.slot JOIN nse_error e ON e.slot = s.slot AND e.n_members > 0 JOIN changes c ON c.slot = s.slot),
pair_of AS ({" UNION ALL ".join(f"SELECT '{a}/{b}' AS pair, {a} AS x, {b} AS y FROM signals WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _SIGNALS)}),
rank_of AS (SELECT *, rank() OVER (PARTITION BY pair ORDER BY x) + (count(*) OVER (PARTITION BY pair, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY pair ORDER BY y) + (count(*) OVER (PARTITION BY pair, y) - 1) / 2 AS ry FROM pair_of)
SELECT pair, CASE WHEN stddev_pop(x) * stddev_pop(y) > 0 THEN round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) END AS pearson, CASE WHEN stddev_pop(rx) * stddev_pop(ry) > 0 THEN round(covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)), 6) END AS spearman FROM rank_of GROUP BY pair""")
def drift_and_error(spark: SparkSession, d: str) -> DataFrame:
    """Spearman of identity drift and of the ensemble's error, the change of its weights and their frozen share."""
    top, fitted = q._top(spark, d), ensemble.fit_ensembles(q._vector_rows(spark, d), q.FEATURES)
    moved = labels.churn(top).select("slot", F.round(1 - F.col("jaccard"), 9).alias("drift")).join(drift.slot_drift(req.slot_objects(event_trace(spark, d))).select("slot", "tv"), "slot")
    errors = fitted.error_table(spark).where("n_members > 0").select("slot", F.round(F.col("n_wrong") / F.col("n"), 9).alias("error"))
    changes = _changes(spark, fitted).select("slot", F.round("l1_change", 9).alias("l1_change"), F.round("frozen", 9).alias("frozen"))
    signals = moved.join(errors, "slot").join(changes, "slot")
    pair = F.explode(F.array(*[F.struct(F.lit(f"{a}/{b}").alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in _SIGNALS])).alias("s")
    return labels.correlations(signals.select(pair).select("s.*").where("x is not null and y is not null"), "x", "y", "pair")


_RAW = [*[f"g{i}" for i in range(1, 7)], *q.HISTORY]
_SEEN = [*[f"CASE WHEN g{i} <> 1e6 THEN g{i} END" for i in range(1, 7)], *q.HISTORY]


def _view_sql(learner: str, view: str) -> str:
    """Scores of a learner's ensembles for objects at their last or first request of a slot, and their metrics of all objects and of the cold ones."""
    values = [e if view == "last" or "g" not in e else re.sub(r"\bg(\d)", r"first_g\1", e) for e in (_RAW if learner == "nb" else _SEEN)]
    n, t = learner, f"{learner}_{view}"
    part = "SELECT slot, score, y, first_seq, 'all' AS segment FROM {0} UNION ALL SELECT slot, score, y, first_seq, 'cold' FROM {0} WHERE hist_len <= 1"
    return f"""{t}_x AS (SELECT slot, object_id, unnest(range(10)) AS f, unnest([{', '.join(f'({v})::DOUBLE' for v in values)}]) AS x FROM d),
{t}_margin AS (SELECT x.slot, x.object_id, any_value(w.weight) AS w, any_value(prior) + coalesce(sum(0.5 * (ln(v0 / v1) + ((x - m0) ** 2 / v0 - (x - m1) ** 2 / v1))), 0) AS margin
  FROM {t}_x x JOIN {n}_weight w ON w.slot = x.slot - 1 JOIN {n}_member11 m ON m.created = w.created AND m.f = x.f GROUP BY x.slot, x.object_id, w.created),
{t}_score AS (SELECT slot, object_id, round(sum(w / (1 + exp(greatest(-700, least(700, -margin))))) / sum(w), 9) AS score FROM {t}_margin GROUP BY ALL),
{t} AS (SELECT d.slot, coalesce(score, 0.5) AS score, y, first_seq, {view}_hist_len AS hist_len FROM d LEFT JOIN {t}_score USING (slot, object_id)),
{t}_r AS (SELECT *, rank() OVER (PARTITION BY slot, segment ORDER BY score) + (count(*) OVER (PARTITION BY slot, segment, score) - 1) / 2 AS r, row_number() OVER o AS place, sum(y) OVER (o ROWS UNBOUNDED PRECEDING) AS hits, sum(y) OVER (PARTITION BY slot, segment) AS k
  FROM ({part.format(t)}) WINDOW o AS (PARTITION BY slot, segment ORDER BY score DESC, first_seq)),
{t}_m AS (SELECT '{learner}' AS learner, '{view}' AS view, segment, slot, count(*) AS n, sum(y)::BIGINT AS pos, round(CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) ELSE 'NaN'::DOUBLE END, 9) AS auc,
  round(sum(CASE WHEN y = 1 THEN hits / place END) / nullif(sum(y), 0), 9) AS ap, round(sum(CASE WHEN place <= k THEN y ELSE 0 END) / nullif(max(k), 0), 9) AS prec_at_k FROM {t}_r GROUP BY slot, segment)"""


_VIEWS = [(learner, view) for learner in ("nb", "nb_missing") for view in ("last", "first")]


@query(q.LEARNT + ", " + ensemble_sql(_RAW, "nb") + ", " + ensemble_sql(_SEEN, "nb_missing") + ", " + ",\n".join(_view_sql(*v) for v in _VIEWS) + " " + " UNION ALL ".join(f"SELECT * FROM {a}_{b}_m" for a, b in _VIEWS))
def offline_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Naive Bayes with the sentinel as a value against one that leaves missing gaps out: AP, AUC, precision at the number of
    positives, of features at objects' last and first requests of a slot, of all objects and of those with a history of 1 at most."""
    raw = written(q._features(spark, d).withColumnRenamed("hist_len", "last_hist_len"), "features")
    out = None
    for learner in ("nb", "nb_missing"):
        value = (lambda g: F.when(F.col(g) == req.SENTINEL, F.lit(float("nan"))).otherwise(F.col(g))) if learner == "nb_missing" else F.col
        rows = raw.withColumns({g: value(g) for g in q.GAP_NAMES})
        fitted = ensemble.fit_ensembles(rows, q.FEATURES, learner)
        for view in ("last", "first"):
            seen = rows if view == "last" else rows.withColumns({g: value(f"first_{g}") for g in q.GAP_NAMES})
            scores = ensemble.score_requests(seen.withColumn("seq", F.col("first_seq")), fitted, q.FEATURES).select("slot", "object_id", F.round("score", 9).alias("score"))
            scored = scores.join(rows.select("slot", "object_id", "first_seq", "y", f"{view}_hist_len"), ["slot", "object_id"])
            scored = written(scored, "scored")  # read once for each of the metrics' counts
            for segment, part in (("all", scored), ("cold", scored.where(f"{view}_hist_len <= 1"))):
                found = labels.score_metrics(part, None).select(F.lit(learner).alias("learner"), F.lit(view).alias("view"), F.lit(segment).alias("segment"), "slot", "n", "pos", "auc", "ap", "prec_at_k")
                out = found if out is None else out.unionByName(found)
    return out


@query(q.LEARNT + """, p AS (SELECT slot, y, CASE WHEN f_short > 0 THEN 1.0 ELSE 0.25 END AS w, [CASE WHEN g1 <> 1e6 THEN ln(1 + g1) END, CASE WHEN g2 <> 1e6 THEN ln(1 + g2) END, f_mid::DOUBLE] AS v FROM d),
x AS (SELECT slot, y, w, unnest(['g1', 'g2', 'f_mid']) AS f, unnest(v) AS x FROM p), z AS (SELECT * FROM x),
m AS (SELECT slot, y, f, sum(w) AS n, sum(CASE WHEN x IS NOT NULL THEN w END) AS t, sum(w * x) / sum(CASE WHEN x IS NOT NULL THEN w END) AS m FROM z GROUP BY ALL),
v AS (SELECT z.slot, z.y, z.f, any_value(n) AS n, coalesce(any_value(m), 0) AS m, greatest(coalesce(sum(w * (x - m) ** 2) / any_value(t), 1), 1e-9) AS v FROM z JOIN m ON z.slot = m.slot AND z.y = m.y AND z.f = m.f GROUP BY z.slot, z.y, z.f)
SELECT slot, y, max(n) AS n, """ + ", ".join(f"round(max({k}) FILTER (f = '{f}'), 4) AS {k}_{f}" for k in "mv" for f in ("g1", "g2", "f_mid")) + " FROM v GROUP BY slot, y")
def nb_fit_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Moments per slot and class, rows of objects not seen in the slot before counting a quarter, missing gaps left out."""
    names = ["g1", "g2", "f_mid"]
    rows = q._features(spark, d).withColumns({g: F.when(F.col(g) != req.SENTINEL, F.log1p(g)) for g in names[:2]})
    rows = rows.select("slot", "y", *[F.col(f).cast("double").alias(f) for f in names], F.when(F.col("f_short") > 0, 1.0).otherwise(0.25).alias("w"))
    return learn.weighted_moments(rows, ["slot", "y"], names, "w", missing=True).select("slot", "y", "n", *[F.round(f"{k}_{f}", 4).alias(f"{k}_{f}") for k in "mv" for f in names])


GAPS_LAST = q.GAPS_SQL + ", d AS (SELECT slot, object_id, y, l.hist_len AS hist_len, f_short, f_mid, f_long, f_cum, freq, " + ", ".join(f"l.g{i} AS g{i}" for i in range(1, 7)) + " FROM (SELECT slot, object_id, l FROM ends) JOIN history USING (slot, object_id) JOIN (SELECT slot, object_id, y FROM top) USING (slot, object_id))"


@query(GAPS_LAST + " SELECT slot, count(*) FILTER (hist_len < 6) AS n_cold, round(avg((hist_len < 6)::INT), 9) AS cold_share, round(avg(hist_len), 9) AS mean_hist_len, min(hist_len) AS least_hist_len, max(hist_len) AS most_hist_len FROM d GROUP BY slot")
def cold_start_stats(spark: SparkSession, d: str) -> DataFrame:
    return labels.cold_start(q._features(spark, d))


@query("SELECT slot, any_value(n_objects) AS n_objects, greatest(1, least(any_value(n_objects), ceil(0.05 * any_value(n_objects))))::INT AS by_share, greatest(1, least(any_value(n_objects), 250))::INT AS by_count FROM ranked GROUP BY slot")
def budget_sizes(spark: SparkSession, d: str) -> DataFrame:
    sizes = q._objects(spark, d).groupBy("slot").agg(F.count("*").alias("n_objects"))
    return sizes.select("slot", "n_objects", labels.budget_size(F.col("n_objects"), 0.05).alias("by_share"), labels.budget_size(F.col("n_objects"), 250).alias("by_count"))


_GAP_SUM = " + ".join(f"g{i}" for i in range(1, 7))


@query(GAPS_LAST + f" SELECT slot, object_id, round({_GAP_SUM}, 5) AS a0, round({_GAP_SUM}, 5) AS a1, (f_short + f_mid + f_long + f_cum)::DOUBLE AS a3, round({_GAP_SUM} + f_short, 5) AS a1_old, round({_GAP_SUM} + f_short + f_mid + f_long + f_cum + freq, 5) AS a3_old FROM d")
def feature_sets(spark: SparkSession, d: str) -> DataFrame:
    """The sums of the vectors of every feature set but A2, of either generation."""
    rows = q._features(spark, d)
    total = {k: F.aggregate(req.feature_vector(k), F.lit(0.0), lambda a, b: a + b) for k in ("A0", "A1", "A3", "A1-old", "A3-old")}
    return rows.select("slot", "object_id", *[F.round(v, 5).alias(k.lower().replace("-", "_")) for k, v in total.items()])


@query(GAPS_LAST + """ SELECT slot, object_id, round(ln(1 + freq) / ln(1 + 1000), 6) AS log_norm, round(ln(1 + freq), 6) AS log_freq, round(ln(1 + least(greatest(g1, 0), 1e6)), 6) AS log_gap, CASE WHEN g1 = 1e6 THEN 'NaN'::DOUBLE ELSE round(ln(1 + least(greatest(g1, 0), 1e6)), 6) END AS log_gap_or_nan FROM d""")
def transformed_features(spark: SparkSession, d: str) -> DataFrame:
    rows = q._features(spark, d)
    return rows.select("slot", "object_id", F.round(req.log_frequency(F.col("freq"), 1000), 6).alias("log_norm"), F.round(req.log_frequency(F.col("freq")), 6).alias("log_freq"), F.round(req.log_gap(F.col("g1")), 6).alias("log_gap"), F.round(req.log_gap(F.col("g1"), missing_as_nan=True), 6).alias("log_gap_or_nan"))


@query(GAPS_LAST + """ SELECT slot, y, round(avg(f_mid), 6) AS mean_f_mid, round(stddev_pop(f_mid), 5) AS std_f_mid, min(f_mid) AS min_f_mid, max(f_mid) AS max_f_mid, round(avg(hist_len), 6) AS mean_hist_len, round(stddev_pop(hist_len), 5) AS std_hist_len, min(hist_len) AS min_hist_len, max(hist_len) AS max_hist_len FROM d GROUP BY ALL""")
def feature_stats(spark: SparkSession, d: str) -> DataFrame:
    return labels.feature_stats(q._features(spark, d), ("f_mid", "hist_len"), 6, 5)


@query("SELECT slot, round(sum(CASE WHEN y = 1 THEN freq ELSE 0 END) / sum(freq), 9) AS top_share, round(avg(CASE WHEN y = 1 THEN freq END), 9) AS top_mean, round(quantile_cont(CASE WHEN y = 1 THEN freq END, 0.5), 9) AS top_p50, round(quantile_cont(CASE WHEN y = 1 THEN freq END, 0.9), 9) AS top_p90 FROM top GROUP BY slot")
def top_frequencies(spark: SparkSession, d: str) -> DataFrame:
    top = q._top(spark, d)
    popular = F.when(F.col("y") == 1, F.col("freq"))
    found = top.groupBy("slot").agg(F.round(F.sum(F.coalesce(popular, F.lit(0))) / F.sum("freq"), 9).alias("top_share"), F.round(F.avg(popular), 9).alias("top_mean"))
    middle = ranks.quantiles(top, popular, {"top_p50": 0.5, "top_p90": 0.9}, ["slot"])
    return found.join(middle.select("slot", *[F.round(k, 9).alias(k) for k in ("top_p50", "top_p90")]), "slot", "left")


@query(q.GAPS_SQL + """, u AS (UNPIVOT (SELECT slot, g1, g2, g3, g4, g5, g6 FROM gapped) ON g1, g2, g3, g4, g5, g6 INTO NAME gap VALUE v)
SELECT slot, gap, count(*) FILTER (v <> 1e6) AS n_real, round(avg(v) FILTER (v <> 1e6), 5) AS mean, round(quantile_cont(v, 0.5) FILTER (v <> 1e6), 5) AS p50, round(quantile_cont(v, 0.9) FILTER (v <> 1e6), 5) AS p90, round(max(v) FILTER (v <> 1e6), 5) AS most FROM u GROUP BY ALL""")
def gap_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return req.gap_dimensions(q._gapped(spark, d))


@query("SELECT slot, object_id, row_number() OVER (PARTITION BY slot ORDER BY md5('7:' || object_id || ':' || slot)) AS place FROM objects QUALIFY place <= 5")
def sampled_objects(spark: SparkSession, d: str) -> DataFrame:
    return labels.sample_objects(q._objects(spark, d), 5, 7)


@query("SELECT slot, object_id, freq, place FROM ranked WHERE place <= 20")
def top_objects(spark: SparkSession, d: str) -> DataFrame:
    return labels.top_objects(q._objects(spark, d), 20)


@query("SELECT seq, slot, seq + 1 AS counter, round(ln(1 + greatest(0, ts - min(ts) OVER (PARTITION BY slot))), 5) AS relative_log FROM trace")
def relative_times(spark: SparkSession, d: str) -> DataFrame:
    return req.relative_times(event_trace(spark, d)).select("seq", "slot", "counter", F.round("relative_log", 5).alias("relative_log"))


@query("SELECT slot, 'gmn' || slot || '_gmx' || (200 + slot) || '_sl2_sh' || (60 + slot) AS tag, slot / 1000 AS gate_min, (200 + slot) / 1000 AS gate_max, 2 / 1000 AS spread_low, (60 + slot) / 1000 AS spread_high FROM (SELECT DISTINCT slot FROM trace)")
def settings_tags(spark: SparkSession, d: str) -> DataFrame:
    """A tag for each slot's made-up settings, and the settings read back from it."""
    slots = event_trace(spark, d).select("slot").distinct()
    tagged = slots.withColumn("tag", encode_tag({"gate_min": F.col("slot") / 1000, "gate_max": (200 + F.col("slot")) / 1000, "spread_low": F.lit(0.002), "spread_high": (60 + F.col("slot")) / 1000}))
    return tagged.withColumns(decode_tag(F.col("tag")))
