"""Registered queries and their DuckDB counterparts.

The tables have no light curves, so series are events (by type or user; t in days since 2024-01-01, flux the value),
scores are shares a user, catalogues are lineitem and part, and vectors are embeddings. Results are rounded to six
decimals on both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..components import cut
from ..functions import exprs as X
from ..operators import cluster, embedding, forest, kernels, match, mixture, ranks, relational, series, subsets
from ..streaming import incremental
from .sqlfront import run_sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


FILE = "concat('obj-s0001-', lpad(cast({} as string), 16, '0'), '-0120-s_lc.fits')"
DAYS = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 86400000000D"
D_FILE = "'obj-s0001-' || lpad(CAST({} AS VARCHAR), 16, '0') || '-0120-s_lc.fits'"
D_DAYS = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0"


def scores(spark: SparkSession, d: str) -> DataFrame:
    """(tic, filename, p3, p9): shares of errors and of values above the 0.9 quantile, a user."""
    ev = table(spark, d, "events")
    q = ranks.quantiles(ev, "value", [0.9]).select(F.col("threshold").alias("q"))
    one = lambda c: F.avg(F.when(c, F.lit(1.0)).otherwise(F.lit(0.0)))
    out = ev.join(F.broadcast(q)).groupBy(F.col("user_id").alias("tic")).agg(one(F.col("event_type") == "error").alias("p3"), one(F.col("value") > F.col("q")).alias("p9"))
    return out.withColumn("filename", F.expr(FILE.format("tic")))


D_SCORES = f"""q AS (SELECT quantile_cont(value, 0.9) AS q FROM events),
s AS (SELECT user_id AS tic, {D_FILE.format('user_id')} AS filename,
  avg(CASE WHEN event_type = 'error' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS p3,
  avg(CASE WHEN value > q THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS p9 FROM events, q GROUP BY user_id)"""
D_FUSED = f"""{D_SCORES},
w AS (SELECT tic, filename, p3, p9, 0.8 * sqrt(p3) + 0.2 * sqrt(p9) AS raw FROM s WHERE p3 > 0 AND p9 > 0),
e AS (SELECT min(raw) AS lo, max(raw) AS hi FROM w),
f AS (SELECT tic, filename, p3, p9, raw, CASE WHEN hi > lo THEN (raw - lo) / (hi - lo) ELSE 0 END AS norm FROM w, e)"""


def fused(spark, d):
    s = cut(scores(spark, d))  # both sides of the fusion
    return relational.fuse_scores(s.select("tic", "filename", F.col("p3").alias("anomaly_score")), s.select("tic", "filename", F.col("p9").alias("anomaly_score")))


FUSED_COLS = ["anomaly_score_p3", "anomaly_score_p9", "score_weighted_root_sum", "score_weighted_root_sumnorm"]
D_FUSED_COLS = "round(p3, 6) AS anomaly_score_p3, round(p9, 6) AS anomaly_score_p9, round(raw, 6) AS score_weighted_root_sum, round(norm, 6) AS score_weighted_root_sumnorm"


@query(f"WITH {D_FUSED} SELECT tic AS tic_p3, filename, tic AS tic_p9, {D_FUSED_COLS} FROM f")
def wrss_fusion(spark, d):
    return fused(spark, d).select("tic_p3", "filename", "tic_p9", *r6(*FUSED_COLS))


@query(f"WITH {D_FUSED} SELECT filename, round(norm, 6) AS score FROM f WHERE norm >= 0.35 ORDER BY round(norm, 6) DESC, filename LIMIT 20")
def wrss_top_filtered(spark, d):
    out = fused(spark, d).filter("score_weighted_root_sumnorm >= 0.35").select("filename", F.round("score_weighted_root_sumnorm", 6).alias("score"))
    return out.orderBy(F.desc("score"), "filename").limit(20)


@query(f"WITH {D_FUSED} SELECT filename, round(norm, 6) AS score FROM f WHERE norm > 0.2 AND p3 < 0.5")
def sql_front_select(spark, d):
    return run_sql(fused(spark, d), "SELECT filename, round(score_weighted_root_sumnorm, 6) AS score FROM input_df WHERE score_weighted_root_sumnorm > 0.2 AND anomaly_score_p3 < 0.5")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type HAVING count(*) > 1")
def sql_front_aggregate(spark, d):
    return run_sql(table(spark, d, "events"), "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM input_df GROUP BY event_type HAVING count(*) > 1")


@query("SELECT o_orderkey, round(o_totalprice, 6) AS price FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)")
def sql_front_subquery(spark, d):
    return run_sql(table(spark, d, "orders"), "SELECT o_orderkey, round(o_totalprice, 6) AS price FROM input_df WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8D FROM input_df)")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%'")
def sql_front_like(spark, d):
    return run_sql(table(spark, d, "part"), "SELECT p_partkey, p_name FROM input_df WHERE p_name LIKE '%RING%'", compat=True)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sql_front_order_limit(spark, d):
    return run_sql(table(spark, d, "orders"), "SELECT o_orderkey, o_orderdate FROM input_df ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")


@query(f"WITH {D_SCORES} SELECT count(*) AS n, round(sum(p3), 6) AS total FROM s WHERE p3 > 0")
def score_nonzero(spark, d):
    return relational.positive(scores(spark, d), "p3").agg(F.count("*").alias("n"), F.round(F.sum("p3"), 6).alias("total"))


@query(f"WITH {D_SCORES} SELECT CASE WHEN tic % 7 <> 0 THEN tic END AS tic, filename, CASE WHEN tic % 7 <> 0 THEN round(p3, 6) END AS anomaly_score FROM s")
def score_null_failures(spark, d):
    """One row an object; a failed one keeps its name and has nulls."""
    ok = F.col("tic") % 7 != 0
    return scores(spark, d).select(F.when(ok, F.col("tic")).alias("tic"), "filename", F.when(ok, F.round("p3", 6)).alias("anomaly_score"))


@query(f"SELECT {D_FILE.format('user_id')} AS filename, user_id AS tic FROM (SELECT DISTINCT user_id FROM events)")
def id_from_filename(spark, d):
    return table(spark, d, "events").select(F.expr(FILE.format("user_id")).alias("filename")).distinct().withColumn("tic", X.object_id("filename"))


@query(
    """WITH v AS (SELECT p_partkey, 'm_n' || p_size || '_d' || (p_partkey % 40) || '.75_c' || (p_size % 5) || '_n' || (p_partkey % 90) || 'ppm' AS variant FROM part)
SELECT p_partkey, CAST(regexp_extract(variant, '_d([0-9.]+)_', 1) AS DOUBLE) AS duration_hr, CAST(regexp_extract(variant, '_c([0-9.]+)_', 1) AS DOUBLE) AS cadence_min, CAST(regexp_extract(variant, '_n([0-9.]+)ppm', 1) AS DOUBLE) AS noise_ppm FROM v"""
)
def variant_params(spark, d):
    v = table(spark, d, "part").withColumn("variant", F.expr("concat('m_n', p_size, '_d', p_partkey % 40, '.75_c', p_size % 5, '_n', p_partkey % 90, 'ppm')"))
    return v.select("p_partkey", X.variant_number("variant", "d").alias("duration_hr"), X.variant_number("variant", "c").alias("cadence_min"), X.variant_number("variant", "n", "ppm").alias("noise_ppm"))


LABELS = "element_at(array('Pl', 'Pl?', 'SB*', '**', '*', 'PM*', 'outlier', 'EB*', 'zz', 'LM*'), label + 1)"
D_LABEL = "(['Pl', 'Pl?', 'SB*', '**', '*', 'PM*', 'outlier', 'EB*', 'zz', 'LM*'])[label + 1]"
D_GROUP = "CASE WHEN {0} IN ('Pl','Pl?','BD*','s*b') THEN 'planet_like' WHEN {0} IN ('SB*','**','EB*','LM*') THEN 'binary_star' WHEN {0} IN ('*','PM*','Er*') THEN 'stellar' WHEN {0} IN ('outlier','err') THEN 'outlier' ELSE 'unclassified' END"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("filename"), F.col("embedding").cast("array<double>").alias("vec"), F.expr(LABELS).alias("label"), F.col("label").alias("k"))


def grouped_vectors(spark, d):
    return vectors(spark, d).select("filename", "label", X.label_group("label").alias("label_group"))


D_GV = f"gv AS (SELECT vec_id AS filename, {D_LABEL} AS label, {D_GROUP.format(D_LABEL)} AS label_group FROM embeddings)"


@query(f"WITH {D_GV} SELECT * FROM gv")
def label_group_map(spark, d):
    return grouped_vectors(spark, d)


@query(f"WITH {D_GV} SELECT * FROM gv WHERE label_group IN ('planet_like', 'binary_star')")
def group_filter_list(spark, d):
    return relational.filter_groups(grouped_vectors(spark, d), ["planet_like", "binary_star"])


@query(f"WITH {D_GV} SELECT label_group, count(*) AS n FROM gv GROUP BY label_group")
def group_filter_all(spark, d):
    return relational.filter_groups(grouped_vectors(spark, d), "all").groupBy("label_group").agg(F.count("*").alias("n"))


@query(f"WITH {D_GV}, m AS (SELECT * FROM gv WHERE filename % 3 = 0) SELECT e.vec_id AS filename FROM embeddings e LEFT JOIN m ON m.filename = e.vec_id WHERE m.label_group IS NULL")
def group_filter_none(spark, d):
    rows = relational.attach(vectors(spark, d).select("filename"), grouped_vectors(spark, d).filter("filename % 3 = 0"))
    return relational.filter_groups(rows, "none").select("filename")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_subset(spark, d):
    big = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def anti_exclude(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("WITH l AS (SELECT c_name AS filename FROM customer ORDER BY c_name LIMIT 50 OFFSET 10) SELECT filename FROM l WHERE filename IN (SELECT c_name FROM customer WHERE c_nationkey < 12)")
def listing_slice(spark, d):
    c = table(spark, d, "customer")
    return relational.listing(c.select(F.col("c_name").alias("filename")), 10, 50, c.filter("c_nationkey < 12").select(F.col("c_name").alias("filename")))


@query(
    """WITH f AS (SELECT l_partkey, list_sort(list(l_orderkey)) AS entries FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey)
SELECT p_partkey, array_to_string(f.entries, ',') AS entries, coalesce(len(f.entries), 0) AS n_entries FROM part LEFT JOIN f ON l_partkey = p_partkey"""
)
def catalog_check(spark, d):
    cat = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey")
    out = relational.catalogue_check(table(spark, d, "part").select("p_partkey"), cat, "p_partkey", "l_orderkey")
    return out.select("p_partkey", F.array_join(F.col("entries").cast("array<string>"), ",").alias("entries"), "n_entries")


@query("SELECT p_partkey FROM part WHERE (CASE WHEN p_size % 9 = 0 THEN NULL ELSE (p_size % 13) || ',' || (p_partkey % 13) END) SIMILAR TO '(.*,)?1(,.*)?'")
def catalog_sector_match(spark, d):
    return table(spark, d, "part").withColumn("sectors", F.expr("if(p_size % 9 = 0, null, concat(p_size % 13, ',', p_partkey % 13))")).filter(X.in_sector("sectors", 1)).select("p_partkey")


@query("SELECT DISTINCT l_partkey AS tic FROM lineitem WHERE l_returnflag = 'R' ORDER BY tic")
def catalog_ids(spark, d):
    return table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("tic")).distinct().orderBy("tic")


FACTORS = ["snr", "depth", "hours"]
D_IMP = "imp AS (SELECT p_partkey AS id, max(l_quantity) * max(l_extendedprice) * max(l_discount) AS importance FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N' GROUP BY p_partkey)"


def importance_table(spark, d):
    rows = table(spark, d, "lineitem").filter("l_returnflag <> 'N'").groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_quantity").alias("snr"), F.max("l_extendedprice").alias("depth"), F.max("l_discount").alias("hours"))
    rows = rows.join(table(spark, d, "part").select(F.col("p_partkey").alias("id")), "id", "left_semi")
    return relational.importance(rows, FACTORS).select("id", "importance")


@query(f"WITH {D_IMP} SELECT id, round(importance, 4) AS importance FROM imp")
def importance_scores(spark, d):
    return importance_table(spark, d).select("id", F.round("importance", 4).alias("importance"))


@query(f"WITH {D_IMP}, e AS (SELECT min(importance) AS lo, max(importance) AS hi FROM imp) SELECT id, round(CASE WHEN hi > lo THEN (importance - lo) / (hi - lo) ELSE 0 END, 6) AS importance_norm FROM imp, e")
def importance_normalized(spark, d):
    return relational.normalise(importance_table(spark, d), "importance", "importance_norm").select("id", *r6("importance_norm"))


def events_series(spark, d, key="event_type"):
    return table(spark, d, "events").select(F.col(key).alias("key"), F.expr(DAYS).alias("t"), F.col("value").alias("flux"))


D_SER = f"ser AS (SELECT event_type AS key, {D_DAYS} AS t, value AS flux FROM events)"
D_USER = f"ser AS (SELECT user_id AS key, {D_DAYS} AS t, value AS flux FROM events)"


@query(f"WITH {D_USER} SELECT key, count(*) AS n, round(avg(flux), 6) AS mean, round(stddev_pop(flux), 6) AS std, round(median(flux), 6) AS median, round(min(t), 6) AS t_min, round(max(t), 6) AS t_max FROM ser GROUP BY key HAVING count(*) >= 50")
def series_stats(spark, d):
    return series.stats(events_series(spark, d, "user_id"), "key", 50).select("key", "n", *r6("mean", "std", "median", "t_min", "t_max"))


def _z(center: str) -> str:
    return f"WITH {D_USER}, m AS (SELECT key, {center}(flux) AS c, stddev_pop(flux) AS s FROM ser GROUP BY key) SELECT key, round(t, 6) AS t, round(CASE WHEN s > 0 THEN (flux - c) / s ELSE 0 END, 6) AS z FROM ser JOIN m USING (key)"


@query(_z("avg"))
def series_zscore(spark, d):
    return series.zscore(events_series(spark, d, "user_id"), "key").select("key", *r6("t", "z"))


@query(_z("median"))
def series_robust_zscore(spark, d):
    return series.zscore(events_series(spark, d, "user_id"), "key", robust=True).select("key", *r6("t", "z"))


GRID_N = 1000
D_GRID = f"grid AS (SELECT i, pow(10.0, log10(1.0 / 27.0) + i * (log10(6.0) - log10(1.0 / 27.0)) / {GRID_N - 1}.0) AS f FROM range({GRID_N}) AS g(i))"
D_POWER = """pt AS (SELECT key, i, f, flux AS y, cos(2 * pi() * f * t) AS c, sin(2 * pi() * f * t) AS s FROM ser, grid),
m AS (SELECT key, i, f, avg(y) AS ym, avg(c) AS cm, avg(s) AS sm, avg(y*y) AS yy, avg(y*c) AS yc, avg(y*s) AS ys, avg(c*c) AS cc, avg(s*s) AS ss, avg(c*s) AS cs FROM pt GROUP BY key, i, f),
v AS (SELECT key, i, f, yy-ym*ym AS a, yc-ym*cm AS b, ys-ym*sm AS e, cc-cm*cm AS g, ss-sm*sm AS h, cs-cm*sm AS k FROM m),
power AS (SELECT key, i, f, (h*b*b + g*e*e - 2*k*b*e) / (a*(g*h - k*k)) AS power FROM v)"""


def log_grid(spark, n=GRID_N):
    return spark.range(1).select(F.posexplode(X.log_grid(1 / 27, 6.0, n)).alias("i", "f"))


@query(f"WITH {D_SER}, {D_GRID}, {D_POWER} SELECT key, CAST(i AS INTEGER) AS i, round(f, 6) AS f, round(power, 6) AS power FROM power")
def periodogram_grid(spark, d):
    return series.periodogram(events_series(spark, d), "key", log_grid(spark)).select("key", "i", *r6("f", "power"))


D_PEAK = """best AS (SELECT key, 1.0 / f AS best_period, p AS peak_power FROM (SELECT key, f, round(power, 9) AS p, row_number() OVER (PARTITION BY key ORDER BY round(power, 9) DESC, i) AS rn FROM power) WHERE rn = 1)"""


@query(f"WITH {D_SER}, {D_GRID}, {D_POWER}, {D_PEAK} SELECT key, round(best_period, 6) AS best_period, round(peak_power, 6) AS peak_power FROM best")
def periodogram_peak(spark, d):
    return series.best_period(series.periodogram(events_series(spark, d), "key", log_grid(spark)), "key").select("key", *r6("best_period", "peak_power"))


PERIOD = 3.7


def folded(spark, d, key="event_type"):
    ser = events_series(spark, d, key)
    return series.fold(ser, "key", ser.select("key").distinct().withColumn("best_period", F.lit(PERIOD)))


D_FOLD = """zs AS (SELECT key, avg(flux) AS c, stddev_pop(flux) AS s FROM ser GROUP BY key),
fold AS (SELECT key, t, (t % 3.7) / 3.7 AS phase, (flux - c) / s AS z FROM ser JOIN zs USING (key)),
ends AS (SELECT key, min(phase) AS lo, max(phase) AS hi FROM fold GROUP BY key),
every AS (SELECT key, CAST(b AS INTEGER) AS bin, lo, hi FROM ends, range(1, 41) AS r(b)),
bm AS (SELECT key, least(CAST(floor((phase - lo) / ((hi - lo) / 40)) AS INTEGER) + 1, 40) AS bin, avg(z) AS mean, count(*) AS points FROM fold JOIN ends USING (key) GROUP BY 1, 2),
bins AS (SELECT key, bin, lo + (bin - 0.5) * (hi - lo) / 40 AS center, mean, coalesce(points, 0) AS points FROM every LEFT JOIN bm USING (key, bin))"""


@query(f"WITH {D_SER}, {D_FOLD} SELECT key, round(t, 6) AS t, round(phase, 6) AS phase, round(z, 6) AS z FROM fold")
def phase_fold_points(spark, d):
    return folded(spark, d).select("key", *r6("t", "phase", "z"))


@query(f"WITH {D_SER}, {D_FOLD} SELECT key, bin, round(center, 6) AS center, round(mean, 6) AS mean, points FROM bins")
def phase_fold_bins(spark, d):
    return series.bins(folded(spark, d), "key", 40).select("key", "bin", *r6("center", "mean"), "points")


@query(
    f"""WITH {D_SER}, {D_FOLD}, st AS (SELECT key, avg(mean) AS c, stddev_pop(mean) AS s FROM bins GROUP BY key)
SELECT key, bin, round((mean - c) / s, 6) AS x FROM bins JOIN st USING (key) WHERE key NOT IN (SELECT key FROM bins WHERE mean IS NULL)"""
)
def bin_means_features(spark, d):
    v = series.bin_vector(series.bins(folded(spark, d), "key", 40), "key").filter("is_valid")
    return v.select("key", F.posexplode("vec").alias("bin", "x")).select("key", (F.col("bin") + 1).alias("bin"), *r6("x"))


@query(
    f"""WITH {D_SER}, {D_FOLD},
q AS (SELECT key, min(mean) AS low, median(mean) AS mid, quantile_cont(mean, 0.8) AS p80 FROM bins GROUP BY key HAVING count(*) = count(mean)),
a AS (SELECT key, max(low - mid) AS depth, CASE WHEN sum(CASE WHEN mean < (mid + low) / 2 THEN 1 ELSE 0 END) >= 2 THEN max(CASE WHEN mean < (mid + low) / 2 THEN center END) - min(CASE WHEN mean < (mid + low) / 2 THEN center END) ELSE 0 END AS width,
  stddev_pop(CASE WHEN mean > p80 THEN mean END) AS baseline_std FROM bins JOIN q USING (key) GROUP BY key),
s AS (SELECT x.key, avg(abs(x.mean - y.mean)) AS asymmetry FROM bins x JOIN bins y ON x.key = y.key AND y.bin = 41 - x.bin WHERE x.bin <= 20 GROUP BY x.key)
SELECT key, round(depth, 6) AS depth, round(width, 6) AS width, round(baseline_std, 6) AS baseline_std, round(asymmetry, 6) AS asymmetry FROM a JOIN s USING (key)"""
)
def shape_features(spark, d):
    return series.shape(series.bins(folded(spark, d), "key", 40), "key").select("key", *r6("depth", "width", "baseline_std", "asymmetry"))


@query(
    f"""WITH {D_SER}, {D_FOLD},
zb AS (SELECT key, bin, CASE WHEN stddev_pop(mean) OVER (PARTITION BY key) > 0 THEN (mean - avg(mean) OVER (PARTITION BY key)) / stddev_pop(mean) OVER (PARTITION BY key) ELSE 0 * mean END AS mean FROM bins),
ac AS (SELECT a.key, b.bin - a.bin AS lag, CASE WHEN b.bin - a.bin = 1 THEN 0 ELSE sum(a.mean * b.mean) END AS ac FROM zb a JOIN zb b ON a.key = b.key AND b.bin > a.bin GROUP BY a.key, b.bin - a.bin),
pk AS (SELECT key, lag, ac, lag(ac) OVER (PARTITION BY key ORDER BY lag) AS p, lead(ac) OVER (PARTITION BY key ORDER BY lag) AS n FROM ac),
f AS (SELECT key, min(lag) AS lag FROM pk WHERE ac > p AND ac > n GROUP BY key)
SELECT k.key, round(coalesce(pk.ac, 0), 6) AS autocorr_strength FROM (SELECT DISTINCT key FROM ac) k LEFT JOIN f ON f.key = k.key LEFT JOIN pk ON pk.key = k.key AND pk.lag = f.lag"""
)
def autocorrelation_peak(spark, d):
    return series.autocorrelation_peak(series.autocorrelation(series.bins(folded(spark, d), "key", 40), "key"), "key").select("key", *r6("autocorr_strength"))


@query(f"WITH {D_USER}, {D_FOLD} SELECT key, count(*) AS bins, sum(CASE WHEN points = 0 THEN 1 ELSE 0 END) AS empty_bins FROM bins GROUP BY key")
def fold_empty_bins(spark, d):
    return series.bins(folded(spark, d, "user_id"), "key", 40).groupBy("key").agg(F.count("*").alias("bins"), F.count_if(F.col("points") == 0).alias("empty_bins"))


@query()
def object_features(spark, d):
    """Periodogram peaks and box search, by numpy kernels a series."""
    return kernels.object_features(events_series(spark, d), "key")


D_VEC = f"""{D_SER}, {D_FOLD}, st AS (SELECT key, avg(mean) AS c, stddev_pop(mean) AS s FROM bins GROUP BY key HAVING count(*) = count(mean)),
x AS (SELECT key, bin, (mean - c) / s AS x FROM bins JOIN st USING (key))"""


@query(
    f"""WITH {D_SER}, {D_FOLD}, x AS (SELECT key, bin, mean AS x FROM bins WHERE key NOT IN (SELECT key FROM bins WHERE mean IS NULL)),
g AS (SELECT k, exp(-k * k / CAST(18 AS DOUBLE)) / (SELECT sum(exp(-j * j / CAST(18 AS DOUBLE))) FROM range(-12, 13) AS r(j)) AS w FROM range(-12, 13) AS r(k)),
sm AS (SELECT a.key, a.bin, sum(w * b.x) AS s FROM x a, g JOIN x b ON b.key = a.key AND b.bin = CASE WHEN a.bin + k < 1 THEN 1 - (a.bin + k) WHEN a.bin + k > 40 THEN 81 - (a.bin + k) ELSE a.bin + k END GROUP BY a.key, a.bin),
lo AS (SELECT key, arg_min(bin, s) AS bin FROM sm GROUP BY key)
SELECT lo.key, round(CASE WHEN lo.bin > 3 AND lo.bin < 38 THEN (SELECT sum(CASE WHEN sm.bin = lo.bin THEN -2 * s ELSE s END) FROM sm WHERE sm.key = lo.key AND abs(sm.bin - lo.bin) <= 1) ELSE 0 END, 6) AS sharpness FROM lo"""
)
def sharpness(spark, d):
    v = series.bin_means(series.bins(folded(spark, d), "key", 40), "key")
    return kernels.sharpness_of(v.filter("vec is not null"), "key").select("key", *r6("sharpness"))


@query(f"WITH {D_USER}, {D_GRID}, {D_POWER} SELECT key, CAST(4000 AS INTEGER) AS size, round(max(power), 6) AS peak FROM power GROUP BY key")
def flux_power_stack(spark, d):
    return match.flux_power_stack(events_series(spark, d, "user_id"), "key").select("key", F.size("vec").alias("size"), F.round(F.array_max(F.slice("vec", 3001, 1000)), 6).alias("peak"))


@query(
    f"""WITH RECURSIVE {D_VEC}, l AS (SELECT key, list(x ORDER BY bin) AS v FROM x GROUP BY key),
rows AS (SELECT a.key AS a, b.key AS b, a.v AS v, b.v AS w, 0 AS i, list_transform(range(1, 41), lambda j: CAST('inf' AS DOUBLE)) AS d FROM l a JOIN l b ON a.key < b.key
UNION ALL SELECT a, b, v, w, i + 1, list_slice(list_reduce(range(1, 41), lambda acc, j: list_append(acc, pow(v[i + 1] - w[j], 2) + CASE WHEN i = 0 AND j = 1 THEN 0 ELSE least(d[j], CASE WHEN j > 1 THEN d[j - 1] ELSE CAST('inf' AS DOUBLE) END, acc[len(acc)]) END), [CAST('inf' AS DOUBLE)]), 2, 41) FROM rows WHERE i < 40)
SELECT a, b, round(sqrt(d[40]), 6) AS dist FROM rows WHERE i = 40"""
)
def dtw_pairs(spark, d):
    out = kernels.dtw_pairs(series.bin_vector(series.bins(folded(spark, d), "key", 40), "key").filter("is_valid"), "key")
    return out.select("a", "b", *r6("dist"))


D_GROUPS = f"ser AS (SELECT event_type || '-' || CAST(user_id % 4 AS VARCHAR) AS key, {D_DAYS} AS t, value AS flux FROM events)"
D_WARP = f"""{D_GROUPS}, {D_FOLD}, st AS (SELECT key, avg(mean) AS c, stddev_pop(mean) AS s FROM bins GROUP BY key HAVING count(*) = count(mean) AND stddev_pop(mean) > 0),
x AS (SELECT key, bin, (mean - c) / s AS x FROM bins JOIN st USING (key)), l AS (SELECT key, list(x ORDER BY bin) AS v FROM x GROUP BY key),
rows AS (SELECT a.key AS a, b.key AS b, a.v AS v, b.v AS w, 0 AS i, list_transform(range(1, 41), lambda j: CAST('inf' AS DOUBLE)) AS d FROM l a JOIN l b ON a.key < b.key
UNION ALL SELECT a, b, v, w, i + 1, list_slice(list_reduce(range(1, 41), lambda acc, j: list_append(acc, pow(v[i + 1] - w[j], 2) + CASE WHEN i = 0 AND j = 1 THEN 0 ELSE least(d[j], CASE WHEN j > 1 THEN d[j - 1] ELSE CAST('inf' AS DOUBLE) END, acc[len(acc)]) END), [CAST('inf' AS DOUBLE)]), 2, 41) FROM rows WHERE i < 40),
warp AS (SELECT a, b, sqrt(d[40]) AS dist FROM rows WHERE i = 40)"""
#: Warping distances within which folds of events by type and user group are near each other.
WARP_EPS = 4.4


def warp_vectors(spark, d):
    """(key, vec): folds of the events by type and user modulo 4, in 40 bins, z-scored."""
    key = F.concat("event_type", F.lit("-"), (F.col("user_id") % 4).cast("string"))
    rows = table(spark, d, "events").select(key.alias("key"), F.expr(DAYS).alias("t"), F.col("value").alias("flux"))
    periods = rows.select("key").distinct().withColumn("best_period", F.lit(3.7))
    return series.bin_vector(series.bins(series.fold(rows, "key", periods), "key", 40), "key").filter("is_valid").select("key", "vec")


@query(f"WITH RECURSIVE {D_WARP} SELECT a, b, round(dist, 6) AS dist FROM warp WHERE dist <= {WARP_EPS}")
def dtw_near(spark, d):
    """Pairs within a warping distance, by bounds and early ends."""
    return kernels.dtw_pairs(warp_vectors(spark, d), "key", limit=WARP_EPS).select("a", "b", *r6("dist"))


@query(
    f"""WITH RECURSIVE {D_WARP},
near AS (SELECT key AS a, key AS b FROM l UNION SELECT a, b FROM warp WHERE dist <= {WARP_EPS} UNION SELECT b, a FROM warp WHERE dist <= {WARP_EPS}),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 3),
ce AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
walk AS (SELECT id AS root, id AS id FROM core UNION SELECT walk.root, ce.b FROM walk JOIN ce ON ce.a = walk.id),
roots AS (SELECT id, min(root) AS root FROM walk GROUP BY id),
numbered AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS label FROM roots),
border AS (SELECT near.a AS id, min(numbered.label) AS label FROM near JOIN numbered ON near.b = numbered.id GROUP BY near.a)
SELECT l.key AS id, CAST(coalesce(numbered.label, border.label, -1) AS INTEGER) AS label FROM l LEFT JOIN numbered ON numbered.id = l.key LEFT JOIN border ON border.id = l.key"""
)
def dtw_dbscan(spark, d):
    """Density clusters over warping distances."""
    v = cut(warp_vectors(spark, d))
    return cluster.cluster_distances(kernels.dtw_pairs(v, "key", limit=WARP_EPS), v.select(F.col("key").alias("id")), "dbscan", eps=WARP_EPS, min_samples=3)


@query()
def hdbscan_labels(spark, d):
    """Hierarchical density clusters of the vectors' first three components; tested against a plain version."""
    return cluster.cluster_features(points(spark, d), "hdbscan", "none", min_cluster_size=10, min_samples=5)[0].select("id", "label")


@query()
def hdbscan_distances(spark, d):
    """Hierarchical density clusters over all warping distances; tested against a plain version."""
    v = cut(warp_vectors(spark, d))
    return cluster.cluster_distances(kernels.dtw_pairs(v, "key"), v.select(F.col("key").alias("id")), "hdbscan", min_cluster_size=3, min_samples=2)


@query(
    """WITH p AS (SELECT l_suppkey % 25 AS key, (l_orderkey % 1000) / 1000.0 AS phase, l_extendedprice AS flux, l_quantity AS mx, l_orderkey % 97 AS my, l_discount AS px, l_tax AS py FROM lineitem),
m AS (SELECT key, corr(flux, px) AS corr_x, corr(flux, py) AS corr_y,
  avg(CASE WHEN phase > 0.7 AND phase < 0.8 THEN mx END) - avg(CASE WHEN phase < 0.65 OR phase > 0.85 THEN mx END) AS delta_x,
  avg(CASE WHEN phase > 0.7 AND phase < 0.8 THEN my END) - avg(CASE WHEN phase < 0.65 OR phase > 0.85 THEN my END) AS delta_y,
  median(CASE WHEN phase < 0.65 OR phase > 0.85 THEN flux END) - median(CASE WHEN phase > 0.7 AND phase < 0.8 THEN flux END) AS dip FROM p GROUP BY key),
d AS (SELECT *, CASE WHEN dip < 0.0001 THEN 0.0001 ELSE dip END AS depth, greatest(abs(delta_x), abs(delta_y)) AS local_shift FROM m)
SELECT key, round(corr_x, 6) AS corr_x, round(corr_y, 6) AS corr_y, round(delta_x, 6) AS delta_x, round(delta_y, 6) AS delta_y, round(local_shift, 6) AS local_shift, round(depth, 6) AS depth,
  local_shift / depth > 0.5 AS multi_source FROM d"""
)
def centroid_shift(spark, d):
    """Suppliers in 25 groups, of which some have dips and some have bumps (depths below 0.0001)."""
    rows = table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 25).alias("key"), ((F.col("l_orderkey") % 1000) / 1000.0).alias("phase"), F.col("l_extendedprice").alias("flux"),
        F.col("l_quantity").alias("mom_x"), (F.col("l_orderkey") % 97).alias("mom_y"), F.col("l_discount").alias("pos_x"), F.col("l_tax").alias("pos_y"),
    )
    return series.centroid_shift(rows, "key").select("key", *r6("corr_x", "corr_y", "delta_x", "delta_y", "local_shift", "depth"), "multi_source")


D_SEARCH = f"""{D_SER}, zs AS (SELECT key, avg(flux) AS c, stddev_pop(flux) AS s, min(t) AS lo, max(t) AS hi FROM ser GROUP BY key HAVING count(*) >= 100),
zz AS (SELECT key, t, (flux - c) / s AS flux FROM ser JOIN zs USING (key)),
grid AS (SELECT key, i, 1.0 / 20.0 + i * (1.0 / ((hi - lo) * 10)) AS f FROM zs, range(2000) AS g(i) WHERE i <= round((1.0 / 0.2 - 1.0 / 20.0) / (1.0 / ((hi - lo) * 10)))),
{D_POWER.replace("FROM ser, grid", "FROM zz JOIN grid USING (key)")},
{D_PEAK},
fold AS (SELECT key, t, (t % best_period) / best_period AS phase, flux AS z FROM zz JOIN best USING (key) WHERE peak_power >= 0.0005),
ends AS (SELECT key, min(phase) AS lo, max(phase) AS hi FROM fold GROUP BY key),
every AS (SELECT key, CAST(b AS INTEGER) AS bin FROM ends, range(1, 101) AS r(b)),
bm AS (SELECT key, least(CAST(floor((phase - lo) / ((hi - lo) / 100)) AS INTEGER) + 1, 100) AS bin, avg(z) AS mean, count(*) AS points FROM fold JOIN ends USING (key) GROUP BY 1, 2)"""


@query(f"WITH {D_SEARCH} SELECT key, bin, round(mean, 6) AS mean, coalesce(points, 0) AS points, round(best_period, 6) AS best_period, round(peak_power, 6) AS peak_power FROM every LEFT JOIN bm USING (key, bin) JOIN best USING (key)")
def phase_fold_search(spark, d):
    """Search of the regular grid, gates, fold and bins in a row."""
    points_, binned = series.phase_fold(events_series(spark, d), "key", threshold=0.0005)
    found = points_.groupBy("key").agg(F.first("best_period").alias("best_period"), F.first("peak_power").alias("peak_power"))
    return binned.join(found, "key").select("key", "bin", *r6("mean"), "points", *r6("best_period", "peak_power"))


@query()
def ten_features(spark, d):
    """The ten features of each type's events, with their report by feature."""
    return kernels.feature_report(kernels.ten_features(events_series(spark, d), "key", threshold=0.0)).select("feature", *r6("mean", "std"))


D_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({0}[i] AS DOUBLE) * CAST({1}[i] AS DOUBLE)))"
D_MATCH = f"""v AS (SELECT vec_id AS id, embedding AS e, sqrt({D_DOT.format('embedding', 'embedding')}) AS n, {D_LABEL} AS label FROM embeddings),
pr AS (SELECT a.id AS filename, b.id AS matched, b.label AS matched_label, round({D_DOT.format('a.e', 'b.e')} / (a.n * b.n), 9) AS similarity FROM v a JOIN v b ON a.id % 5 = 0 AND b.id % 5 <> 0),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY similarity DESC, matched) AS rn FROM pr) WHERE rn = 1)"""


def top1(spark, d):
    v = vectors(spark, d)
    return match.cosine_top1(v.filter("filename % 5 = 0"), v.filter("filename % 5 <> 0"), digits=9)


@query(f"WITH {D_MATCH} SELECT filename, matched, matched_label, round(similarity, 6) AS similarity FROM top")
def cosine_match_top1(spark, d):
    return top1(spark, d).select("filename", "matched", "matched_label", *r6("similarity"))


@query(f"WITH {D_MATCH}, t AS (SELECT filename, CASE WHEN similarity < 0.4 THEN 'outlier' ELSE matched_label END AS matched_label FROM top) SELECT filename, matched_label, {D_GROUP.format('matched_label')} AS label_group FROM t")
def cosine_match_threshold(spark, d):
    return match.thresholded(top1(spark, d), 0.4).select("filename", "matched_label", "label_group")


WIDE = [f"x{i}" for i in range(64)]
WIDE_6 = [f"round({c}, 6) as {c}" for c in WIDE]


@query()
def series_match(spark, d):
    """Series of users against those of every third user, by principal components of bin means about 3.7 days."""

    def compute(rows, key):
        binned = series.bins(series.fold(rows, key, rows.select(key).distinct().withColumn("best_period", F.lit(PERIOD))), key, 10)
        return series.bin_vector(binned, key).filter("is_valid").select(key, "vec")

    rows = events_series(spark, d, "user_id")
    known = cut(compute(rows.filter("key % 3 = 0"), "key"))
    model = cluster.fit_projection(known, 5)
    labelled = model.apply(known).select("key", F.col("scores").alias("vec"), F.element_at(F.array(*[F.lit(v) for v in ("Pl", "EB*", "*")]), (F.col("key") % 9 / 3 + 1).cast("int")).alias("label"))
    return match.match_series(rows.filter("key % 3 <> 0"), labelled, "key", compute, model).select("key", "matched", "matched_label", "label_group", *r6("similarity"))


def dims(spark, d):
    each = [f"cast(element_at(embedding, {i + 1}) as double) as {c}" for i, c in enumerate(WIDE)]
    return table(spark, d, "embeddings").selectExpr("vec_id as id", *each, "label")


D_DIMS = f"dims AS (SELECT vec_id AS id, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS {c}' for i, c in enumerate(WIDE))}, label FROM embeddings)"


def _scaled(a: str, b: str) -> str:
    stats = ", ".join(f"{a.format(c)} AS a_{c}, {b.format(c)} AS b_{c}" for c in WIDE)
    return f"WITH {D_DIMS}, st AS (SELECT {stats} FROM dims) SELECT id, {', '.join(f'round(({c} - a_{c}) / b_{c}, 6) AS {c}' for c in WIDE)} FROM dims, st"


@query(_scaled("avg({})", "stddev_pop({})"))
def scale_standard(spark, d):
    return cluster.scale(dims(spark, d), WIDE, "standard").selectExpr("id", *WIDE_6)


@query(_scaled("min({})", "(max({0}) - min({0}))"))
def scale_minmax(spark, d):
    return cluster.scale(dims(spark, d), WIDE, "minmax").selectExpr("id", *WIDE_6)


@query(_scaled("median({})", "(quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25))"))
def scale_robust(spark, d):
    return cluster.scale(dims(spark, d), WIDE, "robust").selectExpr("id", *WIDE_6)


def all_points(spark, d):
    """(id, vec, label): vectors with every component scaled."""
    return cut(cluster.scale(dims(spark, d), WIDE, "standard").select("id", F.array(*WIDE).alias("vec"), "label"))


def points(spark, d):
    """The first three components: all 64 of these vectors lie about equally far apart, which leaves no dense regions."""
    out = cluster.scale(dims(spark, d), ["x0", "x1", "x2"], "standard")
    return out.select("id", F.array("x0", "x1", "x2").alias("vec"), "label")


D_PTS = f"""{D_DIMS}, st AS (SELECT avg(x0) AS a0, stddev_pop(x0) AS s0, avg(x1) AS a1, stddev_pop(x1) AS s1, avg(x2) AS a2, stddev_pop(x2) AS s2 FROM dims),
pts AS (SELECT id, (x0 - a0) / s0 AS x, (x1 - a1) / s1 AS y, (x2 - a2) / s2 AS z, label FROM dims, st)"""
D_ALL = f"""{D_DIMS}, st AS (SELECT {', '.join(f'avg({c}) AS a_{c}, stddev_pop({c}) AS b_{c}' for c in WIDE)} FROM dims),
pts AS (SELECT id, [{', '.join(f'({c} - a_{c}) / b_{c}' for c in WIDE)}] AS v, label FROM dims, st)"""
D_DBSCAN = f"""{D_PTS},
near AS (SELECT a.id AS a, b.id AS b FROM pts a, pts b WHERE sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) <= 0.5),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 5),
ce AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
walk AS (SELECT id AS root, id AS id FROM core UNION SELECT walk.root, ce.b FROM walk JOIN ce ON ce.a = walk.id),
roots AS (SELECT id, min(root) AS root FROM walk GROUP BY id),
numbered AS (SELECT id, root, dense_rank() OVER (ORDER BY root) - 1 AS label FROM roots),
border AS (SELECT near.a AS id, min(numbered.label) AS label FROM near JOIN numbered ON near.b = numbered.id GROUP BY near.a),
db AS (SELECT pts.id, CAST(coalesce(numbered.label, border.label, -1) AS INTEGER) AS label FROM pts LEFT JOIN numbered ON numbered.id = pts.id LEFT JOIN border ON border.id = pts.id)"""


@query(f"WITH RECURSIVE {D_DBSCAN} SELECT * FROM db")
def dbscan_labels(spark, d):
    return cluster.dbscan(points(spark, d), 0.5, 5)


@query(f"WITH RECURSIVE {D_DBSCAN} SELECT label, count(*) AS n FROM db GROUP BY label")
def cluster_sizes(spark, d):
    return cluster.dbscan(points(spark, d), 0.5, 5).groupBy("label").agg(F.count("*").alias("n"))


@query()
def kmeans_sizes(spark, d):
    labels, _ = cluster.kmeans(all_points(spark, d), 3)
    return labels.groupBy("label").agg(F.count("*").alias("n"))


@query()
def gmm_fit(spark, d):
    labels, info = cluster.gaussian_mixture(points(spark, d), 3)
    return labels.groupBy("label").agg(F.count("*").alias("n")).withColumn("aic", F.lit(round(info["aic"], 3))).withColumn("bic", F.lit(round(info["bic"], 3)))


@query()
def tsne_embed(spark, d):
    return embedding.embed(all_points(spark, d)).select("id", *r6("x", "y"))


@query()
def pca_project(spark, d):
    scores_, ratio = cluster.pca(vectors(spark, d), 8, "filename")
    return scores_.select("id", F.transform("scores", lambda x: F.round(x, 6)).alias("scores")).withColumn("explained", F.lit(round(sum(ratio), 6)))


@query(
    f"""WITH {D_ALL}, pr AS (SELECT a.id, a.label AS la, b.label AS lb, list_distance(a.v, b.v) AS dist FROM pts a, pts b),
g AS (SELECT id, la, lb, sum(dist) AS s, count(*) AS n FROM pr GROUP BY id, la, lb),
ab AS (SELECT id, max(CASE WHEN la = lb AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN la <> lb THEN s / n END) AS b FROM g GROUP BY id)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab"""
)
def silhouette(spark, d):
    return cluster.silhouette(all_points(spark, d)).select(*r6("silhouette"))


D_CENT = """parts AS (SELECT label, unnest(range(1, 65)) AS j, unnest(v) AS x FROM pts),
c AS (SELECT label, list(m ORDER BY j) AS c, max(n) AS n FROM (SELECT label, j, avg(x) AS m, count(*) AS n FROM parts GROUP BY label, j) GROUP BY label),
al AS (SELECT list(m ORDER BY j) AS a, max(n) AS total FROM (SELECT j, avg(x) AS m, count(*) AS n FROM parts GROUP BY j))"""


@query(
    f"""WITH {D_ALL}, {D_CENT}, b AS (SELECT sum(n * pow(list_distance(c, a), 2)) AS between_, count(*) AS k, max(total) AS total FROM c, al),
w AS (SELECT sum(pow(list_distance(v, c), 2)) AS within_ FROM pts JOIN c USING (label))
SELECT round((between_ / (k - 1)) / (within_ / (total - k)), 6) AS calinski_harabasz FROM b, w"""
)
def calinski_harabasz(spark, d):
    return cluster.calinski_harabasz(all_points(spark, d)).select(*r6("calinski_harabasz"))


@query(
    f"""WITH {D_ALL}, {D_CENT}, s AS (SELECT label, c, avg(list_distance(v, c)) AS s FROM pts JOIN c USING (label) GROUP BY label, c),
r AS (SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM s a JOIN s b ON a.label <> b.label GROUP BY a.label)
SELECT round(avg(r), 6) AS davies_bouldin FROM r"""
)
def davies_bouldin(spark, d):
    return cluster.davies_bouldin(all_points(spark, d)).select(*r6("davies_bouldin"))


def evaluated(spark, d):
    """Scores of users above zero, flagged where the user's catalogue part is important."""
    s = relational.positive(scores(spark, d), "p3").select("tic", "filename", F.round("p3", 9).alias("score"))
    return relational.ranked(s.join(importance_table(spark, d).withColumnRenamed("id", "tic"), "tic", "left"), "score", "filename")


D_EVAL = f"""{D_SCORES}, {D_IMP},
ev AS (SELECT s.tic, filename, round(p3, 9) AS score, importance, row_number() OVER (ORDER BY round(p3, 9) DESC, filename) AS rn, count(*) OVER () AS n FROM s LEFT JOIN imp ON imp.id = s.tic WHERE p3 > 0)"""


@query(f"WITH {D_EVAL} SELECT filename, rn, round((rn - 1) * 100.0 / n, 6) AS percentile FROM ev")
def rank_percentile(spark, d):
    return evaluated(spark, d).select("filename", "rn", *r6("percentile"))


D_CURVE = """cur AS (SELECT pct, floor(n * pct / 100.0) AS k, sum(CASE WHEN importance IS NOT NULL THEN 1 ELSE 0 END) AS positives, sum(CASE WHEN importance IS NOT NULL AND rn <= floor(n * pct / 100.0) THEN 1 ELSE 0 END) AS hits,
  avg(CASE WHEN rn <= floor(n * pct / 100.0) THEN importance END) AS mean_weight FROM ev, range(5, 101, 5) AS r(pct) GROUP BY pct, n)"""


@query(f"WITH {D_EVAL}, {D_CURVE} SELECT CAST(pct AS INTEGER) AS pct, CAST(k AS BIGINT) AS k, round(CASE WHEN positives > 0 THEN hits * CAST(1 AS DOUBLE) / positives ELSE 0 END, 6) AS recall, round(mean_weight, 4) AS mean_weight FROM cur")
def topk_recall_curve(spark, d):
    return relational.recall_curve(evaluated(spark, d), F.col("importance").isNotNull(), "importance").select("pct", "k", *r6("recall"), F.round("mean_weight", 4).alias("mean_weight"))


@query(
    f"""WITH {D_EVAL}, {D_CURVE}, c2 AS (SELECT pct / 100.0 AS x, CASE WHEN positives > 0 THEN hits * CAST(1 AS DOUBLE) / positives ELSE 0 END AS y FROM cur),
l AS (SELECT (x - lag(x) OVER (ORDER BY x)) * (y + lag(y) OVER (ORDER BY x)) / 2 AS a FROM c2) SELECT round(sum(a), 6) AS area FROM l"""
)
def recall_auc(spark, d):
    curve = relational.recall_curve(evaluated(spark, d), F.col("importance").isNotNull()).select((F.col("pct") / 100.0).alias("x"), "recall")
    return relational.trapezoid(curve, "x", "recall").select(*r6("area"))


D_Q = " UNION ALL ".join(f"SELECT {i} AS i, quantile_cont(score, {i / 20}) AS threshold FROM ev" for i in range(21))


@query(
    f"""WITH {D_EVAL}, qr AS ({D_Q})
SELECT CAST(i AS INTEGER) AS i, round(threshold, 6) AS threshold, round(sum(CASE WHEN score >= threshold AND importance IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE 0 END) / sum(CASE WHEN importance IS NOT NULL THEN 1 ELSE 0 END), 6) AS recall FROM ev, qr GROUP BY i, threshold"""
)
def quantile_recall(spark, d):
    rows = evaluated(spark, d).withColumn("flag", F.col("importance").isNotNull().cast("int"))
    return relational.quantile_recall(rows, "score", "flag", 20).select("i", *r6("threshold", "recall"))


@query(
    f"""WITH {D_EVAL}, im AS (SELECT importance, (rn - 1) * 100.0 / n AS percentile, row_number() OVER (ORDER BY importance DESC, filename) AS r, count(*) OVER () AS m FROM ev WHERE importance IS NOT NULL)
SELECT round(min(percentile), 6) AS lower, round(max(percentile), 6) AS upper, count(*) AS n_top FROM im WHERE r <= greatest(1, floor(m * 20 / 100.0))"""
)
def top_importance_range(spark, d):
    return relational.top_range(evaluated(spark, d).filter("importance is not null"), "importance", "percentile", 20, "filename").select(*r6("lower", "upper"), "n_top")


def variants(spark, d):
    ev = table(spark, d, "events")
    return ev.select(F.col("event_type").alias("variant"), (F.col("value") - 20).alias("score"), (F.col("user_id") % 10 == 0).cast("int").alias("is_flagged"))


D_VAR = """va AS (SELECT event_type AS variant, value - 20 AS score, CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END AS is_flagged FROM events),
rep AS (SELECT variant, count(*) AS n_total, sum(CASE WHEN score > 0 THEN 1 ELSE 0 END) AS n_anomalies, sum(is_flagged) AS n_positives, sum(CASE WHEN score > 0 AND is_flagged = 1 THEN 1 ELSE 0 END) AS n_positives_found, quantile_cont(score, 0.9) AS cut FROM va GROUP BY variant)"""
D_VAR_COLS = "rep.variant, n_total, CAST(n_anomalies AS BIGINT) AS n_anomalies, CAST(n_positives AS BIGINT) AS n_positives, CAST(n_positives_found AS BIGINT) AS n_positives_found, round(n_anomalies * CAST(1 AS DOUBLE) / n_total, 6) AS anomaly_rate, round(n_positives_found * CAST(1 AS DOUBLE) / n_positives, 6) AS recall"
VAR_COLS = ["variant", "n_total", "n_anomalies", "n_positives", "n_positives_found"]


@query(f"WITH {D_VAR} SELECT {D_VAR_COLS} FROM rep")
def variant_report(spark, d):
    return relational.variant_report(variants(spark, d)).select(*VAR_COLS, *r6("anomaly_rate", "recall"))


@query(f"WITH {D_VAR} SELECT {D_VAR_COLS}, count(*) AS n_thresholded, CAST(sum(is_flagged) AS BIGINT) AS n_positives_thresholded FROM rep JOIN va ON va.variant = rep.variant AND va.score >= cut GROUP BY ALL")
def variant_report_top_pct(spark, d):
    return relational.variant_report(variants(spark, d), 10).select(*VAR_COLS, *r6("anomaly_rate", "recall"), "n_thresholded", "n_positives_thresholded")


def weighed_variants(spark, d):
    """(variant, filename, score, is_flagged, importance): a row an event, flagged where its user's catalogue part is important."""
    ev = table(spark, d, "events").select(F.col("event_type").alias("variant"), F.col("event_id").alias("filename"), F.round(F.col("value") - 20, 9).alias("score"), F.col("user_id").alias("id"))
    return ev.join(importance_table(spark, d), "id", "left").withColumn("is_flagged", (F.col("importance").isNotNull() & (F.col("id") % 10 == 0)).cast("int")).drop("id")


D_WV = f"""{D_IMP},
wv0 AS (SELECT event_type AS variant, event_id AS filename, round(value - 20, 9) AS score, CASE WHEN importance IS NOT NULL AND user_id % 10 = 0 THEN 1 ELSE 0 END AS is_flagged, importance AS imp0 FROM events LEFT JOIN imp ON imp.id = user_id),
wv AS (SELECT *, CASE WHEN is_flagged = 1 THEN imp0 END AS w, row_number() OVER (PARTITION BY variant ORDER BY score DESC, filename) AS rn, count(*) OVER (PARTITION BY variant) AS n FROM wv0)"""


@query(
    f"""WITH {D_WV},
sz AS (SELECT variant, count(*) AS n, sum(CASE WHEN score > 0 THEN 1 ELSE 0 END) AS np, sum(is_flagged) AS fl, sum(CASE WHEN score > 0 THEN is_flagged ELSE 0 END) AS hits FROM wv GROUP BY variant HAVING sum(is_flagged) > 0),
cu AS (SELECT variant, pct, sum(CASE WHEN rn <= floor(n * pct / 100.0) THEN is_flagged ELSE 0 END) * CAST(1 AS DOUBLE) / sum(is_flagged) AS r, avg(CASE WHEN rn <= floor(n * pct / 100.0) THEN w END) AS m FROM wv, range(5, 101, 5) AS g(pct) GROUP BY variant, pct),
ar AS (SELECT variant, (r + lag(r) OVER o) / 40 AS a, (m + lag(m) OVER o) / 40 AS b, m FROM cu WINDOW o AS (PARTITION BY variant ORDER BY pct)),
au AS (SELECT variant, sum(a) AS auc_recall, CASE WHEN count(m) = count(*) THEN sum(b) END AS auc_importance FROM ar GROUP BY variant),
ab AS (SELECT wv.*, np, (rn - 1) * CAST(100 AS DOUBLE) / np AS p FROM wv JOIN sz USING (variant) WHERE score > 0),
tp AS (SELECT variant, avg(CASE WHEN rn <= floor(np * 20 / 100.0) THEN w END) AS mt FROM ab GROUP BY variant),
im AS (SELECT variant, p, row_number() OVER (PARTITION BY variant ORDER BY w DESC, filename) AS k, count(*) OVER (PARTITION BY variant) AS c FROM ab WHERE w IS NOT NULL),
en AS (SELECT variant, min(CASE WHEN k <= greatest(1, floor(c / 10.0)) THEN p END) AS l1, max(CASE WHEN k <= greatest(1, floor(c / 10.0)) THEN p END) AS u1, min(CASE WHEN k <= greatest(1, floor(c / 5.0)) THEN p END) AS l2, max(CASE WHEN k <= greatest(1, floor(c / 5.0)) THEN p END) AS u2 FROM im GROUP BY variant)
SELECT variant, round(auc_recall, 6) AS auc_recall, round(auc_importance, 2) AS auc_importance, round(mt, 2) AS mean_importance_top, round(hits * CAST(1 AS DOUBLE) / fl, 6) AS recall, round(np * CAST(1 AS DOUBLE) / sz.n, 6) AS anomaly_rate,
  round(l1, 6) AS top10_lower, round(u1, 6) AS top10_upper, round(l2, 6) AS top20_lower, round(u2, 6) AS top20_upper FROM sz JOIN au USING (variant) LEFT JOIN tp USING (variant) LEFT JOIN en USING (variant)"""
)
def auc_report(spark, d):
    report, _ = relational.auc_report(weighed_variants(spark, d))
    money = [F.round(c, 2).alias(c) for c in ("auc_importance", "mean_importance_top")]
    return report.select("variant", *r6("auc_recall"), *money, *r6("recall", "anomaly_rate", "top10_lower", "top10_upper", "top20_lower", "top20_upper"))


@query(
    f"""WITH {D_WV}, qs AS (SELECT variant, unnest(quantile_cont(score, list_transform(range(101), lambda i: i / 100.0))) AS threshold, unnest(range(101)) AS i FROM wv GROUP BY variant),
rc AS (SELECT variant, i, sum(CASE WHEN score >= threshold THEN is_flagged ELSE 0 END) * CAST(1 AS DOUBLE) / sum(is_flagged) AS r FROM wv JOIN qs USING (variant) GROUP BY variant, i)
SELECT variant, round(avg(r), 4) AS mean_recall FROM rc GROUP BY variant"""
)
def recall_report(spark, d):
    return relational.recall_report(weighed_variants(spark, d)).select("variant", F.round("mean_recall", 4).alias("mean_recall"))


@query(f"WITH {D_GV} SELECT label, count(*) AS n FROM gv WHERE label <> 'zz' GROUP BY label")
def label_counts(spark, d):
    return relational.value_counts(grouped_vectors(spark, d).withColumn("label", F.when(F.col("label") != "zz", F.col("label"))), "label")


@query("SELECT c_custkey AS filename, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS is_there FROM customer")
def existing_marked(spark, d):
    there = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("filename"))
    return relational.marked_existing(relational.require(table(spark, d, "customer").select(F.col("c_custkey").alias("filename")), "filename"), there)


@query(f"WITH {D_USER}, m AS (SELECT key, median(flux) AS c FROM ser GROUP BY key) SELECT key, round(t, 6) AS t, round(flux / c, 6) AS flux FROM ser JOIN m USING (key)")
def median_normalised(spark, d):
    return series.median_normalise(events_series(spark, d, "user_id"), "key").select("key", *r6("t", "flux"))


@query(
    """WITH b AS (SELECT doc_id, toxic AS pos FROM labels), q AS (SELECT least(CAST(round_even(avg(pos) * 100, 0) AS BIGINT), CAST(sum(pos) AS BIGINT)) AS q FROM b),
r AS (SELECT doc_id, pos, q, row_number() OVER (PARTITION BY pos ORDER BY md5(doc_id || '-42-0'), doc_id) AS rn FROM b, q)
SELECT doc_id, pos FROM r WHERE rn <= CASE WHEN pos = 1 THEN q ELSE 100 - q END"""
)
def stratified_sample(spark, d):
    rows = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("pos"))
    return relational.stratified_sample(rows, "pos", "doc_id", 100).select("doc_id", "pos")


@query(
    """WITH o AS (SELECT c_custkey AS id, (c_custkey % 360) + 0.0003 * (c_custkey % 7) AS ra, (c_custkey % 120) - 60 + 0.0002 * (c_custkey % 5) AS dec FROM customer),
s AS (SELECT s_suppkey AS star, (s_suppkey % 360) * CAST(1 AS DOUBLE) AS ra, (s_suppkey % 120) - CAST(60 AS DOUBLE) AS dec FROM supplier),
p AS (SELECT id, star, degrees(2 * asin(sqrt(pow(sin(radians((s.dec - o.dec) / 2)), 2) + cos(radians(o.dec)) * cos(radians(s.dec)) * pow(sin(radians((s.ra - o.ra) / 2)), 2)))) AS distance FROM o, s)
SELECT id, star, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, star) AS rn FROM p WHERE distance <= 0.0014) WHERE rn = 1"""
)
def sky_nearest(spark, d):
    o = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") % 360) + F.lit(0.0003) * (F.col("c_custkey") % 7)).alias("ra"), ((F.col("c_custkey") % 120) - 60 + F.lit(0.0002) * (F.col("c_custkey") % 5)).alias("dec"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("star"), (F.col("s_suppkey") % 360).cast("double").alias("ra"), ((F.col("s_suppkey") % 120) - 60).cast("double").alias("dec"))
    return relational.sky_nearest(o, s, 0.0014).select("id", "star", *r6("distance"))


@query(
    """WITH o AS (SELECT c_custkey AS id, (c_custkey * 7.3) % 360 AS ra, ((c_custkey % 181) - 90) * 0.999 AS dec FROM customer),
s AS (SELECT s_suppkey AS star, (s_suppkey * 29.7) % 360 AS ra, ((s_suppkey % 19) * 10 - 90) * 0.998 AS dec FROM supplier),
p AS (SELECT id, star, degrees(2 * asin(least(1, sqrt(pow(sin(radians((s.dec - o.dec) / 2)), 2) + cos(radians(o.dec)) * cos(radians(s.dec)) * pow(sin(radians((s.ra - o.ra) / 2)), 2))))) AS distance FROM
  (SELECT id, CAST(ra AS DOUBLE) AS ra, CAST(dec AS DOUBLE) AS dec FROM o) o, (SELECT star, CAST(ra AS DOUBLE) AS ra, CAST(dec AS DOUBLE) AS dec FROM s) s)
SELECT id, star, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, star) AS rn FROM p WHERE distance <= 6.5) WHERE rn = 1"""
)
def sky_nearest_all_round(spark, d):
    """Positions over the whole sphere, poles and the seam of right ascension included."""
    exact = lambda c, by, of: F.col(c).cast("decimal(20,1)") * F.lit(by).cast("decimal(3,1)") % F.lit(of)
    o = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), exact("c_custkey", "7.3", 360).cast("double").alias("ra"), (((F.col("c_custkey") % 181) - 90) * F.lit(0.999)).alias("dec"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("star"), exact("s_suppkey", "29.7", 360).cast("double").alias("ra"), (((F.col("s_suppkey") % 19) * 10 - 90) * F.lit(0.998)).alias("dec"))
    return relational.sky_nearest(o, s, 6.5).select("id", "star", *r6("distance"))



@query("SELECT event_id, CASE WHEN abs(((t - 1.3 + 2) % 4) - 2) < 0.125 THEN 0.99 ELSE 1.0 END AS flux FROM (SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0 AS t FROM events)")
def synthetic_box(spark, d):
    t = table(spark, d, "events").select("event_id", F.expr(DAYS).alias("t"))
    return t.select("event_id", X.box_transit("t", 4.0, 0.25, 0.01, 1.3).alias("flux"))


@query("SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def url_plan(spark, d):
    """Download plan: script lines to addresses, by host."""
    from ..sources.files import script_urls

    urls = script_urls(table(spark, d, "pages").select(F.concat(F.lit("curl -C - -L -o x '"), "url", F.lit("'")).alias("value")))
    return urls.groupBy(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT c_custkey AS tic FROM customer")
def tic_from_script(spark, d):
    from ..sources.files import script_ids

    return script_ids(table(spark, d, "customer").select(F.expr("concat('curl https://x.example/tess2018206045859-s0001-', lpad(cast(c_custkey as string), 16, '0'), '-0120-s_lc.fits')").alias("value")))


def _mixture_query(shape: str, prior: str | None):
    def run(spark, d):
        rows = points(spark, d)
        model = mixture.fit(rows, 3, shape, prior)
        sizes = model.assign(rows).groupBy("label").agg(F.count("*").alias("n"))
        return sizes if prior else sizes.withColumn("aic", F.lit(round(model.aic, 3))).withColumn("bic", F.lit(round(model.bic, 3)))

    return run


for _shape in mixture.SHAPES:
    QUERIES[f"gmm_{_shape}"] = _mixture_query(_shape, None)
for _prior in mixture.PRIORS[1:]:
    QUERIES[f"bayesian_gmm_{_prior}"] = _mixture_query("full", _prior)


@query()
def clustering_comparison(spark, d):
    """Metrics of every algorithm over the same scaled points."""
    rows, _ = cluster.compare_algorithms(points(spark, d).select("id", "vec"), eps=0.5, min_samples=5)
    return rows.select("algorithm", "n_clusters", "n_noise", *r6("silhouette", "calinski_harabasz", "davies_bouldin"))


@query(
    f"""WITH {D_DIMS}, masks AS (SELECT * FROM (VALUES ('x0,x1', 1, 1, 0), ('x0,x2', 1, 0, 1), ('x1,x2', 0, 1, 1), ('x0,x1,x2', 1, 1, 1)) AS m(features, m0, m1, m2)),
pr AS (SELECT features, a.id, a.label > 4 AS la, b.label > 4 AS lb, sqrt(m0*(a.x0-b.x0)*(a.x0-b.x0) + m1*(a.x1-b.x1)*(a.x1-b.x1) + m2*(a.x2-b.x2)*(a.x2-b.x2)) AS dist FROM dims a, dims b, masks),
g AS (SELECT features, id, la, lb, sum(dist) AS s, count(*) AS n FROM pr GROUP BY ALL),
ab AS (SELECT features, id, max(CASE WHEN la = lb AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN la <> lb THEN s / n END) AS b FROM g GROUP BY features, id)
SELECT features, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS n FROM ab GROUP BY features"""
)
def subset_search(spark, d):
    return subsets.silhouettes(dims(spark, d), ["x0", "x1", "x2"], F.col("label") > 4).select("features", *r6("silhouette"), "n")


@query()
def flat_box(spark, d):
    """Flattened series folded at their best box, in bins of phase."""
    rows = kernels.flat_box(events_series(spark, d), "key")
    at = F.least(F.floor((F.col("phase") + 0.5) * 150) + 1, F.lit(150)).cast("int")
    return rows.groupBy("key", at.alias("bin")).agg(F.round(F.avg("z"), 6).alias("mean"), F.count("*").alias("points"), F.round(F.first("period"), 6).alias("period"))


@query()
def synthetic_mixed(spark, d):
    """Synthetic curves at the times of every user's events."""
    out = kernels.synthetic_curves(events_series(spark, d, "user_id").select("key", "t"), "key")
    return out.groupBy("key", "model").agg(F.count("*").alias("n"), F.round(F.min("flux"), 4).alias("low"), F.round(F.avg("flux"), 4).alias("mean"))


@query()
def forest_scores(spark, d):
    """1 - P(real) of every vector, by a forest trained against vectors with shuffled components."""
    real = vectors(spark, d).select("filename", "vec")
    model = forest.fit(real, forest.shuffled_columns(real), trees=50)
    return forest.score(real, model).select("filename", *r6("anomaly_score"))


@query("SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY ALL")
def stream_daily(spark, d):
    """Daily totals of the events by Structured Streaming over their files."""
    # a pattern, as a stream takes a single file only by one
    stream = incremental.new_files(spark, f"{d}/event[s].parquet", table(spark, d, "events").schema)
    work = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/stream-{uuid.uuid4().hex}"
    made = incremental.drain_totals(incremental.windowed(stream, "ts", "1 day", ["event_type"], "value"), f"{work}/totals", f"{work}/state")
    return spark.read.parquet(made).select("event_type", "start", "n", *r6("mean", "low", "high"))
