"""Registered experiment-statistics queries: customers as runs, nations as conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonde import schemas
from sonde.operators import experiments as N
from sonde.operators import rules as R
from sonde.queries.common import integers, rounded, with_ctes
from sonde.sources import adapters as A

LEVELS = ("noise", "reliability")


def _individual(spark, d):
    return N.individual_runs(*A.experiments(spark, d))


def _canonical(spark, d):
    return N.canonical_statistics(N.condition_statistics(_individual(spark, d)))


def experiments(spark, d):
    e, _ = A.experiments(spark, d)
    members = e.select("experiment_id", "experiment_name", "run_id", "seed")
    runs = e.drop("experiment_id", "experiment_name", "seed")
    return N.experiments(members, runs).select(
        "experiment_id", "experiment_name", "run_id", "seed", "scenario_seed", *LEVELS)


def experiment_metrics(spark, d):
    e, m = A.experiments(spark, d)
    # One scan per order: the customer is the run, so rates are per run as in a sweep.
    scans = A.table(spark, d, "orders").select(
        (F.col("o_custkey") + 1).alias("run_id"), (F.col("o_totalprice").cast("bigint") % 5).alias("measurement_count"))
    metrics = m.select("run_id", "position_rmse", "id_switches")
    out = N.experiment_metrics(e, metrics, scans)
    return rounded(out, 6, "position_rmse", "scans_per_second", "measurements_per_second", "measurements_per_scan")


def individual_runs(spark, d):
    out = _individual(spark, d).select("experiment_id", "run_id", "seed", *LEVELS, "position_rmse", "missed_target_samples")
    return rounded(out, 6, "position_rmse")


def condition_partition(spark, d):
    """How many runs share each condition id: unlike controls are never pooled."""
    return _individual(spark, d).groupBy("experiment_id", *LEVELS, "condition_id").agg(
        F.count(F.lit(1)).alias("runs")).groupBy("experiment_id", *LEVELS).agg(
        F.count(F.lit(1)).alias("condition_ids"), F.sum("runs").alias("runs"))


def run_values(spark, d):
    return rounded(N.run_values(_individual(spark, d)).select("experiment_id", "run_id", "seed", "metric", "value"), 6, "value")


def _stats_columns(df):
    out = df.withColumn("seeds", F.array_join(F.transform("seeds", lambda s: s.cast("string")), ","))
    return rounded(out, 6, "mean", "stddev", "minimum", "maximum").drop("condition", "condition_id")


def condition_statistics(spark, d):
    stats = N.condition_statistics(_individual(spark, d))
    level = {n: F.get_json_object("condition", f"$.{n}").cast("double") for n in LEVELS}
    return _stats_columns(stats.withColumns(level))


def canonical_statistics(spark, d):
    return integers(_stats_columns(_canonical(spark, d)), "sensor_count")


def parameter_levels(spark, d):
    return N.parameter_levels(_individual(spark, d))


def metric_definitions(spark, d):
    """Definitions with the number of runs that have a value of the metric."""
    counted = N.run_values(_individual(spark, d)).groupBy("metric").agg(F.count("value").alias("valid_runs"))
    return counted.join(F.broadcast(N.metric_definitions(spark)), "metric").select("metric", "unit", "valid_runs")


def seed_summary(spark, d):
    _, m = A.experiments(spark, d)
    return rounded(N.seed_summary(m, ["experiment_id"]), 6, "mean", "min", "max")


def study_panels(spark, d):
    out = N.study_panels(_canonical(spark, d)).drop("definition", "title", "unit")
    return rounded(out, 6, "mean", "stddev", "minimum", "maximum")


def study_findings(spark, d):
    # Both noise and reliability vary, so each reliability is a study of its own: one point per level.
    canonical = _canonical(spark, d).withColumn(
        "experiment_id", F.concat_ws("/", "experiment_id", F.col("reliability").cast("string")))
    panels = N.study_panels(canonical).filter(F.col("panel") == "noise")
    return N.study_findings(panels).select("experiment_id", "panel", "chart", "non_monotonic")


def study_overview(spark, d):
    return N.study_overview(_individual(spark, d))


def one_variable_check(spark, d):
    individual = _individual(spark, d)
    plan = individual.select("experiment_id").distinct().withColumn("parameter", F.lit("noise"))
    found = N.one_variable_check(individual, plan)
    return found.select(F.col("detail").alias("experiment_control_levels"))


def _manifest(spark, d):
    return A.experiments(spark, d)[0].groupBy("experiment_id").agg(
        F.min("experiment_name").alias("name"),
        # The manifest of one segment counts a run too many, so the checks have work.
        (F.count(F.lit(1)) + F.when(F.col("experiment_id").startswith("MACHINERY"), 1).otherwise(0)).alias("run_count"))


def _by_rule(found):
    return found.groupBy("rule", "detail").agg(F.count(F.lit(1)).alias("violations")).na.fill("", ["detail"])


def sweep_identity(spark, d):
    e, _ = A.experiments(spark, d)
    odd = e.withColumn("experiment_name", F.when(F.col("seed") % 97 == 3, "other").otherwise(F.col("experiment_name")))
    return _by_rule(R.sweep_identity(odd, _manifest(spark, d)))


def sweep_checks(spark, d):
    individual = _individual(spark, d).withColumn(
        "scenario_seed", F.when(F.col("seed") % 89 == 5, F.col("seed") + 1).otherwise(F.col("seed")))
    found = R.sweep_checks(individual, N.run_values(individual), _canonical(spark, d), _manifest(spark, d))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


def paired_seeds(spark, d):
    stats = _canonical(spark, d)
    # The plan expects the seeds of the first noise level at every level.
    plan = stats.filter((F.col("noise") == 0) & (F.col("reliability") == 0.5)).groupBy("analysis", "metric").agg(
        F.min_by("seeds", "experiment_id").alias("seeds"), (F.count(F.lit(1)) + 2).alias("level_count"))
    found = R.paired_seeds(stats, plan)
    return found.groupBy("detail").agg(F.count(F.lit(1)).alias("violations")).withColumnRenamed("detail", "chart")


def result_invariants(spark, d):
    """Each experiment at one reliability as a study; in one segment id switches claim more valid runs than there are."""
    canonical = _canonical(spark, d).withColumn("experiment_id", F.concat_ws("/", "experiment_id", F.col("reliability").cast("string")))
    points = rounded(N.study_panels(canonical), 6, "mean", "stddev", "minimum", "maximum")
    damaged = F.col("experiment_id").startswith("MACHINERY") & (F.col("chart") == "id_switches")
    found = R.result_invariants(points.withColumn("valid", F.when(damaged, F.col("runs") + 1).otherwise(F.col("valid"))))
    return found.groupBy("detail").agg(F.count(F.lit(1)).alias("violations"))


def parameter_grid(spark, d):
    """Planned runs of a sweep whose seeds are the nations' keys, against the customers seen."""
    grid = N.parameter_grid(spark, {
        "version": 1, "name": "grid", "seeds": {"start": 0, "stop": 25}, "fixed": {}, "vary": {"noise": [0, 1, 2], "reliability": [0.5, 0.75]}})
    seen = A.table(spark, d, "customer").groupBy(
        F.col("c_nationkey").cast("bigint").alias("scenario_seed"), (F.col("c_nationkey") % 3).cast("double").alias("noise")).agg(
        F.count(F.lit(1)).alias("customers"))
    return grid.join(seen, ["scenario_seed", "noise"], "left").groupBy("noise", "reliability").agg(
        F.count(F.lit(1)).alias("planned"), F.count("customers").alias("present"), F.sum("customers").alias("customers"))


def analysis_summary(spark, d):
    from sonde.operators.summaries import analysis_summary as report

    e, m = A.experiments(spark, d)
    runs = e.select("run_id", *(c for c in ("scenario_seed", "layout_seed", "duration_seconds", "target_count", "sensor_count")))
    metrics = m.select(
        "run_id", "target_samples", "position_rmse", "missed_target_samples", "false_track_samples", "unique_false_tracks",
        "id_switches", F.col("measurement_count").alias("evaluated_frames"),
        (F.col("target_samples") - F.col("missed_target_samples")).alias("matched_samples"),
        (F.col("position_rmse") / 2).alias("mean_position_error"))
    out = report(runs, metrics)
    return integers(rounded(out, 6, "position_rmse", "mean_position_error"), "layout_seed", "duration_seconds", "target_count", "sensor_count")


QUERIES = {f.__name__: f for f in (
    experiments, experiment_metrics, individual_runs, condition_partition, run_values, condition_statistics,
    canonical_statistics, parameter_levels, metric_definitions, seed_summary, study_panels, study_findings, study_overview,
    one_variable_check, sweep_identity, sweep_checks, paired_seeds, result_invariants, parameter_grid, analysis_summary)}

RUNS = """per_run AS (SELECT o_custkey, count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
    count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, max(o_totalprice) AS top FROM orders GROUP BY o_custkey),
individual AS (SELECT c_mktsegment || '-' || (c_custkey // 4096) AS experiment_id, c_custkey + 1 AS run_id, c_custkey AS seed,
    CAST(c_nationkey % 3 AS DOUBLE) AS noise, 0.5::DOUBLE + (c_nationkey % 2) / 4 AS reliability,
    CASE WHEN finished > 0 THEN top / 1000 END AS position_rmse, coalesce(urgent, 0) AS missed, coalesce(orders, 0) AS targets,
    coalesce(finished, 0) AS switches, coalesce(orders, 0) * 3 AS yield FROM customer LEFT JOIN per_run ON o_custkey = c_custkey),
""" + "run_vals AS (" + " UNION ALL ".join(
    f"SELECT experiment_id, run_id, seed, noise, reliability, '{metric}' AS metric, CAST({value} AS DOUBLE) AS value FROM individual"
    for metric, value in {
        "position_rmse": "position_rmse", "missed_target_samples": "missed", "missed_target_fraction": "missed / nullif(targets, 0)",
        "id_switches": "switches", "measurement_count": "yield", "measurements_per_second": "yield / 20.0",
        "measurements_per_scan": "yield / (targets + 1)", "false_track_samples": "missed * 2", "unique_false_tracks": "missed"}.items()) + """),
sums AS (SELECT experiment_id, noise, reliability, metric, sum(value) / count(value) AS centre, count(value) AS valid_count,
    sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END)::BIGINT AS null_count, sum(1)::BIGINT AS run_count FROM run_vals GROUP BY ALL),
spread AS (SELECT experiment_id, noise, reliability, metric, sum((value - centre) * (value - centre)) AS squares, list_sort(list(DISTINCT seed)) AS kept,
    string_agg(seed::VARCHAR, ',' ORDER BY seed) AS seeds, list_sort(list(value) FILTER (WHERE value IS NOT NULL)) AS ordered
  FROM run_vals JOIN sums USING (experiment_id, noise, reliability, metric) GROUP BY ALL),
stats AS (SELECT experiment_id, 'study ' || experiment_id AS experiment_name, noise, reliability, metric, run_count,
    len(kept)::BIGINT AS seed_count, seeds, valid_count, null_count, round(centre, 6) AS mean,
    CASE WHEN valid_count > 1 THEN round(sqrt(squares / (valid_count - 1)), 6) END AS stddev,
    round(ordered[1], 6) AS minimum, round(ordered[-1], 6) AS maximum
  FROM sums JOIN spread USING (experiment_id, noise, reliability, metric))"""
MAP = "analyses(analysis, metric) AS (VALUES " + ", ".join(
    f"('{a}', '{m}')" for a, names in schemas.ANALYSIS_METRICS.items() for m in names) + ")"
UNITS = "units(metric, unit) AS (VALUES " + ", ".join(f"('{m}', '{u}')" for m, u, _ in schemas.METRICS) + ")"
DEFINITIONS = "definitions(metric, unit, definition) AS (VALUES " + ", ".join(
    "('{}', '{}', '{}')".format(*m) for m in schemas.METRICS) + ")"
CHARTS = "charts(panel, parameter, chart) AS (VALUES " + ", ".join(
    f"('{p}', '{parameter}', '{m}')" for p, (parameter, names) in schemas.STUDY_PANELS.items() for m in names) + ")"
POINTS = """points AS (SELECT experiment_id, panel, chart, CASE parameter WHEN 'noise' THEN noise WHEN 'reliability' THEN reliability
    WHEN 'clutter' THEN 1.0 WHEN 'convergence' THEN 1.0 WHEN 'sensor_count' THEN 3.0 END::DOUBLE AS value, reliability,
    run_count AS runs, valid_count AS valid, null_count, mean, stddev, minimum, maximum
  FROM stats JOIN charts ON chart = metric)"""

ORACLES = {
    "experiments": f"""WITH {RUNS}
    SELECT experiment_id, 'study ' || experiment_id AS experiment_name, run_id, seed, seed AS scenario_seed, noise, reliability
    FROM individual""",
    "experiment_metrics": f"""WITH {RUNS}, sensing AS (SELECT o_custkey + 1 AS run_id, count(*) AS scan_count,
      CAST(sum(CAST(trunc(o_totalprice) AS BIGINT) % 5) AS BIGINT) AS measurement_count,
      count(*) FILTER (WHERE CAST(trunc(o_totalprice) AS BIGINT) % 5 = 0) AS empty_scan_count FROM orders GROUP BY 1)
    SELECT experiment_id, 'study ' || experiment_id AS experiment_name, run_id, seed, round(position_rmse, 6) AS position_rmse,
      switches AS id_switches, scan_count, measurement_count, empty_scan_count, round(scan_count / 20::DOUBLE, 6) AS scans_per_second,
      round(measurement_count / 20::DOUBLE, 6) AS measurements_per_second,
      round(measurement_count::DOUBLE / scan_count, 6) AS measurements_per_scan FROM individual JOIN sensing USING (run_id)""",
    "individual_runs": f"""WITH {RUNS}
    SELECT experiment_id, run_id, seed, noise, reliability, round(position_rmse, 6) AS position_rmse,
      missed AS missed_target_samples FROM individual""",
    "condition_partition": f"""WITH {RUNS}
    SELECT experiment_id, noise, reliability, CAST(1 AS BIGINT) AS condition_ids, count(*) AS runs FROM individual GROUP BY ALL""",
    "run_values": f"""WITH {RUNS}
    SELECT experiment_id, run_id, seed, metric, round(value, 6) AS value FROM run_vals""",
    "condition_statistics": f"WITH {RUNS} SELECT * FROM stats",
    "canonical_statistics": f"""WITH {RUNS}, {MAP}, {DEFINITIONS}
    SELECT analysis, noise, reliability, 1.0::DOUBLE AS clutter, 1.0::DOUBLE AS convergence, CAST(3 AS BIGINT) AS sensor_count,
      1.0::DOUBLE AS coverage, stats.* EXCLUDE (noise, reliability), unit, definition
    FROM stats JOIN analyses USING (metric) JOIN definitions USING (metric)""",
    "parameter_levels": f"""WITH {RUNS}
    SELECT DISTINCT experiment_id, 'noise' AS parameter, noise AS level FROM individual
    UNION ALL SELECT DISTINCT experiment_id, 'reliability', reliability FROM individual
    UNION ALL SELECT DISTINCT experiment_id, p, v FROM individual,
      (VALUES ('clutter', 1.0::DOUBLE), ('convergence', 1.0), ('coverage', 1.0), ('sensor_count', 3.0)) AS c(p, v)""",
    "metric_definitions": f"""WITH {RUNS}, {UNITS}
    SELECT metric, unit, count(value) AS valid_runs FROM run_vals JOIN units USING (metric) GROUP BY ALL""",
    "seed_summary": f"""WITH {RUNS}
    SELECT experiment_id, metric, count(value) AS valid_seeds, round(avg(value), 6) AS mean, round(min(value), 6) AS min,
      round(max(value), 6) AS max FROM run_vals
    WHERE metric IN ('position_rmse', 'missed_target_samples', 'false_track_samples', 'unique_false_tracks', 'id_switches')
    GROUP BY ALL""",
    "study_panels": f"""WITH {RUNS}, {CHARTS}, {POINTS}
    SELECT * EXCLUDE (reliability) FROM points""",
    "study_findings": f"""WITH {RUNS}, {CHARTS}, {POINTS}, steps AS (SELECT experiment_id || '/' || reliability AS experiment_id, panel,
      chart, mean, mean - lag(mean) OVER (PARTITION BY experiment_id, reliability, panel, chart ORDER BY value) AS step
      FROM points WHERE panel = 'noise'), turning AS (SELECT experiment_id, panel, chart,
      count(mean) = count(*) AND coalesce(bool_or(step > 0) AND bool_or(step < 0), false) AS non_monotonic FROM steps GROUP BY ALL)
    SELECT * FROM turning""",
    "result_invariants": f"""WITH {RUNS}, {CHARTS}, {POINTS}, p AS (SELECT experiment_id || '/' || reliability AS study, panel, chart, value,
      runs, CASE WHEN experiment_id LIKE 'MACHINERY%' AND chart = 'id_switches' THEN runs + 1 ELSE valid END AS valid,
      coalesce(mean, 0) AS m, coalesce(stddev, 0) AS sd, coalesce(minimum, 0) AS low, coalesce(maximum, 0) AS high FROM points),
    r AS (SELECT *, row_number() OVER w AS rank, coalesce(lag(value) OVER w = value, false) AS same FROM p
      WINDOW w AS (PARTITION BY study, panel, chart ORDER BY value)),
    xs AS (SELECT study, panel, rank, min(value) AS a, max(value) AS b, count(*) AS n FROM r GROUP BY ALL),
    c AS (SELECT study, panel, count(*) FILTER (WHERE rank = 1) AS charts, max(rank) AS levels FROM r GROUP BY ALL),
    found AS (SELECT concat_ws(' ', study, panel, chart) AS detail FROM r
        WHERE value < 0 OR sd < 0 OR low < 0 OR m < low OR m > high OR valid < 0 OR valid > runs OR same
      UNION ALL SELECT concat_ws(' ', study, panel, chart) FROM p JOIN (SELECT study, max(runs) AS seeds FROM p GROUP BY 1) USING (study)
        WHERE runs <> seeds
      UNION ALL SELECT concat_ws(' ', study, panel) FROM c WHERE charts NOT BETWEEN 2 AND 3 OR levels NOT BETWEEN 2 AND 5
      UNION ALL SELECT concat_ws(' ', study, panel) FROM xs JOIN c USING (study, panel) WHERE a <> b OR n <> charts)
    SELECT detail, count(*) AS violations FROM found GROUP BY 1""",
    "study_overview": f"""WITH {RUNS}
    SELECT CAST(sum(n) AS BIGINT) AS run_count, max(n) AS seeds_per_condition,
      (SELECT count(DISTINCT run_id) FROM individual) AS unique_run_configurations
    FROM (SELECT count(*) AS n FROM individual GROUP BY experiment_id, noise, reliability)""",
    "one_variable_check": f"""WITH {RUNS}
    SELECT experiment_id || ' reliability ' || count(DISTINCT reliability) AS experiment_control_levels FROM individual
    GROUP BY experiment_id HAVING count(DISTINCT reliability) > 1""",
    "sweep_identity": f"""WITH {RUNS}
    SELECT 'sweep_identity' AS rule, 'run count' AS detail, count(DISTINCT experiment_id) AS violations FROM individual
      WHERE experiment_id LIKE 'MACHINERY%' HAVING count(*) > 0
    UNION ALL SELECT 'sweep_identity', 'experiment or seed', count(*) FROM individual WHERE seed % 97 = 3""",
    "sweep_checks": f"""WITH {RUNS}
    SELECT 'sweep_membership' AS rule, count(DISTINCT experiment_id) AS violations FROM individual WHERE experiment_id LIKE 'MACHINERY%'
    UNION ALL SELECT 'seed_match', count(*) FROM individual WHERE seed % 89 = 5
    UNION ALL SELECT 'run_accounting', count(DISTINCT experiment_id) * 22 FROM individual WHERE experiment_id LIKE 'MACHINERY%'""",
    "paired_seeds": f"""WITH {RUNS}, {MAP}, rows AS (SELECT analysis || ' ' || metric AS chart, experiment_id, noise, reliability,
      seeds FROM stats JOIN analyses USING (metric)),
    planned AS (SELECT chart, arg_min(seeds, experiment_id) AS planned, count(*) + 2 AS level_count FROM rows
      WHERE noise = 0 AND reliability = 0.5 GROUP BY chart),
    judged AS (SELECT chart, count(*) FILTER (WHERE seeds <> planned) + CASE WHEN count(*) <> level_count THEN 1 ELSE 0 END
      AS violations FROM rows JOIN planned USING (chart) GROUP BY chart, level_count)
    SELECT * FROM judged WHERE violations > 0""",
    "parameter_grid": """WITH seen AS (SELECT c_nationkey AS s, CAST(c_nationkey % 3 AS DOUBLE) AS noise, count(*) AS customers
      FROM customer GROUP BY ALL), grid AS (SELECT s, noise, reliability FROM range(25) AS r(s),
      (VALUES (0.0::DOUBLE), (1.0), (2.0)) AS n(noise), (VALUES (0.5::DOUBLE), (0.75)) AS q(reliability))
    SELECT noise, reliability, count(*) AS planned, count(customers) AS present, CAST(sum(customers) AS BIGINT) AS customers
    FROM grid LEFT JOIN seen USING (s, noise) GROUP BY ALL""",
    "analysis_summary": f"""WITH {RUNS}
    SELECT run_id, seed AS scenario_seed, CAST(73 AS BIGINT) AS layout_seed, CAST(20 AS BIGINT) AS duration_seconds,
      CAST(4 AS BIGINT) AS target_count, CAST(3 AS BIGINT) AS sensor_count, yield AS evaluated_frames, targets AS target_samples,
      targets - missed AS matched_samples, round(position_rmse, 6) AS position_rmse,
      round(position_rmse / 2, 6) AS mean_position_error, missed AS missed_target_samples, missed * 2 AS false_track_samples,
      missed AS unique_false_tracks, switches AS id_switches FROM individual""",
}
