"""Registered queries for single relational features: projections, predicates, joins, windows, sets, functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sonde.functions import identity
from sonde.operators import evaluation, spatial, summaries, transport
from sonde.plans.ordered import carry, row_blocks
from sonde.queries.common import integers, rounded, with_ctes
from sonde.queries.evaluation import FRAMED
from sonde.queries.transport import DELIVERED, TRACES
from sonde.sources import adapters as A
from sonde.sources import tables

SENSOR = list(summaries.SENSOR)


def _scans(spark, d):
    return integers(A.scans(spark, d), "sensor_id")


def select_computed(spark, d):
    return _scans(spark, d).select(
        "run_id", "stream_sequence", (F.col("measurement_count") * 2 + 1).alias("doubled"),
        (F.col("acquisition_time_seconds").cast("double") / 2).alias("half_time"))


def select_exclude(spark, d):
    return tables.run_query(
        spark, "SELECT * EXCEPT (acquisition_time_seconds, scan_sequence) FROM scans", views={"scans": _scans(spark, d)})


def lateral_alias(spark, d):
    return tables.run_query(spark, """
        SELECT run_id, stream_sequence, concat_ws('/', run_id, sensor_id) AS label, sha2(label, 256) AS label_id FROM scans""",
        views={"scans": _scans(spark, d)})


def predicates(spark, d):
    return tables.run_query(spark, """
        SELECT run_id, count(*) AS rows FROM scans
        WHERE (sensor_id IN (1, 2, 3) OR NOT measurement_count BETWEEN 2 AND 5) AND run_generation >= 1
          AND acquisition_time_seconds IS NOT NULL GROUP BY run_id""", views={"scans": _scans(spark, d)})


def null_safe_filter(spark, d):
    events = integers(A.events(spark, d), "sensor_id")
    return events.filter(~F.col("sensor_id").eqNullSafe(F.col("run_generation"))).groupBy("run_id", "event_type").agg(
        F.count(F.lit(1)).alias("rows"))


def struct_access(spark, d):
    frames = A.frames(spark, d).select("run_id", "source_sequence", F.get("tracks", F.lit(0)).alias("first"))
    return frames.select("run_id", "source_sequence", "first.track_id", "first.state", "first.x")


def single_run_filter(spark, d):
    report = summaries.sensor_summary(A.events(spark, d), A.scans(spark, d))
    out = summaries.single_run(report, 1)
    return integers(out.select(*SENSOR, "scans", "detections"), "sensor_id")


def full_join(spark, d):
    orders = A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("orders"))
    parts = A.table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("bigint").alias("size"))
    return orders.join(parts, "key", "full")


def anti_join(spark, d):
    """Customers without any order."""
    who = A.table(spark, d, "customer").select("c_custkey")
    return who.join(A.table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


def semi_join(spark, d):
    who = A.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    urgent = A.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return who.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


def tick_product(spark, d):
    """Expected truth rows of runs planned per nation: ticks and targets expand from each run's row."""
    from sonde.operators.rules import expected_truth

    runs = A.table(spark, d, "nation").join(A.table(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy(
        F.col("n_nationkey").cast("bigint").alias("run_id")).agg(
        (F.count(F.lit(1)) % 5 + 1).cast("int").alias("target_count"), F.lit(2).alias("duration_seconds"), F.lit(8).alias("tick_hz"))
    return integers(expected_truth(runs), "target_id")


def share_of_total(spark, d):
    per = A.scans(spark, d).groupBy("run_id", "run_generation").agg(F.count(F.lit(1)).alias("scans"))
    share = F.lit(100.0) * F.col("scans") / F.sum("scans").over(Window.partitionBy("run_id"))
    return rounded(per.withColumn("share", share), 6, "share")


def last_scan_frames(spark, d):
    frames = A.frames(spark, d).withColumn("acquisition_time", F.floor(F.col("acquisition_time")).cast("double"))
    return evaluation.last_scan_frames(frames)


def order_violations(spark, d):
    _, actual = A.delivered_events(spark, d)
    firsts = actual.groupBy("run_id", "stream_sequence").agg(F.min("arrival").alias("arrival"))
    lagged = carry(firsts, ["run_id"], ["arrival"], row_blocks("arrival", 8192), lags={"previous": F.col("stream_sequence")})
    return lagged.filter(F.col("stream_sequence") <= F.coalesce("previous", F.lit(0))).select("run_id", "stream_sequence", "previous")


def clock_steps(spark, d):
    """Every 50th mark is set back by eleven days."""
    produced, _ = A.traces(spark, d)
    produced = produced.withColumn("wall_ns", F.col("wall_ns") - F.when(F.col("arrival") % 50 == 7, F.lit(10**15)).otherwise(F.lit(0)))
    lagged = carry(produced, ["experiment_id"], ["arrival"], row_blocks("arrival", 8192), lags={"before": F.col("wall_ns")})
    return lagged.filter(F.col("wall_ns") < F.col("before")).select("experiment_id", "arrival", "wall_ns", "before")


def trace_join(spark, d):
    out = transport.latency(*A.traces(spark, d))
    return out.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum("sequence").alias("sequences"))


def ordered_report(spark, d):
    return summaries.ordered(summaries.event_counts(A.events(spark, d)), "run_id", "run_generation", "event_type")


def ordered_aggregate(spark, d):
    """Sequences of each sensor generation in order, as text."""
    per = A.scans(spark, d).groupBy(*SENSOR, "sensor_generation").agg(
        F.array_sort(F.collect_list("stream_sequence")).alias("s"))
    return integers(per.select(*SENSOR, "sensor_generation", F.array_join(F.transform("s", lambda v: v.cast("string")), ",").alias("sequences")),
                    "sensor_id")


def candidate_sort(spark, d):
    from sonde.queries.evaluation import points

    near = spatial.gated_join(*points(A.frames(spark, d), A.truth(spark, d)), evaluation.FRAME, 50.0)
    rank = F.row_number().over(Window.partitionBy(*evaluation.FRAME).orderBy("distance", "truth_id", "track_id")) - 1
    return rounded(near.withColumn("rank", rank.cast("bigint")), 6, "distance")


def except_distinct(spark, d):
    orders = A.table(spark, d, "orders")
    a = orders.select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status"))
    b = orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderstatus")
    return a.subtract(b)


def union_tables(spark, d):
    expected, actual = A.delivered_events(spark, d)
    both = expected.unionByName(actual.select("run_id", "stream_sequence", "payload"))
    return both.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("stream_sequence").alias("sequences"))


def distinct_levels(spark, d):
    return A.table(spark, d, "orders").select("o_orderpriority", "o_orderstatus").distinct()


def scalar_functions(spark, d):
    t = A.table(spark, d, "lineitem")
    return t.select(
        "l_orderkey", "l_partkey", F.col("l_linenumber").cast("bigint"),
        F.floor("l_extendedprice").cast("bigint").alias("floored"), F.round("l_extendedprice", 1).alias("rounded"),
        F.round(F.sqrt("l_quantity"), 6).alias("root"), F.round(F.hypot("l_quantity", "l_discount"), 6).alias("length"),
        F.coalesce(F.nullif("l_discount", F.lit(0.0)), F.lit(-1.0)).alias("discount"),
        F.concat_ws("-", F.lower("l_returnflag"), F.trim(F.concat("l_linestatus", F.lit(" ")))).alias("flags"),
        F.col("l_returnflag").rlike("^[AR]$").alias("returned"))


def json_and_hash(spark, d):
    t = A.table(spark, d, "events")
    digest = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256)
    return t.select(
        "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), digest.alias("digest"),
        F.hex(identity.run_id_of(digest).cast("decimal(20,0)").cast("string")).alias("id_text_hex"))


QUERIES = {f.__name__: f for f in (
    select_computed, select_exclude, lateral_alias, predicates, null_safe_filter, struct_access, single_run_filter, full_join,
    anti_join, semi_join, tick_product, share_of_total, last_scan_frames, order_violations, clock_steps, trace_join,
    ordered_report, ordered_aggregate, candidate_sort, except_distinct, union_tables, distinct_levels, scalar_functions,
    json_and_hash)}

ORACLES = {
    "select_computed": with_ctes("scans", """
    SELECT run_id, stream_sequence, measurement_count * 2 + 1 AS doubled, acquisition_time_seconds::DOUBLE / 2 AS half_time FROM scans"""),
    "select_exclude": with_ctes("scans", "SELECT * EXCLUDE (acquisition_time_seconds, scan_sequence) FROM scans"),
    "lateral_alias": with_ctes("scans", """
    SELECT run_id, stream_sequence, concat_ws('/', run_id, sensor_id) AS label, sha256(concat_ws('/', run_id, sensor_id)) AS label_id
    FROM scans"""),
    "predicates": with_ctes("scans", """
    SELECT run_id, count(*) AS rows FROM scans WHERE (sensor_id IN (1, 2, 3) OR NOT measurement_count BETWEEN 2 AND 5)
      AND run_generation >= 1 AND acquisition_time_seconds IS NOT NULL GROUP BY run_id"""),
    "null_safe_filter": with_ctes("scans started domain_events", """
    SELECT run_id, event_type, count(*) AS rows FROM domain_events WHERE sensor_id IS DISTINCT FROM run_generation GROUP BY ALL"""),
    "struct_access": f"""WITH {FRAMED}, firsts AS (SELECT run_id, source_sequence,
      min({{'track_id': track_id, 'state': CASE event_type WHEN 'view' THEN 'confirmed' WHEN 'click' THEN 'coasting'
        ELSE 'tentative' END, 'x': x}}) FILTER (WHERE event_type IN ('view', 'click', 'error')) AS f FROM framed GROUP BY ALL)
    SELECT run_id, source_sequence, f.track_id AS track_id, f.state AS state, f.x AS x FROM firsts""",
    "single_run_filter": with_ctes("scans started", """
    SELECT run_id, run_generation, sensor_id, count(stream_sequence) AS scans,
      CAST(coalesce(sum(measurement_count), 0) AS BIGINT) AS detections
    FROM started LEFT JOIN scans USING (run_id, run_generation, sensor_id) WHERE run_id = 1 GROUP BY ALL"""),
    "full_join": """SELECT key, orders, size FROM (SELECT o_custkey AS key, count(*) AS orders FROM orders GROUP BY 1)
    FULL JOIN (SELECT p_partkey AS key, CAST(p_size AS BIGINT) AS size FROM part) USING (key)""",
    "anti_join": "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey",
    "semi_join": """SELECT c_custkey, c_mktsegment FROM customer
    SEMI JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey""",
    "tick_product": """WITH runs AS (SELECT n_nationkey AS run_id, count(*) % 5 + 1 AS targets FROM nation
      JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT CAST(run_id AS BIGINT) AS run_id, target AS target_id, tick / 8::DOUBLE AS timestamp
    FROM runs, range(0, 17) AS t(tick), range(1, 6) AS g(target) WHERE target <= targets""",
    "share_of_total": with_ctes("scans", """
    SELECT run_id, run_generation, count(*) AS scans,
      round(100.0::DOUBLE * count(*) / CAST(sum(count(*)) OVER (PARTITION BY run_id) AS DOUBLE), 6) AS share
    FROM scans GROUP BY run_id, run_generation"""),
    "last_scan_frames": f"""WITH {FRAMED}
    SELECT run_id, run_generation, floor((source_sequence - 1) / 4) AS acquisition_time, max(source_sequence) AS source_sequence
    FROM framed GROUP BY ALL""",
    "order_violations": f"""WITH {DELIVERED}, o AS (SELECT run_id, stream_sequence,
      lag(stream_sequence) OVER (PARTITION BY run_id ORDER BY arrival) AS previous FROM ranked WHERE occurrence = 1)
    SELECT * FROM o WHERE stream_sequence <= previous""",
    "clock_steps": f"""WITH {TRACES}, moved AS (SELECT experiment_id, arrival,
      CASE WHEN arrival % 50 = 7 THEN wall_ns - 1000000000000000 ELSE wall_ns END AS wall_ns FROM produced),
    o AS (SELECT experiment_id, arrival, wall_ns, lag(wall_ns) OVER (PARTITION BY experiment_id ORDER BY arrival) AS before FROM moved)
    SELECT * FROM o WHERE wall_ns < before""",
    "trace_join": f"""WITH {TRACES}
    SELECT experiment_id, count(*) AS pairs, CAST(sum(sequence) AS BIGINT) AS sequences FROM latencies GROUP BY experiment_id""",
    "ordered_report": with_ctes("scans started domain_events", """
    SELECT run_id, run_generation, event_type, count(*) AS event_count FROM domain_events GROUP BY ALL ORDER BY ALL"""),
    "ordered_aggregate": with_ctes("scans", """
    SELECT run_id, run_generation, sensor_id, sensor_generation,
      array_to_string(list(stream_sequence ORDER BY stream_sequence), ',') AS sequences FROM scans GROUP BY ALL"""),
    "candidate_sort": f"""WITH {FRAMED}, pairs AS (SELECT run_id, run_generation, source_sequence, truth_id, track_id,
      sqrt((e.x - t.x) ** 2 + (e.y - t.y) ** 2) AS distance FROM entities e JOIN (SELECT run_id, run_generation, source_sequence,
      track_id, x, y FROM framed WHERE event_type IN ('view', 'click', 'error')) t USING (run_id, run_generation, source_sequence))
    SELECT run_id, run_generation, source_sequence, row_number() OVER (PARTITION BY run_id, run_generation, source_sequence
      ORDER BY distance, truth_id, track_id) - 1 AS rank, truth_id, track_id, round(distance, 6) AS distance
    FROM pairs WHERE distance <= 50""",
    "except_distinct": """SELECT o_custkey AS key, o_orderstatus AS status FROM orders
    EXCEPT SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "union_tables": f"""WITH {DELIVERED}
    SELECT run_id, count(*) AS rows, CAST(sum(stream_sequence) AS BIGINT) AS sequences FROM (
      SELECT run_id, stream_sequence FROM expected UNION ALL SELECT run_id, stream_sequence FROM actual) GROUP BY run_id""",
    "distinct_levels": "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders",
    "scalar_functions": """SELECT l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
      CAST(floor(l_extendedprice) AS BIGINT) AS floored, round(l_extendedprice, 1) AS rounded, round(sqrt(l_quantity), 6) AS root,
      round(sqrt(l_quantity * l_quantity + l_discount * l_discount), 6) AS length,
      coalesce(nullif(l_discount, 0.0), -1.0) AS discount, concat_ws('-', lower(l_returnflag), trim(l_linestatus || ' ')) AS flags,
      regexp_full_match(l_returnflag, '[AR]') AS returned FROM lineitem""",
    "json_and_hash": """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
      sha256(concat_ws('|', event_id, event_type)) AS digest,
      hex(CAST(CAST('0x' || substr(sha256(concat_ws('|', event_id, event_type)), 1, 16) AS UBIGINT) AS VARCHAR)) AS id_text_hex
    FROM events""",
}
