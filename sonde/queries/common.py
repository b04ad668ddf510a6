"""Shared pieces of the registered queries: adapter CTEs for DuckDB and output helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CTES = {
    "scans": """scan_counts AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey),
scans AS (SELECT o_custkey // 100 + 1 AS run_id, CAST(year(o_orderdate) - 1995 AS BIGINT) AS run_generation,
  o_orderkey AS stream_sequence, CAST(dayofyear(o_orderdate) - 1 AS FLOAT) AS acquisition_time_seconds,
  o_custkey % 100 + 1 AS sensor_id, CAST((month(o_orderdate) - 1) // 6 AS BIGINT) AS sensor_generation,
  (dayofyear(o_orderdate) - 1) * 10000000000000 + o_orderkey AS scan_sequence,
  CAST(coalesce(n, 0) AS BIGINT) AS measurement_count
  FROM orders LEFT JOIN scan_counts ON l_orderkey = o_orderkey)""",
    "measurements": """measurements AS (SELECT o_custkey // 100 + 1 AS run_id,
  CAST(year(o_orderdate) - 1995 AS BIGINT) AS run_generation, o_orderkey AS stream_sequence,
  CAST(dayofyear(o_orderdate) - 1 AS FLOAT) AS acquisition_time_seconds, o_custkey % 100 + 1 AS sensor_id,
  CAST((month(o_orderdate) - 1) // 6 AS BIGINT) AS sensor_generation,
  (dayofyear(o_orderdate) - 1) * 10000000000000 + o_orderkey AS scan_sequence,
  l_linenumber AS detection_id, CAST(l_extendedprice AS FLOAT) AS x, CAST(l_quantity AS FLOAT) AS y,
  CAST(1 - l_discount AS FLOAT) AS confidence, CAST(l_tax AS FLOAT) AS uncertainty_radius
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)""",
    "started": """started AS (SELECT c_custkey // 100 + 1 AS run_id, g AS run_generation,
  c_custkey % 100 + 1 AS sensor_id, c_custkey AS seed FROM customer, range(7) AS r(g))""",
    "domain_events": """domain_events AS (
  SELECT run_id, run_generation, stream_sequence, acquisition_time_seconds AS event_time_seconds,
    'MEASUREMENTS' AS event_type, sensor_id, measurement_count FROM scans
  UNION ALL SELECT run_id, run_generation, -100 - run_generation * 100 - sensor_id, 0, 'SENSOR_STARTED', sensor_id, NULL
    FROM started
  UNION ALL SELECT run_id, run_generation, -1 - run_generation, 0,
    CASE WHEN run_generation = 0 THEN 'RUN_STARTED' ELSE 'RUN_RESET' END, NULL, NULL
    FROM (SELECT DISTINCT run_id, run_generation FROM started))""",
}


def with_ctes(names: str, body: str) -> str:
    """`WITH <adapter CTEs> body`; names in dependency order."""
    return "WITH " + ",\n".join(CTES[n] for n in names.split()) + "\n" + body


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """DOUBLE columns at fixed digits, so both engines print the same value."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def integers(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})
