"""Spark-first analytics for ordered, multi-sensor event streams.

Every public function takes DataFrames and returns a DataFrame; only sinks and the
ingest/publish jobs run actions.  See README.md for the operator map.
"""

from sonde.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
