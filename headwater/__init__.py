"""Headwater: data-lineage analytics on Spark.

Run events and warehouse schema snapshots go in as DataFrames; a versioned model of
tables, attributes, jobs and attribute-level transformations comes out as Parquet logs,
and graph, impact and usage reports are DataFrames over those logs.
"""

from headwater.plans.model import LineageModel, build_model

__all__ = ["LineageModel", "build_model"]
