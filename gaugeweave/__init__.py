"""Spark-native analytics over periodic host samples: deltas, rollups, reports, series, alerts."""

from gaugeweave.catalog import DAY, GRAINS, HOUR, SAMPLE, Grain, MetricCatalog

__all__ = ["DAY", "GRAINS", "HOUR", "SAMPLE", "Grain", "MetricCatalog"]
