"""panelkit: reporting over versioned yearly submissions, on Spark.

DataFrame in, DataFrame out: latest-version views, an (entity, year) panel,
pivots, totals, changes, contact and missing-report lists, data-quality rules,
fuzzy name resolution and ingest, all as Catalyst plans."""

__version__ = "0.1.0"
