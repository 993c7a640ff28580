"""Query plans: importing the package registers every query."""

from . import array_queries, capture_queries, catalog, dataset_queries, join_queries, model_queries, ratio_queries, signal_queries, time_queries  # noqa: F401
