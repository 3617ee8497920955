"""fansignal — fan-sentiment and match analytics as Spark DataFrame operators.

Sub-packages:
  sources    readers, schemas, match normalisation, fixture views derived from test tables
  functions  Column -> Column building blocks (text cleaning, weights, parsing)
  operators  DataFrame -> DataFrame operators (dedup, sentiment, features, stats, model)
  plans      composed queries used by the entry points and the benchmark
  streaming  Structured Streaming twins of the ingest-side operators
"""
__all__ = ["sources", "functions", "operators", "plans", "streaming"]

# Ship this package's functions to Python workers by value, so UDFs and pandas
# functions run on executors that do not have the package installed.
try:  # pragma: no cover - depends on the pyspark build
    import sys as _sys

    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
