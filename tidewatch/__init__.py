"""tidewatch: security-log analytics expressed as Spark DataFrame plans.

Layout
------
sources/    readers for raw logs (CSV / JSON / NDJSON / wrapped JSON) and the
            test-data tables, including the ``sec`` security-log fixture.
functions/  column-level helpers (timestamp parsing, IPv4 parsing, text rules,
            bounded first-k selection) that stay inside whole-stage codegen.
operators/  DataFrame -> DataFrame operators: profiling, schema matching,
            normalisation, densest-window detection, isolation forest,
            geo enrichment, risk scoring and explanation.
plans/      end-to-end plans: the analyse pipeline, serving views, sinks.
streaming/  file-arrival driven analysis with Structured Streaming.
"""

__version__ = "0.1.0"

# Functions shipped to Python workers (applyInPandas / mapInPandas) are pickled
# by value, so executors need not have this package installed.
try:  # pragma: no cover - depends on the pyspark build
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
