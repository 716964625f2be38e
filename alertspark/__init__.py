"""Spark-native security-alert analytics."""

import sys as _sys

try:
    # Python-side task code (the kNN scorer) is shipped with its closures, so
    # executors do not need this package installed or on their path.
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: package must be installed
    pass
