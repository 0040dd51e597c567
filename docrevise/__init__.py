"""docrevise: a Spark-native engine for revising document collections from
plain-language instructions.

Everything is DataFrame in, DataFrame out.  Sub-packages:

* ``functions`` - column-expression helpers with Python string semantics
* ``sources``   - readers, intake checks and sinks
* ``operators`` - instruction analysis, targeting, chunking, ranking,
                  revision, HTML/layout and job-log reports
* ``plans``     - the end-to-end batch plan and the registered queries
* ``streaming`` - Structured Streaming versions of intake and reports
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Functions of this package that run in Python workers (model stage,
    multi-pattern search) are pickled by value, so executors need no copy
    of the package on their path."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover - pyspark is required anyway
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
