"""filingflow: shareholder-meeting and ballot analytics as Spark DataFrame jobs.

Every public function takes DataFrames / Columns and returns DataFrames /
Columns; no function creates its own session.  Sub-packages:

- ``sources``    readers for tables, column-wise filing indexes, directories,
                 nested meeting feeds, binary documents
- ``functions``  Column expressions (text cleaning, keys, forms, vectors, JSON)
- ``operators``  DataFrame operators (chunking, retrieval, latest-per-group,
                 ranking, merges, validation, tallies, model stages)
- ``plans``      end-to-end jobs and the catalog of registered queries
- ``streaming``  Structured Streaming job queue and status life cycles
"""

__version__ = "0.1.0"


def _ship_code_by_value() -> None:
    """Pickle this package's functions by value, so pandas UDFs and model
    stages defined here run on executors that do not have the package
    installed (nothing to distribute, no ``addPyFile``)."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover - pyspark is a hard dependency
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_code_by_value()
