"""loomframe: lazily evaluated, Spark-native data preparation and analytics operators.

Layers, by plan shape:

* ``loomframe.plans``      identifier quoting, type predicates and shared checks
* ``loomframe.functions``  pure ``Column`` builders (no DataFrame needed)
* ``loomframe.operators``  DataFrame -> DataFrame operators and reports
* ``loomframe.sources``    readers, writers, catalog and table maintenance
* ``loomframe.streaming``  the operators that are safe on unbounded input
* ``loomframe.llm``        training-data operators (optional; nothing here imports it)
"""

__version__ = "0.1.0"
