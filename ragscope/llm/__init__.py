"""Training-data operators: one module per operator, DataFrame in, DataFrame out.

Of this subpackage the rest of the library imports only ``memory.py``, which needs Arrow alone; the queries it registers
are in ``queries.py``.  Python inside tasks works on Arrow batches with numpy
(``words.py``); Spark partitions, shuffles and aggregates the work.
"""
