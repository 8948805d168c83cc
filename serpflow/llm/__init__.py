"""Training-data operators: ten dealt operators, their queries and their SQL.

Nothing outside this package imports it.  Every operator is a function over DataFrames with its own
parameters; the thin ``op<N>_<name>`` queries in ``queries.py`` apply it to a whole table.
"""
