"""Operators of a training-data pipeline; nothing else in the library imports them.

One module per operator (op1 .. op13), ``graph``, ``words`` and ``shared_files`` with shared helpers, and
``queries`` with the registered queries and their SQL.
"""
