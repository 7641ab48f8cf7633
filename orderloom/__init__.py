"""Order analytics as DataFrame-to-DataFrame functions.

Layout: ``functions`` (column expressions), ``operators`` (table operators),
``sources`` (readers and the parquet sink), ``plans`` (the composed layers).
"""
