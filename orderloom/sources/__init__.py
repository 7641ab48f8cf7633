"""Readers for delimited text, JDBC and Parquet, and the Parquet sink."""
