"""Readers and writers: staged Parquet tables and delimited deliveries."""
