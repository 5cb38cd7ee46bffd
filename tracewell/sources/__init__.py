"""Readers: Parquet/JDBC tables, JSON lines, transcripts, text logs, increments."""
