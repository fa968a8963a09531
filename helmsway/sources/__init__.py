"""Readers: parquet tables and recorded-drive files."""
