"""Filings from files and tables: bytes, encodings, metadata."""
