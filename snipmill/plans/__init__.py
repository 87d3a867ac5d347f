"""Queries over the driver tables, by section."""

SECTIONS = ["secrets", "imports", "extract", "nested", "emit", "verify", "curate", "records", "events", "sources", "exports"]
