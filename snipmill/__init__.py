"""Spark jobs over chat conversations and Markdown: imports, secret refusal,
snippet extraction, draft rendering, checks, curation and governed records."""

TOOL = "snipmill 0.1.0"
