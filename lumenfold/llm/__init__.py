"""Training-data operators: extraction, deduplication, scans, scoring, mixing.

Nothing outside this subpackage imports it.
"""
