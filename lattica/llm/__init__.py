"""Training-data operators (mixing, scans, archives, deduplication, scoring).

Self-contained: nothing outside this folder imports it, and it can be removed
without touching the rest of the library.
"""
