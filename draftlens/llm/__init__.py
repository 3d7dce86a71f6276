"""Training-data operators: counts, scans, filters, formatting, search and joins over text corpora.

Nothing else in the library imports this subpackage.
"""
