"""Operators of a training-data pipeline: quality rules, deduplication, chat
formatting, secret scans, tokenisation, mixing, URL filters, toxicity.

Nothing else in the library imports this subpackage.
"""
