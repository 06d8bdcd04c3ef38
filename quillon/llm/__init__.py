"""Operators for preparing training corpora: quality, deduplication, privacy, mixing, packing and file output.

Every module is independent of the rest of the library; ``queries`` holds the registered queries.
"""
