"""Training-data operators: filtering, deduplication, decontamination, tokenisation.

Nothing outside this package imports it.
"""
