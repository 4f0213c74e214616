"""Relational operators: retrieval, ranking, text statistics, segmentation, alignment and quality rules."""
