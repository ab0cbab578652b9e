"""Whole chains of operators: from points or pairs to a scored layout."""
