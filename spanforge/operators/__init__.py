"""Operators of the segmentation plan; each maps DataFrames keyed by filing_id."""
