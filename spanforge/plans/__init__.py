"""Dimensions, the composed segmentation plan, and its reports."""
