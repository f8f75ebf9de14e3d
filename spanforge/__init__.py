"""A PySpark engine for filing segmentation and corpus preparation."""
