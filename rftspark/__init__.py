"""Rejection-sampling data jobs on Spark: grading, quotas, curation, packing and reports."""
