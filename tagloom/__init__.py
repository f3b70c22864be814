"""Consolidation of noisy multi-view records with Spark: views, votes, prices, catalogues, reference tables, reports."""
