"""Spark-native analytics: search-quality audits, outreach analytics, lead enrichment and event streams."""
