"""Vector-fingerprint retrieval and memory analytics on Spark."""
