"""Structured Streaming forms of the stateless detection stages."""
