"""Relational operators: detectors, aggregation, quality gates, scoring, levels, cross-file rules."""
