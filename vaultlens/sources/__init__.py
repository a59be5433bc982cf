"""Readers that turn files and tables into chunk rows, and writers for the reports."""
