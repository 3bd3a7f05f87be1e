"""Operators: rules, the reconciliation itself, reports, profiling, suggestion, review."""
