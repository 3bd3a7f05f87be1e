"""Reconciliation of a destination that arrives bit by bit."""
