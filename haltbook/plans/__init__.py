"""Composed report plans and the registered queries."""
