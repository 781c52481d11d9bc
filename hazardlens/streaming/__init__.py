"""Incremental take-in of newly arrived documents."""
