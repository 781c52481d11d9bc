"""Operators composed from DataFrame primitives; every one keeps hot keys and hot values spread out."""
