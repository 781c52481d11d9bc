"""Multi-step jobs: each takes and returns DataFrames and stays lazy."""
