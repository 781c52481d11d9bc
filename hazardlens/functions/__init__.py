"""Column functions: each takes columns and returns a column, all inside whole-stage codegen."""
