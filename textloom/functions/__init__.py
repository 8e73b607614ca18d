"""Column expressions and pluggable model functions."""
