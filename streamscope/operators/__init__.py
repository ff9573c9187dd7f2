"""Batch operators, by area.  All take column roles, never fixed names."""
