"""Windowed and stateful operators; the stateless-window ones also run on batches."""
