"""Shared building blocks: batched aggregates, order statistics, ranks, whole runs."""
