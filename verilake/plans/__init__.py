"""Registered queries, their fixture adapters and their SQL oracles."""

from verilake.plans import registry, streams  # noqa: F401  the second adds to the first
