"""Incremental forms of ledger replay and of the causal detectors."""
