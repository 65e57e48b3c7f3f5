"""Readers: named tables, multi-format files, gene sets, ledgers, shard streams."""
