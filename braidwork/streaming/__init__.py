"""Answers to waits as streams, and the effect ledger."""
