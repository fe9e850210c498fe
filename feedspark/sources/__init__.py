"""Readers (S1-S5) and sinks (K1-K3)."""
