"""Sequence expressions and kernels."""
