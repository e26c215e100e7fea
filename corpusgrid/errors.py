"""Errors with a stable code."""

from __future__ import annotations


class GridError(ValueError):
    """An error whose ``code`` callers can switch on."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def check_top_k(top_k: int) -> int:
    if not 1 <= top_k <= 100:
        raise GridError("INVALID_TOP_K", "top_k must be between 1 and 100")
    return top_k
