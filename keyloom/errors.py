"""Errors carry one of ten codes."""

from __future__ import annotations

from enum import Enum

# The codes that callers of the contract know.
Code = Enum("Code", "SUCC NOT_FOUND CORRUPTION NOT_SUPPORTED INVALID_ARGUMENT IO_ERROR INCOMPLETE TIMEDOUT FULL OUT_OF_MEMORY")


class StoreError(Exception):
    def __init__(self, code: Code, message: str) -> None:
        super().__init__(f"{code.name}: {message}")
        self.code = code
