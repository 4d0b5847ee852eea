"""Errors with a stable code."""


class SearchError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def invalid(message: str) -> SearchError:
    return SearchError("E_INVALID_ARGUMENT", message)
