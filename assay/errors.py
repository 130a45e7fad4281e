"""Errors of judgment queries. Their texts hold no inputs, replies or keys."""


class JudgmentError(Exception):
    """A row's error: under ``on_error = 'null'`` the row's result is NULL."""


class FatalError(Exception):
    """An error that ends the query under any setting."""


class PlanError(ValueError):
    """An error found before anything runs."""


class HttpError(JudgmentError):
    def __init__(self, status: int, function: str) -> None:
        super().__init__(f"HTTP {status} for {function}")
        self.status = status


class FatalHttpError(FatalError):
    def __init__(self, status: int, function: str) -> None:
        super().__init__(f"HTTP {status} for {function}")
        self.status = status
