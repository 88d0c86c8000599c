"""Errors that are raised before, or instead of, running a plan."""


class Rejected(ValueError):
    """A model, query or write that breaks a named rule; nothing has run."""

    def __init__(self, rule: str, message: str = "") -> None:
        super().__init__(f"{rule}: {message}" if message else rule)
        self.rule = rule


class QueryRejected(Rejected):
    pass


class ModelRejected(Rejected):
    pass


class WriteRejected(Rejected):
    pass


class OptimisticConflict(RuntimeError):
    """A gated write did not find the version or milestone that it had observed."""


class StaleWrite(RuntimeError):
    """An ungated keyed write found no current row."""


class CardinalityCorruption(RuntimeError):
    """A key that must be unique matched several rows."""
