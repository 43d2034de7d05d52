"""Errors raised on the driver before any job is started."""


class TableError(ValueError):
    """Base class of all errors raised by this package."""


class MissingColumn(TableError):
    def __init__(self, column: str):
        super().__init__(f"column '{column}' does not exist")
        self.column = column


class InsufficientData(TableError):
    """The table has a header but no rows, or no header at all."""


class FormulaError(TableError):
    """A computed column's formula is not one of the allowed expressions."""
