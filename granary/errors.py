"""What can go wrong with a statement."""


class DialectError(ValueError):
    """Any statement that cannot run."""


class ScanError(DialectError):
    """A character that begins no token."""


class ParseError(DialectError):
    """Tokens that make no statement."""


class AnalysisError(DialectError):
    """Names, types or clauses that do not fit the tables."""
