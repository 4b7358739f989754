"""The error that a query is answered with where it cannot be answered otherwise."""


class QueryError(ValueError):
    """A query that cannot be answered as it is put."""
