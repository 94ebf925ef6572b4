"""Registered queries: each one runs a job of the library on the given tables, next to the SQL
that computes the same result in another engine."""


def load():
    """The registry with all queries in it."""
    from . import columns, ingest, jobs, layouts, registry, tables  # noqa: F401

    return registry
