"""Helpers that test modules import by name; nothing is imported from a conftest, as there are several."""


def rows(df):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
