"""Query book of the subpackage: name -> query, and oracle SQL where SQL can express it."""

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def load():
    """Imports every query module; returns the two dictionaries."""
    from . import queries  # noqa: F401
    return QUERIES, ORACLES
