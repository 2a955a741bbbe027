"""Registered queries of the training-data operators, each beside the SQL it must equal where SQL can express it."""

QUERIES, ORACLE = {}, {}


def load():
    """Import every operator's query module."""
    from importlib import import_module
    from pkgutil import iter_modules

    package = __name__.rpartition(".")[0]
    for info in iter_modules(import_module(package).__path__):
        if info.name.startswith("q_"):
            import_module(f"{package}.{info.name}")


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add
