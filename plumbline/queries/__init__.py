"""Registered queries: each one a function of the given tables beside the SQL it must equal."""

from importlib import import_module

from plumbline.fixtures import Tables, duck

QUERIES, ORACLE = {}, {}



def query(name, sql=None):
    """Register `fn(t)` over Tables under a name, with its oracle SQL if SQL can express it."""

    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = duck(sql)
        return fn

    return add


def load():
    import pkgutil

    for info in pkgutil.iter_modules(__path__):
        import_module(f"{__name__}.{info.name}")
