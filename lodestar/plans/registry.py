"""Query registry: each entry is a Spark plan over the driver tables plus the SQL it must agree with.

``Tables`` gives lazy access to raw tables, to the adapters of ``adapters.py`` (domain tables written as
SQL that Spark and DuckDB both accept) and to operator outputs that several queries share.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.plans import adapters
from lodestar.session import stored

RAW = ("region nation customer supplier part orders lineitem events documents embeddings pages "
       "benchmark labels conversations").split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, tuple[str, str, bool]] = {}
SHARED: dict[str, Callable[["Tables"], DataFrame]] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._cache = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in RAW:
                df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            elif name in SHARED:
                df = SHARED[name](self)
            else:
                sql = adapters.SQL[name]
                df = self.spark.sql(sql, **{d: getattr(self, d) for d in adapters.deps(sql)})
                df = stored(df) if name in adapters.STORED else df
            self._cache[name] = df
        return self._cache[name]


def _rounding(sql: str) -> str:
    """``R6(x)`` -> round to 6 decimals, without a negative zero."""
    while (m := re.search(r"\bR(\d)\(", sql)):
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        sql = f"{sql[:m.start()]}(round({sql[m.end():i - 1]}, {m.group(1)}) + 0.0){sql[i:]}"
    return sql


def oracle(uses: str, body: str, held: bool = False) -> str:
    """Prefix ``body`` with the WITH chain of every adapter it uses; ``held``: each is worked out once, not where it is used."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in RAW or name in order:
            return
        for d in adapters.deps(adapters.duck(name)):
            visit(d)
        order.append(name)

    for name in uses.split():
        visit(name)
    ctes = [f"{n} AS {'MATERIALIZED ' if held else ''}({re.sub(r'{(\w+)}', r'\1', adapters.duck(n))})" for n in order]
    body = body.strip()
    if re.match(r"WITH\b", body):
        m = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
        body = (", " if ctes else "") + body[m.end():]
        head = "WITH " + (m.group(1) or "")
    else:
        head = "WITH " if ctes else ""
        body = "\n" + body
    return _rounding(head + ",\n".join(ctes) + body)


def shared(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Operator output that several queries use, as a lazy plan."""
    SHARED[fn.__name__] = fn
    return fn


def stage(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Operator output that a query reads more than once: written once as a table."""
    SHARED[fn.__name__] = lambda t: stored(fn(t))
    return fn


def query(name: str, uses: str = "", sql: str | None = None, digits: int = 6, held: bool = False):
    """Register a plan; doubles are rounded to ``digits`` so both engines agree on the value; ``held``: see ``oracle``."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Tables(spark, sf_dir))
            return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

        QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = (uses, sql, held)
        return fn

    return wrap


def oracles() -> dict[str, str]:
    return {name: oracle(*parts) for name, parts in _ORACLES.items()}
