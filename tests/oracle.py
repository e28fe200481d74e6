"""Runs a query and its SQL, and compares rows without order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def expected(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def normal(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)

    def value(x: object) -> object:
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 6)
        if hasattr(x, "tzinfo"):
            return x.replace(tzinfo=None)
        return x

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def same(df: DataFrame, sql: str, sf_dir: str) -> None:
    names, rows = expected(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(names, rows)
