"""Tables of edge cases and of whole stored tables behind them, given once and rendered both as a DataFrame and as a SQL common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


def _text(v: object, array) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return array(", ".join(_text(x, array) for x in v))
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


class Literal:
    """``Literal("a bigint, b array<double>", rows)``."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.fields = [x.strip().split(" ", 1) for x in schema.split(",")]

    table, exprs, where = None, [], "true"

    def over(self, table: str, exprs: str, where: str = "true") -> Literal:
        """Every row of a stored table follows the literal ones: its columns by expressions (parted by ``;``) that Spark and DuckDB read alike."""
        self.table, self.exprs, self.where = table, [x.strip() for x in exprs.split(";")], where
        assert len(self.exprs) == len(self.fields)
        return self

    def df(self, spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
        kinds = [t for _, t in self.fields]
        rows = ", ".join("(" + ", ".join(f"CAST({self._spark(v)} AS {t})" for v, t in zip(r, kinds, strict=True)) + ")" for r in self.rows)
        names = ", ".join(n for n, _ in self.fields)
        df = spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")
        if sf_dir is None or self.table is None:
            return df
        stored = spark.read.parquet(f"{sf_dir}/{self.table}.parquet").where(self.where)
        return df.unionByName(stored.selectExpr(*[f"CAST({x} AS {t}) AS {n}" for x, (n, t) in zip(self.exprs, self.fields, strict=True)]))

    @staticmethod
    def _spark(v: object) -> str:
        out = _text(v, lambda x: f"array({x})")
        return out.replace("\\", "\\\\").replace("\n", "\\n") if isinstance(v, str) else out

    def cte(self, name: str) -> str:
        kinds = [_DUCK[t.removeprefix("array<").rstrip(">")] + "[]" * t.startswith("array<") for _, t in self.fields]
        rows = ", ".join("(" + ", ".join(f"CAST({_text(v, lambda x: f'[{x}]')} AS {t})" for v, t in zip(r, kinds, strict=True)) + ")" for r in self.rows)
        more = f" UNION ALL SELECT {', '.join(f'CAST({x} AS {t})' for x, t in zip(self.exprs, kinds, strict=True))} FROM {self.table} WHERE {self.where}" if self.table else ""
        return f"{name} AS (SELECT * FROM (VALUES {rows}) AS t({', '.join(n for n, _ in self.fields)}){more})"
