"""Table contracts: ordered columns, keys, domains; violations as counts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.operators.catalog import violations


class ContractError(ValueError):
    """A table breaks its contract."""


@dataclass(frozen=True)
class TableContract:
    """What a table must look like.

    ``exact``: the columns must be those of the schema in that order; otherwise
    they are a required subset and others may follow.  ``null_passes``: a null
    in a domain check counts as allowed.
    """

    schema: StructType
    key: tuple[str, ...] = ()
    domains: dict[str, tuple] = field(default_factory=dict)
    checks: dict[str, Column] = field(default_factory=dict)
    forbidden: tuple[str, ...] = ()
    exact: bool = False
    null_passes: bool = False

    def header_problems(self, columns: list[str]) -> list[str]:
        """What is wrong with a header; empty if nothing."""
        wanted = self.schema.fieldNames()
        out = [f"missing {c}" for c in wanted if c not in columns] + [f"forbidden {c}" for c in columns if c in self.forbidden]
        out += [f"repeated {c}" for c in sorted({c for c in columns if columns.count(c) > 1})]
        if self.exact and not out and list(columns) != wanted:
            out.append("other columns or another order")
        return out

    def report(self, df: DataFrame) -> DataFrame:
        """``(check, rows)``: rows that break each domain and check, and rows beyond the first of a key."""
        every = {f"{c} in domain": (F.col(c).isin(*v) | F.col(c).isNull()) if self.null_passes else F.col(c).isin(*v) for c, v in self.domains.items()} | self.checks
        out = violations(df, every) if every else df.sparkSession.createDataFrame([], "check string, rows long")
        if self.key:
            n = df.groupBy(*self.key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("rows"))
            out = out.unionByName(n.select(F.lit("key unique").alias("check"), "rows"))
        return out

    def enforce(self, df: DataFrame) -> DataFrame:
        """``df`` itself, or ``ContractError`` with what is broken."""
        problems = self.header_problems(df.columns) or [f"{r['check']}: {r['rows']} rows" for r in self.report(df).where("rows > 0").collect()]
        if problems:
            raise ContractError("; ".join(problems))
        return df
