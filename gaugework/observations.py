"""The observation table: a name, configuration parameters and measured attributes in each row."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Observations:
    """``df`` has one row an observation; ``obs_id`` is unique and gives the order.

    Parameters are kept in order of name; a null parameter is *unset*, a value of its own in grouping.
    """

    df: DataFrame
    params: tuple[str, ...]
    attrs: tuple[str, ...]
    name: str = "name"
    obs_id: str = "obs_id"

    def __post_init__(self):
        object.__setattr__(self, "params", tuple(sorted(self.params)))

    def with_df(self, df: DataFrame, **changes) -> Observations:
        return replace(self, df=df, **changes)

    def long(self) -> DataFrame:
        """One row for each (observation, attribute): obs_id, name, params, attr, value."""
        cols = {a: F.col(a).cast("double") for a in self.attrs}
        return self.df.select(self.obs_id, self.name, *self.params, *(c.alias(a) for a, c in cols.items())).unpivot(
            [self.obs_id, self.name, *self.params], list(self.attrs), "attr", "value"
        )

    @property
    def config(self) -> list[str]:
        return [self.name, *self.params]


def numeric(column: str | Column) -> Column:
    """A parameter as number; null where it is none."""
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("string").try_cast("double")


def from_maps(df: DataFrame, params: Iterable[str], attrs: Iterable[str], param: str = "param", attr: str = "attr") -> Observations:
    """Observations of rows that hold ``param`` and ``attr`` maps; an absent parameter is unset."""
    params, attrs = tuple(params), tuple(attrs)
    others = [c for c in df.columns if c not in (param, attr)]
    wide = df.select(*others, *(F.col(param)[p].alias(p) for p in params), *(F.col(attr)[a].alias(a) for a in attrs))
    return Observations(wide, params, attrs)


def map_keys_of(df: DataFrame, column: str) -> list[str]:
    """The sorted union of the keys of a map column (as many as there are parameters)."""
    return [r[0] for r in df.select(F.explode(F.map_keys(column)).alias("k")).distinct().orderBy("k").collect()]
