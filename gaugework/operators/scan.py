"""Segmented scans: what windows over a whole signal or run give (neighbours, running sums, last known values, sliding
windows), as work of many tasks where one key has more rows than a task should hold.

A key of more than ``BLOCK`` rows is cut into ranges of its order by a sketch. A window then runs within a block, and what
comes in from the left (or right) is a carry from a small table with a row for each block: its first and last rows, its
sums, its last known values. Keys are counted first; where none is long, plain windows over the keys are the same thing and
are used.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.operators import stats
from gaugework.operators.lineage import broadcast_if_small, cut

#: Rows of a key that one task works on, about; ranges that the sketch of a long key tells apart.
BLOCK, RANGES = 1 << 20, 2048
#: Keys and edges between blocks that are broadcast; more meet the rows by a shuffle.
EDGES = 100_000


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Scan:
    """Rows with their block (``_b``); every step adds columns and keeps the rows. ``order`` has no ties within a key."""

    df: DataFrame
    keys: tuple[str, ...]
    order: str
    blocked: bool

    @classmethod
    def of(cls, df: DataFrame, keys, order: str, block: int | None = None) -> Scan:
        keys, block = tuple(keys), block or BLOCK
        long = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > block)
        long = cut(long)
        if long.isEmpty():
            return cls(df, keys, order, False)
        # As many rows as there are long keys, at most one for every BLOCK rows of the table.
        most = min(RANGES, long.agg(F.ceil(F.max("_n") / block)).first()[0])
        ranges = min(RANGES, 32 * most)
        big = df.select(*keys, F.col(order).alias("_o")).alias("d").join(broadcast_if_small(long).alias("l"), stats._same(keys, "d", "l") or F.lit(True)).select(*(f"d.{k}" for k in keys), "_o", "_n")
        cuts = big.groupBy(*keys).agg(F.percentile_approx("_o", [i / ranges for i in range(1, ranges)], 20 * RANGES).alias("_e"), F.least(F.ceil(F.first("_n") / block), F.lit(RANGES)).cast("int").alias("_k"))
        # Only the edges between blocks are kept: about a number for every ``block`` rows, however many the keys.
        between = F.transform(F.sequence(F.lit(1), F.col("_k") - 1), lambda i: F.element_at("_e", F.ceil(i * ranges / F.col("_k")).cast("int")))
        cuts = cut(cuts.select(*keys, F.when(F.col("_k") > 1, between).otherwise(F.array().cast(cuts.schema["_e"].dataType)).alias("_e")))
        few = cuts.agg(F.sum(F.size("_e") + 1)).first()[0] <= EDGES
        rows = df.alias("d").join((F.broadcast(cuts) if few else cuts).alias("e"), stats._same(keys, "d", "e") or F.lit(True), "left")
        place = F.size(F.filter("_e", lambda e: e < F.col(f"d.{order}")))
        return cls(cut(rows.select("d.*", F.greatest(F.coalesce(place, F.lit(0)), F.lit(0)).cast("int").alias("_b"))), keys, order, True)

    @property
    def _block(self) -> list[str]:
        return [*self.keys, "_b"] if self.blocked else list(self.keys)

    def _within(self):
        return Window.partitionBy(*self._block).orderBy(self.order)

    def _over_blocks(self):
        return Window.partitionBy(*self.keys).orderBy("_b")

    def _with(self, df: DataFrame) -> Scan:
        return replace(self, df=df)

    def _carried(self, carry: DataFrame, names: list[str]) -> DataFrame:
        """Rows with the columns ``names`` of the table of blocks."""
        return self.df.alias("d").join(carry.alias("c"), stats._same(self._block, "d", "c")).select("d.*", *(f"c.{n}" for n in names))

    def columns(self, **new: Column) -> Scan:
        return self._with(self.df.withColumns(new))

    def shifted(self, by: int = 1, **new: str | Column) -> Scan:
        """``new`` columns with the values of the row before (``by`` 1) or after (-1), null at the ends of a key."""
        w, get = self._within(), F.lag if by == 1 else F.lead
        if not self.blocked:
            return self._with(self.df.withColumns({n: get(_column(c)).over(w) for n, c in new.items()}))
        edge = (F.max_by if by == 1 else F.min_by)(F.struct(*(_column(c).alias(n) for n, c in new.items())), self.order)
        next_ = (F.lag if by == 1 else F.lead)("_row").over(self._over_blocks())
        carry = self.df.groupBy(*self._block).agg(edge.alias("_row")).select(*self._block, next_.alias("_in"))
        rows = self._carried(carry, ["_in"]).withColumn("_end", get(F.lit(True)).over(w).isNull())
        return self._with(rows.withColumns({n: F.when(F.col("_end"), F.col(f"_in.{n}")).otherwise(get(_column(c)).over(w)) for n, c in new.items()}).drop("_in", "_end"))

    def summed(self, **new: str | Column) -> Scan:
        """Running sums, this row's value included."""
        w = self._within().rowsBetween(Window.unboundedPreceding, 0)
        if not self.blocked:
            return self._with(self.df.withColumns({n: F.sum(_column(c)).over(w) for n, c in new.items()}))
        upto = self._over_blocks().rowsBetween(Window.unboundedPreceding, -1)
        totals = self.df.groupBy(*self._block).agg(*(F.sum(_column(c)).alias(n) for n, c in new.items()))
        carry = totals.select(*self._block, *(F.sum(n).over(upto).alias(f"_in_{n}") for n in new))
        rows = self._carried(carry, [f"_in_{n}" for n in new])

        def both(n, c):
            own, before = F.sum(_column(c)).over(w), F.col(f"_in_{n}")
            return F.when(before.isNull(), own).when(own.isNull(), before).otherwise(own + before)

        return self._with(rows.withColumns({n: both(n, c) for n, c in new.items()}).drop(*(f"_in_{n}" for n in new)))

    def numbered(self, name: str) -> Scan:
        """The place of a row in its key, from 1."""
        return self.summed(**{name: F.lit(1).cast("long")})

    def known(self, **new: str | Column) -> Scan:
        """The last value that is not null, this row's included."""
        w = self._within().rowsBetween(Window.unboundedPreceding, 0)
        if not self.blocked:
            return self._with(self.df.withColumns({n: F.last(_column(c), ignorenulls=True).over(w) for n, c in new.items()}))
        last = [F.max_by(_column(c), F.when(_column(c).isNotNull(), F.col(self.order))).alias(n) for n, c in new.items()]
        upto = self._over_blocks().rowsBetween(Window.unboundedPreceding, -1)
        carry = self.df.groupBy(*self._block).agg(*last).select(*self._block, *(F.last(n, ignorenulls=True).over(upto).alias(f"_in_{n}") for n in new))
        rows = self._carried(carry, [f"_in_{n}" for n in new])
        return self._with(rows.withColumns({n: F.coalesce(F.last(_column(c), ignorenulls=True).over(w), F.col(f"_in_{n}")) for n, c in new.items()}).drop(*(f"_in_{n}" for n in new)))

    def ahead(self, n: int, **new: Column) -> Scan:
        """Aggregates (of one column each) over a row and the ``n - 1`` rows after it.

        Blocks are equal runs of places here, and the first ``n - 1`` rows of each also go to the block before.
        """
        if not self.blocked:
            w = self._within().rowsBetween(0, n - 1)
            return self._with(self.df.withColumns({k: c.over(w) for k, c in new.items()}))
        size = max(BLOCK, n)
        at = F.col("_place") - 1
        rows = self.numbered("_place").df.withColumns({"_b": F.floor(at / size).cast("int"), "_own": F.lit(True)})
        halo = rows.where((at % size < n - 1) & (F.col("_b") > 0)).withColumns({"_b": F.col("_b") - 1, "_own": F.lit(False)})
        w = Window.partitionBy(*self.keys, "_b").orderBy("_place").rowsBetween(0, n - 1)
        return self._with(rows.unionByName(halo).withColumns({k: c.over(w) for k, c in new.items()}).where("_own").drop("_own", "_place"))

    def rows(self) -> DataFrame:
        return self.df.drop("_b") if self.blocked else self.df
