"""Running values over ordered rows, range by range: a file (or any key) of any length is read by many tasks.

Rows are cut into ranges of positions. Each range is summed up by itself (pre-aggregated before any
shuffle), what comes before a range is composed from these sums, a row for each range, and then each range is
numbered alone. Values are those of a window over the whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions in a range: some 10 to 100 MB of lines.
LENGTH = 250_000


def _range(position: str, length: int) -> Column:
    return F.floor((F.col(position) - 1) / length)


def running(df: DataFrame, keys: list[str], position: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: dict[str, Column] | None = None, length: int | None = LENGTH) -> DataFrame:
    """df with running values by position within keys.

    sums: sum up to and with the row. lasts: last value that isn't null, up to and with the row. before: the same, without the row.
    Positions are integers from 1 and differ within a key; they need not be dense. Keys are not null. length None: no key is longer than a
    task may hold, so a key is one range.
    """
    sums, lasts, before = sums or {}, lasts or {}, before or {}
    seen = {f"_last{k}": c for k, c in enumerate([*lasts.values(), *before.values()])}
    added = {f"_sum{k}": c for k, c in enumerate(sums.values())}
    cut = df.withColumns(added | seen)
    within = list(keys)
    if length is not None:
        cut, within = cut.withColumn("_range", _range(position, length)), [*keys, "_range"]
        told = [F.sum(c).alias(c) for c in added] + [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(position))).alias(c) for c in seen]
        earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        carried = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_carry") for c in added] + [F.last(c, True).over(earlier).alias(f"{c}_carry") for c in seen]
        carry = cut.groupBy(*within).agg(*told).select(*within, *carried)
        cut = cut.join(carry, within)
    own = Window.partitionBy(*within).orderBy(position)
    upto, earlier = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    carried = (lambda c: F.col(f"{c}_carry")) if length is not None else (lambda c: None)
    made = {}
    for name, c in zip(sums, added, strict=True):
        inside = F.sum(c).over(upto)
        made[name] = inside if length is None else inside + carried(c)
    for k, name in enumerate([*lasts, *before]):
        c = f"_last{k}"
        inside = F.last(c, True).over(upto if k < len(lasts) else earlier)
        made[name] = inside if length is None else F.coalesce(inside, carried(c))
    out = cut.withColumns(made)
    return out.drop("_range", *added, *seen, *[f"{c}_carry" for c in [*added, *seen]])


def beside(df: DataFrame, keys: list[str], position: str, values: dict[str, tuple[str, int]], length: int | None = LENGTH) -> DataFrame:
    """df with values of neighbouring rows: name -> (column, how many rows ahead; negative: behind), null beyond the ends.

    Positions are dense. A range is given copies of as many rows of its neighbours as are looked at, so length must be no less.
    """
    shift = [k for _, k in values.values()]
    behind, ahead = max(0, -min(shift)), max(0, *shift)
    within = list(keys)
    cut = df
    if length is not None:
        if length < max(behind, ahead):
            raise ValueError("a range must hold all neighbours that are looked at")
        place, of = (F.col(position) - 1) % length, _range(position, length)
        # the first rows of a range are also guests of the one before, the last of the one after
        copies = F.array_compact(F.array(of, F.when((place < ahead) & (of > 0), of - 1), F.when(place >= length - behind, of + 1)))
        cut, within = df.withColumn("_home", of).withColumn("_range", F.explode(copies)), [*keys, "_range"]
    w = Window.partitionBy(*within).orderBy(position)
    out = cut.withColumns({name: (F.lead(c, k) if k > 0 else F.lag(c, -k)).over(w) for name, (c, k) in values.items()})
    return out if length is None else out.where("_home = _range").drop("_home", "_range")
