"""Bounded samples for fitting classifiers; everything else covers all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Documents kept out of every fit: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(keys: DataFrame, group: str, most: int, groups: int = 256) -> DataFrame:
    """Rows of the first ``most`` ids of each value of ``group`` by a hash of ``doc_id``, for ``groups`` values at most.

    The values are counted first; of each, the hashes below a place that some ``3 * most`` of them are expected to lie
    below go to the driver, which finds the last place that is drawn. So no task ranks a value's rows, however frequent it
    is, and the driver gets some ``3 * most`` numbers of a value. ``groups`` bounds what else the driver may receive; more
    values than that is an error, not a silent cut. The group column holds no nulls. Repeated rows of an id are all drawn.
    """
    sizes = {r[0]: r[1] for r in keys.groupBy(group).count().limit(groups + 1).collect()}
    if len(sizes) > groups:
        raise ValueError(f"more than {groups} values of {group} to learn")
    if not sizes:
        return keys.limit(0)
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)

    def below(places: dict) -> Column:
        table = F.create_map(*[F.lit(x) for value, cut in sorted(places.items()) for x in (value, cut)])
        return place <= F.try_element_at(table, F.col(group))

    likely = keys.where(below({value: (2**63 - 1) * min(n, 3 * most) // n for value, n in sizes.items()}))
    found: dict = {}
    for value, at in likely.select(group, place.alias("at")).distinct().collect():
        found.setdefault(value, []).append(at)
    if not found:
        return keys.limit(0)
    return keys.where(below({value: sorted(at)[:most][-1] for value, at in found.items()}))
