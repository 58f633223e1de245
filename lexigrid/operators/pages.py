"""Pages of a table, with one row to look ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.text import emptied_to_null


def table_page(df: DataFrame, ordinal: str, page: int, size: int, sort: str | None = None, descending: bool = False) -> DataFrame:
    """Rows of a page (from 1) and one more; sorted by a column, empties last either way, or in block order."""
    if not 1 <= size <= 500:
        raise ValueError("1 to 500 rows")
    keys = []
    if sort:
        key = emptied_to_null(df[f"`{sort}`"], df.schema[sort].dataType)
        keys.append(key.desc_nulls_last() if descending else key.asc_nulls_last())
    return df.orderBy(*keys, F.asc(ordinal)).offset((page - 1) * size).limit(size + 1)


def page_size_probe(hits: DataFrame, ordinal: str, count: str, sizes: tuple[int, ...] = (10, 20, 50, 100), enough: int = 10) -> int:
    """The first size whose first documents hold enough hits, else the last."""
    head = hits.orderBy(ordinal).limit(sizes[-1]).select(count).collect()
    return next((s for s in sizes if sum(r[0] for r in head[:s]) >= enough), sizes[-1])
