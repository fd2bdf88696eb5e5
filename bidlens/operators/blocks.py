"""A stated set of queries against all items, in pairs of blocks: neither side is collected, broadcast or held whole."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block; a task holds one block of either side at a time.
QUERY_ROWS, ITEM_ROWS = 2048, 16_384
#: Items are dealt to every task where there are so many a task.
LEAST_ROWS = 512
#: Items compared at once with a block of queries.
BATCH = 2048


def crossed(queries: DataFrame, items: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, *, key: str = "id", query_rows: int = QUERY_ROWS, item_rows: int = ITEM_ROWS) -> DataFrame:
    """The rows that `work` makes of each pair of a block of queries and a block of items.

    Rows are dealt to blocks by a hash of `key`, of which no value may be common. Each side is shuffled once for every block of
    the other; the blocks' number follows from the counts, so pass written tables: both are read twice.
    """
    spark = items.sparkSession
    n_queries, n_items = queries.count(), items.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    j = max(1, -(-n_queries // query_rows))
    i = max(1, -(-n_items // item_rows), min(-(-tasks // j), n_items // LEAST_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = queries.withColumn("_j", dealt(j)).withColumn("_i", every(i)).groupBy("_i", "_j")
    right = items.withColumn("_i", dealt(i)).withColumn("_j", every(j)).groupBy("_i", "_j")

    def both(q: pa.Table, x: pa.Table) -> pa.Table:
        return work(q.drop_columns(["_i", "_j"]).combine_chunks(), x.drop_columns(["_i", "_j"]).combine_chunks())

    return left.cogroup(right).applyInArrow(both, schema)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Dense vectors as rows; shorter ones are filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = values
    return out
