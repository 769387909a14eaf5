"""Order-dependent selection: cooldowns and trail thinning.

Whether a row is kept depends on the last row that was kept, so a plain window cannot express
it. The rows are partitioned, sorted by Spark and streamed through Arrow; the pass holds only
the last kept row. Before that, rows that cannot be kept are removed with map-side combining,
and thinning also splits a vessel's history where the outcome no longer depends on the past.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborlight.operators.history import with_islands


def _run_starts(batch: pa.RecordBatch, keys: list[str], last_key: tuple | None) -> tuple[np.ndarray, tuple]:
    """Row numbers where the key differs from the row before, and the key of the last row."""
    n = batch.num_rows
    changed = np.zeros(n, dtype=bool)
    for k in keys:
        column = batch.column(batch.schema.get_field_index(k))
        if n > 1:
            differs = pc.not_equal(column.slice(1), column.slice(0, n - 1))
            changed[1:] |= pc.fill_null(differs, True).to_numpy(zero_copy_only=False)
    first = tuple(batch.column(batch.schema.get_field_index(k))[0].as_py() for k in keys)
    changed[0] = first != last_key
    end = tuple(batch.column(batch.schema.get_field_index(k))[n - 1].as_py() for k in keys)
    return np.flatnonzero(changed), end


def throttle(df: DataFrame, keys: list[str], cooldown_s: int, strict: bool = False, order=("row_id",)) -> DataFrame:
    """Keep a row, then drop the rows of its key until `cooldown_s` has passed since the kept row.

    strict: the next row must come later than the cooldown, not just at its end. Of several
    rows in one second at most the first can be kept, so the ordered pass sees at most one row
    per key and second, however many there were.
    """
    second = Window.partitionBy(*keys, "t_s").orderBy(*order)
    firsts = df.withColumn("_n", F.row_number().over(second)).where("_n = 1").drop("_n")
    wait = cooldown_s + 1 if strict else cooldown_s
    keys = list(keys)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, free_at = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            t = batch.column(batch.schema.get_field_index("t_s")).to_numpy(zero_copy_only=False)
            starts, end_key = _run_starts(batch, keys, last_key)
            mask = np.zeros(batch.num_rows, dtype=bool)
            bounds = [0, *[s for s in starts if s > 0], batch.num_rows]
            fresh = set(starts.tolist())
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if lo in fresh:
                    free_at = None
                i = lo if free_at is None else lo + int(np.searchsorted(t[lo:hi], free_at))
                while i < hi:
                    mask[i] = True
                    free_at = t[i] + wait
                    i = lo + int(np.searchsorted(t[lo:hi], free_at))
            last_key = end_key
            if mask.any():
                yield batch.filter(pa.array(mask))

    ordered = firsts.repartition(*keys).sortWithinPartitions(*keys, "t_s")
    return ordered.mapInArrow(keep, firsts.schema)


def thin_track(df: DataFrame, tolerance: float = 0.0001, key: str = "mmsi") -> DataFrame:
    """Keep a report when it moved more than `tolerance` degrees from the last kept report.

    A report that moved more than twice the tolerance from the report before it is kept
    whatever happened earlier, so the history splits there. A report equal in place to the one
    before it is never kept.
    """
    # The small addition keeps the split safe from rounding.
    split_at = 2 * tolerance + 1e-9

    def jump(p, c):
        return F.greatest(F.abs(c["latitude"] - p["latitude"]), F.abs(c["longitude"] - p["longitude"]))

    here = F.struct("latitude", "longitude")
    headed = with_islands(
        df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()),
        "_head",
        ["t_s", "row_id", "latitude", "longitude"],
        lambda p, c: jump(p, c) > split_at,
        key=(key,),
        before="_prev",
    ).where(F.col("_prev").isNull() | (jump(F.col("_prev"), here) > 0))
    keys = [key, "_head_t", "_head_row"]
    split = headed.select(
        *df.columns, F.col("_head.t_s").alias("_head_t"), F.col("_head.row_id").alias("_head_row")
    )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, kept = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            # Plain floats: single elements of numpy arrays are several times slower.
            lat = batch.column(batch.schema.get_field_index("latitude")).to_pylist()
            lon = batch.column(batch.schema.get_field_index("longitude")).to_pylist()
            starts, last_key = _run_starts(batch, keys, last_key)
            fresh, rows = set(starts.tolist()), []
            for i, (y, x) in enumerate(zip(lat, lon)):
                if i in fresh or abs(y - kept[0]) > tolerance or abs(x - kept[1]) > tolerance:
                    rows.append(i)
                    kept = (y, x)
            if rows:
                yield batch.take(pa.array(rows))

    ordered = split.repartition(*keys).sortWithinPartitions(*keys, "t_s", "row_id")
    return ordered.mapInArrow(keep, split.schema).drop("_head_t", "_head_row")
