"""The as-of join of operators/pairs.py in blocks, for sums that never need the pairs as rows.

Where many vessels lie close together, pairs grow with the square of their number, and a row for each pair, moved and
sorted, costs far more than the distance. Here reports are dealt by (grid cell, time slice, two groups of vessels); a
task enumerates the pairs of its blocks in arrays, sums them up and gives back only the sums. A block has about `ROWS` reports a side and as many pairs as `WORK`
says, however busy the cell. Each group of vessels is copied to all groups of the other side, a shorter slice repeats only
the reports seen across its ends. So where no pair needs to stay together, busy cells are first cut to slices of `SHORTEST`
seconds; otherwise, and beyond that, to groups. Within a task a block is worked through in smaller parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.functions import geo
from harborlight.operators.pairs import _cell_size, _span
from harborlight.session import written

SECONDS = 3600
SHORTEST = 150
ROWS = 65_536
#: Pairs of a block, about, if a block's pairs of vessels stay together or only the pairs of a report do.
WORK = {True: 6e7, False: 1e9}
#: Vessels a side of which pairs are enumerated together, where pairs of vessels stay together.
VESSELS = 128
#: Reports handed to Python at a time (one block at least), and pairs enumerated at a time.
BATCH_ROWS = 16_384
BATCH_PAIRS = 2_000_000
_BLOCK = ["_lat", "_lon", "_hour", "_part", "_i", "_j"]
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _part(t: Column) -> Column:
    return F.floor(F.pmod(t, F.lit(SECONDS)) * F.col("_parts") / SECONDS)


def in_blocks(
    left: DataFrame, right: DataFrame, radius_nm: float, stale_s: int,
    run: Callable[[pa.Table], pa.Table], schema: str, radii: int = 2, whole_pairs: bool = False,
) -> DataFrame:
    """`run` over the blocks of `left` and `right`: same columns, with mmsi, t_s, row_id, place, next_t and next_row.

    A left report is in its own cell, of `radii` times the radius, a right one in all cells within the radius; both are in
    all slices in which they can be seen. `_right` tells the sides apart, `_own` marks the slice of the report itself.
    `run` gets blocks, several at a time. With `whole_pairs` all reports of two vessels in a cell and slice come together, in
    parts of about `VESSELS` vessels a side; without, left reports only look, and are in their own slice only.
    """
    size = _cell_size(radius_nm * radii / 2)
    around = round(360.0 / size)
    lat, lon, t = F.col("latitude"), F.col("longitude"), F.col("t_s")
    usable = lat.between(-90, 90) & lon.between(-180, 180) & F.col("mmsi").isNotNull() & t.isNotNull()
    dlat = radius_nm / 60.0 * 1.001
    dlon = F.least(F.lit(180.0), F.lit(dlat * 1.05) / F.greatest(F.cos(F.radians(F.abs(lat) + dlat)), F.lit(1e-6)))
    lons = F.array_distinct(F.transform(_span(lon - dlon, lon + dlon, size), lambda i: F.pmod(i, F.lit(around))))
    until = F.least("next_t", t + stale_s)
    hours = F.explode(F.sequence(F.floor(t / SECONDS).cast("long"), F.floor(until / SECONDS).cast("long"))).alias("_hour")
    cell_lat, cell_lon = geo.grid_cell(lat, lon, size)
    own_hour = F.floor(t / SECONDS).cast("long").alias("_hour")
    here = left.where(usable).select(
        "*", cell_lat.alias("_lat"), F.pmod(cell_lon, F.lit(around)).alias("_lon"), hours if whole_pairs else own_hour
    )
    there = (
        right.where(usable)
        .select("*", _span(lat - dlat, lat + dlat, size).alias("_lats"), lons.alias("_lons"), hours)
        .withColumn("_lat", F.explode("_lats")).withColumn("_lon", F.explode("_lons")).drop("_lats", "_lons")
    )
    cell = ["_lat", "_lon", "_hour"]

    def counted(side: DataFrame, name: str) -> DataFrame:
        vessels = side.groupBy(*cell, "mmsi").agg(F.count("*").alias("n"))
        return vessels.groupBy(*cell).agg(F.sum("n").alias(f"_{name}_rows"), F.count("*").alias(f"_{name}_vessels"))

    cells = counted(here, "left").join(counted(there, "right"), cell)
    left_rows, right_rows = F.col("_left_rows"), F.col("_right_rows")
    few = F.lit(1) if whole_pairs else F.least(F.lit(SECONDS // SHORTEST), F.ceil(F.greatest(left_rows, right_rows) / ROWS))
    looks = left_rows.cast("double") * F.col("_right_vessels")
    if whole_pairs:
        looks += right_rows.cast("double") * F.col("_left_vessels")
    by_work = F.ceil(F.sqrt(looks / few / WORK[whole_pairs]))

    def groups(name: str) -> Column:
        needed = F.greatest(F.ceil(F.col(f"_{name}_rows") / few / ROWS), by_work)
        return F.least(F.col(f"_{name}_vessels"), needed).cast("int").alias(f"_{name}_groups")

    cells = cells.select("*", few.cast("int").alias("_few"), groups("left"), groups("right"))
    crowded = F.greatest(left_rows / F.col("_left_groups"), right_rows / F.col("_right_groups"))
    cells = cells.withColumn("_parts", F.least(F.lit(SECONDS), F.greatest("_few", F.ceil(crowded / ROWS))).cast("int"))
    cells = written(cells, "blocks")
    copies = F.sum(F.col("_left_rows") * F.col("_right_groups") + F.col("_right_rows") * F.col("_left_groups"))
    batches = cells.agg(F.greatest(F.lit(1), F.ceil(F.coalesce(copies, F.lit(0)) / BATCH_ROWS)).cast("long"))
    rows = []
    for side, own, other in ((here, "left", "right"), (there, "right", "left")):
        first = F.when(F.floor(t / SECONDS) == F.col("_hour"), _part(t)).otherwise(F.lit(0)).cast("int")
        last = F.when(F.floor(until / SECONDS) == F.col("_hour"), _part(until)).otherwise(F.col("_parts") - 1).cast("int")
        if own == "left" and not whole_pairs:
            last = first
        dealt = side.join(cells.select(*cell, "_left_groups", "_right_groups", "_parts"), cell)
        dealt = dealt.withColumn("_part", F.explode(F.sequence(first, last)))
        rows.append(
            dealt.withColumn("_i" if own == "left" else "_j", F.pmod(F.hash("mmsi"), F.col(f"_{own}_groups")))
            .withColumn("_j" if own == "left" else "_i", F.explode(F.sequence(F.lit(0), F.col(f"_{other}_groups") - 1)))
            .withColumn("_own", (F.floor(t / SECONDS) == F.col("_hour")) & (F.col("_part") == _part(t)))
            .withColumn("_right", F.lit(own == "right"))
            .drop("_left_groups", "_right_groups", "_parts")
        )
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    batch = F.pmod(F.xxhash64(*_BLOCK), batches.scalar())
    # A given number of tasks: the rows are few for the work that is in them, so sizes would merge them.
    dealt = rows[0].unionByName(rows[1]).withColumn("_batch", batch).repartition(tasks, "_batch")


    def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _portions(pa.Table.from_batches(list(batches)), whole_pairs):
            yield from run(table).to_batches()

    return dealt.groupBy("_batch").applyInArrow(portions, schema)


def _block_of(table: pa.Table) -> np.ndarray:
    """Numbers of the blocks of a table's rows, in their order."""
    blocks = [table.column(c).to_numpy() for c in _BLOCK]
    by_block = np.lexsort(blocks[::-1])
    changes = np.zeros(table.num_rows, bool)
    for b in blocks:
        changes[1:] |= b[by_block[1:]] != b[by_block[:-1]]
    block = np.empty(table.num_rows, np.int64)
    block[by_block] = np.cumsum(changes)
    return block


def _portions(table: pa.Table, whole_pairs: bool) -> Iterator[pa.Table]:
    """The small blocks of a table together, large ones one by one; with `whole_pairs` in tiles of `VESSELS` vessels a side."""
    block = _block_of(table)
    order = np.argsort(block, kind="stable")
    starts = np.searchsorted(block[order], np.arange(block.max() + 2))
    large = np.diff(starts) > 2 * BATCH_ROWS
    if not large.all():
        yield table.take(pa.array(np.flatnonzero(~large[block])))
    for i in np.flatnonzero(large):
        rows = table.take(pa.array(order[starts[i]:starts[i + 1]]))
        if not whole_pairs:
            yield rows
            continue
        right = rows.column("_right").to_numpy()
        who = pc.dictionary_encode(rows.column("mmsi").combine_chunks()).indices.to_numpy()
        sides = []
        for side in (~right, right):
            here = np.flatnonzero(side)
            tile = np.unique(who[here], return_inverse=True)[1] // VESSELS
            here = here[np.argsort(tile, kind="stable")]
            sides.append(np.split(here, np.cumsum(np.bincount(tile))[:-1]))
        for seen in sides[1]:
            for looking in sides[0]:
                yield rows.take(pa.array(np.concatenate((looking, seen))))


class Pairs:
    """The pairs of a table of blocks: every looking report with each report of the other side that it sees."""

    def __init__(self, table: pa.Table, stale_s: int):
        self.table = table
        self.right = self.array("_right")
        self.own = self.array("_own")
        t, row = self.array("t_s"), table.column("row_id").fill_null(_LEAST).to_numpy()
        next_t = table.column("next_t").fill_null(_MOST).to_numpy()
        next_row = table.column("next_row").fill_null(_LEAST).to_numpy()
        nameless = table.column("row_id").is_null().to_numpy(zero_copy_only=False)
        blocks = [self.array(c) for c in _BLOCK]
        self.block = _block_of(table)
        replaced = next_t < t + stale_s
        end_t, end_row = np.where(replaced, next_t, t + stale_s), np.where(replaced, next_row, _LEAST)
        # Three moments of each row, ranked together: its report, from when others see it, until when.
        n = table.num_rows
        keys = [np.concatenate((row, np.where(nameless, _MOST, row), end_row)), np.concatenate((t, t, end_t))]
        keys += [np.tile(b, 3) for b in reversed(blocks)]
        order = np.lexsort(keys)
        fresh = np.zeros(3 * n, bool)
        for key in keys:
            fresh[1:] |= key[order[1:]] != key[order[:-1]]
        rank = np.empty(3 * n, np.int64)
        rank[order] = np.cumsum(fresh)
        self.rank, self.begins, self.ends = rank[:n], rank[n:2 * n], rank[2 * n:]
        # A report without number has no order among those of its second.
        self._nameless_end = (nameless, t, end_t) if nameless.any() else None

    def array(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()

    def numbers(self, name: str) -> np.ndarray:
        """A numeric column as floats, NaN for null."""
        return self.table.column(name).cast(pa.float64()).fill_null(float("nan")).to_numpy()

    def _side(self, looking: np.ndarray, seen: np.ndarray):
        lookers = np.flatnonzero(looking & self.own)
        lookers = lookers[np.argsort(self.rank[lookers], kind="stable")]
        at = self.rank[lookers]
        rows = np.flatnonzero(seen)
        first = np.searchsorted(at, self.begins[rows], "right")
        return lookers, rows, first, np.maximum(np.searchsorted(at, self.ends[rows], "left") - first, 0)

    def batches(self, both: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers (looking, seen). Left reports look at right ones, and with `both` the reverse, too.

        All pairs of a left report come together, and with `both` all pairs of a block.
        """
        sides = [self._side(~self.right, self.right)]
        if not both:
            yield from map(self._ordered, self._by_looker(*sides[0]))
            return
        sides.append(self._side(self.right, ~self.right))
        blocks = int(self.block.max()) + 1
        work = np.zeros(blocks)
        for _, rows, _, counts in sides:
            work += np.bincount(self.block[rows], counts, blocks)
        batch_of = np.floor(np.cumsum(work) / BATCH_PAIRS)
        for batch in np.unique(batch_of):
            parts = []
            for lookers, rows, first, counts in sides:
                chosen = batch_of[self.block[rows]] == batch
                rows_, first_, counts_ = rows[chosen], first[chosen], counts[chosen]
                within = np.arange(counts_.sum()) - np.repeat(np.cumsum(counts_) - counts_, counts_)
                parts.append((lookers[np.repeat(first_, counts_) + within], np.repeat(rows_, counts_)))
            yield self._ordered([np.concatenate(x) for x in zip(*parts)])

    def _by_looker(self, lookers, rows, first, counts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        by_first = np.argsort(first, kind="stable")
        by_first = by_first[counts[by_first] > 0]
        rows, first, end = rows[by_first], first[by_first], (first + counts)[by_first]
        # Pairs up to each looker, and where a batch of them is full.
        pairs = np.cumsum(np.cumsum(np.bincount(first, minlength=len(lookers) + 1) - np.bincount(end, minlength=len(lookers) + 1)))
        cuts = np.append(np.flatnonzero(np.diff(pairs[:-1] // BATCH_PAIRS, prepend=-1)), len(lookers))
        for start, stop in zip(cuts[:-1], cuts[1:]):
            chosen = np.flatnonzero(end[:np.searchsorted(first, stop)] > start)
            begins = np.maximum(first[chosen], start)
            counts = np.minimum(end[chosen], stop) - begins
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            yield lookers[np.repeat(begins, counts) + within], np.repeat(rows[chosen], counts)

    def _ordered(self, pairs) -> tuple[np.ndarray, np.ndarray]:
        a, b = pairs
        if self._nameless_end is not None:
            nameless, t, end_t = self._nameless_end
            keep = ~(nameless[a] & (t[a] == end_t[b]))
            a, b = a[keep], b[keep]
        return a, b


def angle(lat1, lon1, lat2, lon2) -> np.ndarray:
    """The central angle of two places in degrees, as the column functions work it out."""
    half_lat, half_lon = np.sin(np.radians(lat2 - lat1) / 2), np.sin(np.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * half_lon * half_lon
    return 2 * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0.0, 1 - h)))
