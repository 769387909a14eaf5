"""Embedding near-dedup: an exact metric range join.

Unit vectors with a cosine of c lie at distance sqrt(2 - 2c). Every vector belongs to the cell of its nearest
pivot and is copied to those cells of lower number whose border is nearer than that distance; the
triangle inequality says how near the border can be. Cells are then joined on their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.llm.common import parts_for
from harborlight.llm.components import connected
from harborlight.session import written

COSINE = 0.9
#: Vectors for each pivot, pivots at most (they are broadcast), vectors of a part of a cell, and rows compared at a time.
PER_PIVOT, PIVOTS, PART, BLOCK = 4096, 1024, 4096, 256
#: Single-precision products that differ from the threshold by less are computed again in double precision.
CLOSE = 1e-4


def as_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def place(pivots: dict[int, np.ndarray], reach: float):
    """Different vectors to rows of their own cell and of the cells that they may reach into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = pivots.value
        for batch in batches:
            sizes = np.diff(batch.column("embedding").offsets.to_numpy())
            for width in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == width)))
                own = centres[width]
                rows = unit(as_rows(part.column("embedding")))
                far = np.sqrt(np.maximum(0.0, 2 - 2 * rows @ own.T))
                home = np.argmin(far, axis=1)
                near = far[np.arange(len(rows)), home]
                between = np.sqrt(np.maximum(0.0, 2 - 2 * own @ own.T))[home]
                # From a point to the border of another cell: the plane between the pivots.
                border = (far**2 - near[:, None] ** 2) / (2 * np.maximum(between, 1e-12))
                reached = (border <= reach + 1e-9) & (far - near[:, None] <= 2 * reach + 1e-9) & (np.arange(len(own)) < home[:, None])
                guest, cell = np.nonzero(reached)
                at = np.concatenate((np.arange(len(rows)), guest))
                out = part.select(["rep", "n", "embedding"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), width, np.int32)), pa.array(np.concatenate((home, cell)).astype(np.int32)),
                        pa.array(np.arange(len(at)) >= len(rows)), *out.columns,
                    ],
                    names=["width", "cell", "guest", "rep", "n", "embedding"],
                )

    return run


def linked_blocks(left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """Which rows have a cosine of at least the threshold: BLOCK rows of `left` at a time against all of `right`.

    Products in single precision decide where they are clear; those near the threshold are computed again in double.
    """
    a, b = unit(left).astype(np.float32), unit(right).astype(np.float32)
    long_left, long_right = (np.sqrt((x * x).sum(axis=1)) for x in (left, right))
    margin = max(CLOSE, 2e-7 * left.shape[1])
    for begin in range(0, len(a), BLOCK):
        product = a[begin : begin + BLOCK] @ b.T
        linked = product >= threshold
        at, to = np.nonzero(np.abs(product - threshold) < margin)
        for k in range(0, len(at), 1 << 14):
            i, j = at[k : k + (1 << 14)], to[k : k + (1 << 14)]
            dots = np.einsum("ij,ij->i", left[begin + i], right[j])
            linked[i, j] = dots / (long_left[begin + i] * long_right[j]) >= threshold
        yield begin, linked


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches by the edges (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def join_cells(threshold: float):
    """Rows of a few cells to rows (rep, links, root): links found there, and a node of lower id it hangs on, if any."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        names = np.array(rows.column("place").to_pylist())
        rep, weight, side = (rows.column(c).to_numpy() for c in ("rep", "n", "side"))
        order = np.argsort(names, kind="stable")
        links: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        embeddings = rows.column("embedding").combine_chunks()
        for own in np.split(order, np.flatnonzero(names[order][1:] != names[order][:-1]) + 1) if len(order) else []:
            own = own[np.argsort(rep[own], kind="stable")]
            left, right = own[side[own] < 2], own[side[own] != 1]
            if not len(left) or not len(right):
                continue
            rows_left, rows_right = (as_rows(embeddings.take(pa.array(x))) for x in (left, right))
            for begin, linked in linked_blocks(rows_left, rows_right, threshold):
                own_left = left[begin : begin + len(linked)]
                linked &= rep[own_left][:, None] != rep[right]
                if not linked.any():
                    continue
                i, j = np.nonzero(linked)
                for x, times in zip(rep[own_left].tolist(), np.bincount(i, weight[right[j]], len(own_left)).astype(int).tolist()):
                    links[x] = links.get(x, 0) + times
                once = side[own_left[i]] != side[right[j]]  # both of side 0: seen from either end
                for x, times in zip(rep[right].tolist(), np.bincount(j[once], weight[own_left[i[once]]], len(right)).astype(int).tolist()):
                    if times:
                        links[x] = links.get(x, 0) + times
                nodes, where = np.unique(np.concatenate((rep[own_left[i]], rep[right[j]])), return_inverse=True)
                root = nodes[spanning(where[: len(i)], where[len(i) :], len(nodes))]
                edges += [(x, r) for x, r in zip(nodes.tolist(), root.tolist()) if x != r]
        edges = sorted(set(edges))
        found = [(r, n, None) for r, n in links.items() if n] + [(x, 0, r) for x, r in edges]
        return pa.table(
            {
                "rep": pa.array([x[0] for x in found], pa.int64()), "links": pa.array([x[1] for x in found], pa.int64()),
                "root": pa.array([x[2] for x in found], pa.int64()),
            }
        )

    return run


def _numbers(embeddings: DataFrame):
    """The vectors as they are if of single precision, else as doubles."""
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    return F.col("embedding") if single else F.col("embedding").cast("array<double>")


def near_vectors(embeddings: DataFrame, threshold: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (vec_id = component_id).

    Vectors link at a cosine of at least `threshold` (above 0). Null, empty and zero vectors and those with null or
    non-finite components link with nothing, nor do vectors of different lengths with each other, nor rows
    without a vec_id (their component is null). Equal vectors are joined as one and count as links
    of each other; a repeated row is one more vector. A vec_id should name one vector; if it names
    several, each is judged on its own as far as the id tells them apart.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), _numbers(embeddings).alias("embedding"))
    sound = F.expr(
        "vec_id is not null and embedding is not null and size(embedding) > 0 and exists(embedding, x -> x <> 0) and "
        "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    )
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    different = written(
        rows.where("sound").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors"
    )
    counts = different.groupBy(F.size("embedding").alias("width")).count().collect()
    pivots = {}
    for width, count in counts:
        wanted = min(PIVOTS, -(-count // PER_PIVOT))
        chosen = different.where(F.size("embedding") == width).orderBy(F.xxhash64("embedding"), "rep").limit(wanted)
        pivots[width] = unit(np.array([r.embedding for r in chosen.collect()]))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    placed = different.mapInArrow(
        place(spark.sparkContext.broadcast(pivots), reach),
        f"width int, cell int, guest boolean, rep long, n long, embedding {different.schema['embedding'].dataType.simpleString()}",
    )
    placed = written(placed, "cells")
    sizes = placed.groupBy(F.col("width").alias("w"), F.col("cell").alias("c"), F.col("guest").alias("g")).agg(
        F.ceil(F.count("*") / PART).cast("int").alias("parts")
    )
    homes = sizes.where("not g").select("w", "c", F.col("parts").alias("homes"))
    guests = sizes.where("g").select(F.col("w").alias("gw"), F.col("c").alias("gc"), F.col("parts").alias("guests"))
    parts = homes.join(guests, F.expr("w = gw and c = gc"), "left").select("w", "c", "homes", F.coalesce("guests", F.lit(0)).alias("guests"))
    cut = placed.join(parts, F.expr("width = w and cell = c")).withColumn(
        "part", F.pmod(F.xxhash64("embedding"), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("homes")))
    )
    # A place joins two parts of a cell: homes i and j (i <= j), or homes i and guests j. Rows of side 0
    # meet each other, rows of side 1 those of side 2.
    mine = F.explode(
        F.expr(
            "case when guest then transform(sequence(0, homes - 1), i -> concat_ws('_', i, 'g', part)) else concat("
            "transform(sequence(0, homes - 1), i -> concat_ws('_', least(i, part), 'h', greatest(i, part))), "
            "case when guests > 0 then transform(sequence(0, guests - 1), j -> concat_ws('_', part, 'g', j)) else array() end) end"
        )
    )
    cut = cut.select("width", "cell", "guest", "part", "rep", "n", "embedding", mine.alias("name"))
    first, last = F.split_part("name", F.lit("_"), F.lit(1)), F.split_part("name", F.lit("_"), F.lit(3))
    side = (
        F.when(F.col("guest"), 2)
        .when(F.split_part("name", F.lit("_"), F.lit(2)) == "g", 1)
        .when(first == last, 0)
        .when(F.col("part").cast("string") == first, 1)
        .otherwise(2)
    )
    total = sum(count for _, count in counts)
    buckets = parts_for(total, PART // 2, least=24)
    found = written(
        cut.select(
            F.concat_ws("_", "width", "cell", "name").alias("place"), side.cast("int").alias("side"), "rep", "n", "embedding"
        )
        .groupBy(F.pmod(F.xxhash64("place"), F.lit(buckets)).alias("bucket"))
        .applyInArrow(join_cells(threshold), "rep long, links long, root long"),
        "found",
    )
    links = found.groupBy(F.col("rep").alias("linked")).agg(F.sum("links").alias("links"))
    edges = found.where("root is not null").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    named = rows.where("sound").join(
        different.select(F.col("embedding").alias("same"), "rep", "n"), F.col("embedding") == F.col("same")
    )
    component = connected(edges)
    return (
        named.select("vec_id", "rep", "n")
        .join(links, F.col("rep") == F.col("linked"), "left")
        .join(component, F.col("rep") == F.col("node"), "left")
        .select(
            "vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
        .unionAll(rows.where("not sound").select("vec_id", F.lit(0).cast("long"), "vec_id"))
        .withColumn("kept", F.coalesce(F.expr("vec_id = component_id"), F.lit(False)))
    )
