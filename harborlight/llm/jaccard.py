"""N-gram Jaccard join with count vectors and R-trees.

A document is its set of shingles. Shingles are hashed into groups; the counts of the groups are a
point, and the sum of coordinate minima of two points is never below the overlap of the sets. Inside a block of
documents, points lie in an R-tree whose boxes are pruned by that bound; what survives is verified
on the sets themselves.

In so many dimensions a tree over all points would prune little, so blocks come first: two sets
that link must share one of their rarest shingles (prefix filter). Members of a block are first
compared with one common pivot. Only members that are not yet in one component go to
the R-trees, so a large group of near copies costs a pass over it, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.llm.common import free_name, parts_for, text_total
from harborlight.llm.components import connected
from harborlight.llm.words import SPACES, Words, gram_hashes, hashes, mix, release, slices, text_bytes
from harborlight.session import written

SHINGLE, PERCENT = 5, 80
#: Coordinates of a count vector.
GROUPS = 256
#: Frequent shingles that sort last, at most, and how often a shingle must occur to be one of them. They only
#: set the order in which shingles are tried.
FREQUENT, OFTEN = 1 << 19, 3
#: Text bytes for each bucket of shingles or of pairs.
BUCKET_BYTES = 6 << 20
#: Text bytes whose shingles are worked on together.
TOGETHER = 4 << 20
#: Rounds of comparing with pivots, and pivots of a block from the second round on.
PIVOT_ROUNDS, PIVOTS = 4, 4
#: Points in one R-tree at most, members compared with a pivot in one task, and points of a leaf.
CELL, CHUNK, LEAF = 1024, 128, 8
#: Pairs whose documents' names are broadcast to the texts; with more, texts and names are shuffled.
FEW_PAIRS = 1 << 16
#: Blocks of at most so many members have one round of pivots only.
SMALL = 24


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted hashes of the different shingles of each text; of all its words if there are fewer."""
    words = Words(texts, SPACES, lower=True)
    if not len(words):
        return [np.empty(0, np.uint64) for _ in texts]
    ids, names = words.dictionary()
    h = hashes(names)[ids]
    grams = {size: gram_hashes(h, size)}
    out = []
    for a, b in zip(words.bounds.tolist(), words.bounds[1:].tolist()):
        n = b - a
        if n >= size:
            found = np.sort(grams[size][a : b - size + 1])
            out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        elif n:
            if n not in grams:
                grams[n] = gram_hashes(h, n)
            out.append(grams[n][a : a + 1] ^ np.uint64(n))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def overlap_needed(n, m, percent: int):
    """The smallest intersection at which sets of n and m elements link."""
    return -(-percent * (n + m) // (100 + percent))


def signatures(size: int, buckets: int):
    """Documents to rows (bucket, doc_id, n, sig, counted).

    A row has a document's set size and a 128-bit name of its set, or for one bucket all shingles of the slice's
    different sets, in 32 bits each: sorted, as differences, byte by byte, compressed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, size=TOGETHER):
            sets = shingle_sets(text_bytes(batch.column("text")), size)
            sigs = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            every = np.sort(short(np.concatenate([np.empty(0, np.uint64), *dict(zip(sigs, sets)).values()])))
            cuts = np.searchsorted(every, (np.arange(buckets + 1) << 32) // buckets).tolist()
            blobs = [
                press.compress(np.diff(every[a:b], prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes())
                for a, b in zip(cuts, cuts[1:])
            ]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*(np.arange(n) % buckets), *range(buckets)], pa.int32()),
                    pa.array([*batch.column("doc_id").to_pylist(), *[None] * buckets], pa.int64()),
                    pa.array([*map(len, sets), *[None] * buckets], pa.int64()),
                    pa.array([*sigs, *[None] * buckets], pa.binary()), pa.array([*[None] * n, *blobs], pa.binary()),
                ],
                names=["bucket", "doc_id", "n", "sig", "counted"],
            )

    return run


def short(shingles: np.ndarray) -> np.ndarray:
    """The upper 32 bits of hashes: enough to count by."""
    return (shingles >> np.uint64(32)).astype(np.uint32)


def count_shingles(bucket: pa.Table) -> pa.Table:
    """All rows of a bucket to the documents' rows as they are, and rows (shingle, times) of those that occur OFTEN."""
    unpress = zstandard.ZstdDecompressor()
    parts = []
    for blob in bucket.column("counted").drop_null().to_pylist():
        steps = np.frombuffer(unpress.decompress(blob), np.uint8).reshape(4, -1).T
        parts.append(np.cumsum(np.ascontiguousarray(steps).view(np.uint32).reshape(-1), dtype=np.uint32))
    every = np.sort(np.concatenate([np.empty(0, np.uint32), *parts]))
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(every)))
    often = times >= OFTEN
    docs = bucket.filter(bucket.column("sig").is_valid()).select(["doc_id", "n", "sig"])
    found = pa.table({"shingle": pa.array(every[first][often].astype(np.int64)), "times": pa.array(times[often])})
    return pa.concat_tables([docs, found], promote_options="default").select(["doc_id", "n", "sig", "shingle", "times"])


def frequent_shingles(sets: DataFrame) -> np.ndarray:
    """The most frequent shingles in short form, rarest first. Counted over all documents; results don't depend on the list."""
    rows = sets.where("shingle is not null").select("shingle", "times").orderBy(F.desc("times"), "shingle").limit(FREQUENT).toArrow()
    return rows.column("shingle").to_numpy()[::-1].astype(np.uint32) if rows.num_rows else np.empty(0, np.uint32)


def prefix_keys(size: int, percent: int, buckets: int, frequent):
    """Documents to rows (bucket, keys, members) of their rarest shingles.

    `keys` holds for each shingle one document of the slice; documents of one slice
    that share a shingle are listed in `members` at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        ranked = frequent.value
        order = np.argsort(ranked)
        known = ranked[order]
        for batch in slices(batches, size=TOGETHER):
            different = {}
            for doc, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(text_bytes(batch.column("text")), size)):
                if doc is not None and len(s):
                    name = s.tobytes()
                    different[name] = min(doc, different.get(name, (doc,))[0]), s
            keys, docs = [], []
            for doc, s in different.values():
                take = len(s) - -(-percent * len(s) // 100) + 1
                if len(known):
                    slot = np.minimum(np.searchsorted(known, short(s)), len(known) - 1)
                    often = known[slot] == short(s)
                    rare = s[~often][:take]
                    if len(rare) < take:
                        rare = np.concatenate((rare, s[often][np.argsort(order[slot[often]], kind="stable")[: take - len(rare)]]))
                else:
                    rare = s[:take]
                keys.append(rare)
                docs.append(np.full(len(rare), doc, np.int64))
            if not keys:
                continue
            keys, docs = np.concatenate(keys), np.concatenate(docs)
            at = np.argsort(keys, kind="stable")
            keys, docs = keys[at], docs[at]
            new = np.concatenate(([True], keys[1:] != keys[:-1]))
            shared = np.zeros(len(keys), bool)
            shared[1:] |= ~new[1:]
            shared[:-1] |= ~new[1:]
            members = press.compress(keys[shared].tobytes() + docs[shared].tobytes())
            keys, docs = keys[new], docs[new]
            bucket = (mix(keys) % np.uint64(buckets)).astype(np.int64)
            at = np.argsort(bucket, kind="stable")
            keys, docs, bucket = keys[at], docs[at], bucket[at]
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))).tolist()
            own = bucket[cuts[:-1]].tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own, pa.int32()),
                    pa.array([press.compress(keys[a:b].tobytes() + docs[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    pa.array([members if shared.any() and i == len(own) // 2 else None for i in range(len(own))], pa.binary()),
                ],
                names=["bucket", "keys", "members"],
            )

    return run


def shared_keys(bucket: pa.Table) -> pa.Table:
    """All rows of a bucket to rows (key, doc_id) of shingles that several documents have."""
    release()
    unpress = zstandard.ZstdDecompressor()

    def read(column: str) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.frombuffer(unpress.decompress(x), np.int64).reshape(2, -1) for x in bucket.column(column).to_pylist() if x]
        return tuple(np.concatenate([np.empty(0, np.int64), *(p[i] for p in parts)]) for i in (0, 1))

    keys, docs = read("keys")
    at = np.argsort(keys, kind="stable")
    keys, docs = keys[at], docs[at]
    same = keys[1:] == keys[:-1]
    shared = np.zeros(len(keys), bool)
    shared[1:] |= same
    shared[:-1] |= same
    more_keys, more_docs = read("members")
    return pa.table(
        {"key": pa.array(np.concatenate((keys[shared], more_keys))), "doc_id": pa.array(np.concatenate((docs[shared], more_docs)))}
    )


def points(sets: list[np.ndarray]) -> np.ndarray:
    """The group counts of each set."""
    return np.array([np.bincount((s >> np.uint64(20)).astype(np.int64) % GROUPS, minlength=GROUPS) for s in sets]).reshape(-1, GROUPS)


def verify_pairs(size: int, percent: int):
    """Rows (bucket, team, doc_id, partners, text) to linked pairs (a, b): each document is compared with its partners of its team."""

    def run(rows: pa.Table) -> pa.Table:
        release()
        team, docs = rows.column("team").to_pylist(), rows.column("doc_id").to_pylist()
        sets = shingle_sets(text_bytes(rows.column("text").combine_chunks()), size)
        counts, sizes = points(sets), np.array([len(s) for s in sets], np.int64)
        at: dict[tuple[int, int], list[int]] = {}
        for i, name in enumerate(zip(team, docs)):
            at.setdefault(name, []).append(i)
        linked = set()
        for i, partners in enumerate(rows.column("partners").to_pylist()):
            other = np.array([j for x in partners for j in at.get((team[i], x), [])], np.int64)
            needed = overlap_needed(sizes[other], sizes[i], percent)
            for j in other[np.minimum(counts[other], counts[i]).sum(axis=1) >= needed].tolist():
                slot = np.minimum(np.searchsorted(sets[i], sets[j]), len(sets[i]) - 1)
                if np.count_nonzero(sets[i][slot] == sets[j]) >= overlap_needed(sizes[j], sizes[i], percent):
                    linked.add((docs[i], docs[j]))
        found = sorted(linked)
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return run


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (p, x) of rows (team, p, x) whose sets link, as (a, b). The texts of a team meet in one place, each once."""
    none = F.array().cast("array<long>")
    heads = pairs.groupBy("team", "p").agg(F.collect_list("x").alias("partners"))
    roles = heads.select("team", F.col("p").alias("role_id"), "partners").unionAll(
        pairs.select("team", F.col("x").alias("role_id"), none.alias("partners")).distinct()
    )
    roles = roles.groupBy("team", "role_id").agg(F.flatten(F.collect_list("partners")).alias("partners"))
    buckets = parts_for(2 * text_total(texts), BUCKET_BYTES, least=48)
    if pairs.limit(FEW_PAIRS + 1).count() <= FEW_PAIRS:
        roles = F.broadcast(roles)
    return (
        roles.join(texts, F.col("role_id") == F.col("doc_id"))
        .select(F.pmod(F.xxhash64("team"), F.lit(buckets)).alias("bucket"), "team", "doc_id", "partners", "text")
        .groupBy("bucket")
        .applyInArrow(verify_pairs(size, percent), "a long, b long")
    )


def untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    """The pairs (p, x), in either order, that haven't been compared."""
    low, high = F.least("p", "x"), F.greatest("p", "x")
    return pairs.join(tested, (low == F.col("low")) & (high == F.col("high")), "left_anti")


def pivot_pairs(open_blocks: DataFrame, tested: DataFrame, turn: int, percent: int) -> DataFrame:
    """Rows (team, p, x): in each block one member, later some, others each turn, with those that aren't in its component yet."""
    if turn:
        large = open_blocks.groupBy(F.col("key").alias("large_key")).count().where(F.col("count") > SMALL)
        open_blocks = open_blocks.join(large, F.col("key") == F.col("large_key"), "left_semi")
    pick = lambda k: F.min(
        F.struct(F.xxhash64("rep", F.lit(k)).alias("h"), F.col("rep").alias("p"), F.col("n").alias("pn"), F.col("comp").alias("pc"))
    )
    orders = [turn] if not turn else range(PIVOTS * turn, PIVOTS * (turn + 1))
    pivots = open_blocks.groupBy(F.col("key").alias("pivot_key")).agg(F.array(*map(pick, orders)).alias("all"))
    pivots = pivots.select("pivot_key", F.explode(F.array_distinct("all")).alias("v"))
    pairs = (
        open_blocks.join(pivots, F.col("key") == F.col("pivot_key"))
        .select("rep", "n", "comp", "v.p", "v.pn", "v.pc")
        .where(F.expr(f"comp <> pc and 100 * least(n, pn) >= {percent} * greatest(n, pn)"))
        .select("p", F.col("rep").alias("x"))
        .distinct()
    )
    pairs = untested(pairs, tested)
    groups = pairs.groupBy(F.col("p").alias("q")).agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    return pairs.join(groups, F.col("p") == F.col("q")).select(
        F.xxhash64("p", F.pmod(F.xxhash64("x"), F.col("parts"))).alias("team"), "p", "x"
    )


class RTree:
    """Points packed into boxes level by level (sort-tile-recursive order); boxes keep upper corners and set sizes."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.order = self._tiles(counts, np.arange(len(counts)))
        self.levels = []
        high, least, most = counts[self.order], sizes[self.order], sizes[self.order]
        while len(high) > 1 or not self.levels:
            cuts = np.arange(0, len(high), LEAF)
            high = np.maximum.reduceat(high, cuts)
            least, most = np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
            self.levels.append((high, least, most))

    def _tiles(self, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) <= LEAF:
            return at
        widest = np.argmax(np.ptp(counts[at], axis=0))
        at = at[np.argsort(counts[at, widest], kind="stable")]
        half = -(-len(at) // (2 * LEAF)) * LEAF
        if half >= len(at):
            return at
        return np.concatenate((self._tiles(counts, at[:half]), self._tiles(counts, at[half:])))

    def near(self, point: np.ndarray, size: int, counts: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
        """The points that may link with the given one: a superset of those that do."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, least, most = self.levels[depth]
            fits = (100 * most[nodes] >= percent * size) & (percent * least[nodes] <= 100 * size)
            nodes = nodes[fits & (np.minimum(high[nodes], point).sum(axis=1) >= overlap_needed(least[nodes], size, percent))]
            below = len(self.levels[depth - 1][0]) if depth else len(self.order)
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).reshape(-1)
            nodes = nodes[nodes < below]
        at = self.order[nodes]
        return at[np.minimum(counts[at], point).sum(axis=1) >= overlap_needed(sizes[at], size, percent)]


def block_pairs(percent: int):
    """Rows (bucket, cell, side, rep, comp, n, point) to rows (team, p, x): pairs of a cell that may link and aren't connected yet."""

    def run(rows: pa.Table) -> pa.Table:
        release()
        cell, rep, comp, n, side = (rows.column(c).to_numpy() for c in ("cell", "rep", "comp", "n", "side"))
        counts = np.array([np.frombuffer(x, np.int32) for x in rows.column("point").to_pylist()]).reshape(-1, GROUPS)
        found: dict[tuple[int, int], int] = {}
        order = np.argsort(cell, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []:
            left, right = own[side[own] < 2], own[side[own] != 1]
            if not len(left) or not len(right):
                continue
            tree = RTree(counts[right], n[right])
            for i in left.tolist():
                near = right[tree.near(counts[i], n[i], counts[right], n[right], percent)]
                near = near[(comp[near] != comp[i]) & (rep[near] != rep[i])]
                for x in rep[near].tolist():
                    found.setdefault((min(rep[i], x), max(rep[i], x)), cell[i])
        return pa.table(
            {
                "team": pa.array(list(found.values()), pa.int64()), "p": pa.array([x[0] for x in found], pa.int64()),
                "x": pa.array([x[1] for x in found], pa.int64()),
            }
        )

    return run


def point_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=TOGETHER):
            counts = points(shingle_sets(text_bytes(batch.column("text")), size)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x.tobytes() for x in counts], pa.binary())], names=["point_id", "point"]
            )

    return run


def unresolved(members: DataFrame, component: DataFrame) -> DataFrame:
    """Members (key, rep, n, comp) of blocks that still hold several components."""
    now = members.join(component, F.col("rep") == F.col("node"), "left").select(
        "key", "rep", "n", F.coalesce("component", "rep").alias("comp")
    )
    several = now.groupBy(F.col("key").alias("open_key")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    return now.join(several.select("open_key"), F.col("key") == F.col("open_key"), "left_semi")


def tree_pairs(open_blocks: DataFrame, tested: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows (team, p, x): not yet connected members that pass the R-trees' bounds. A large block is cut into cells of two parts each."""
    parts = open_blocks.groupBy(F.col("key").alias("block")).agg(F.ceil(F.count("*") / (CELL // 2)).alias("parts"))
    rows = open_blocks.join(parts, F.col("key") == F.col("block")).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    # Side 0 meets all in its cell; sides 1 and 2 meet each other only.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    rows = rows.withColumn("other", other).select(
        "rep", "comp", "n", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("cell"),
        F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    found = texts.mapInArrow(point_rows(size), "point_id long, point binary")
    pairs = (
        rows.join(found, F.col("rep") == F.col("point_id"))
        .select(F.pmod(F.xxhash64("cell"), F.lit(256)).alias("bucket"), "cell", "side", "rep", "comp", "n", "point")
        .groupBy("bucket")
        .applyInArrow(block_pairs(percent), "team long, p long, x long")
        .groupBy("p", "x")
        .agg(F.min("team").alias("team"))
    )
    return untested(pairs, tested).select("team", "p", "x")


def different_blocks(members: DataFrame) -> DataFrame:
    """Of blocks with the same members, as the rare shingles of near copies give them, one stays."""
    names = members.groupBy("key").agg(
        F.count("*").alias("size"), F.min("rep").alias("least"), F.bit_xor(F.xxhash64("rep")).alias("h"),
        F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("g"),
    )
    chosen = names.where("size > 1").groupBy("size", "least", "h", "g").agg(F.min("key").alias("kept"))
    return members.join(chosen.select("kept"), F.col("key") == F.col("kept"), "left_semi")


def jaccard_components(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    A-Z are lower-cased; words are runs without ASCII spaces. Documents link when 100 * intersection >= percent * union
    of their sets. Null, empty and blank texts have no shingles and link with nothing; texts of fewer words than a
    shingle are one shingle. A row without a doc_id links with nothing and has no component. Rows of one doc_id are
    taken as linked. Equal sets become one representative first.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = parts_for(text_total(documents), BUCKET_BYTES, least=48)
    counted = written(
        rows.mapInArrow(signatures(size, buckets), "bucket int, doc_id long, n long, sig binary, counted binary")
        .groupBy("bucket")
        .applyInArrow(count_shingles, "doc_id long, n long, sig binary, shingle long, times long"),
        "sets",
    )
    frequent = spark.sparkContext.broadcast(frequent_shingles(counted))
    sets = counted.where("sig is not null").select("doc_id", "n", "sig")
    # Empty sets and rows without an id stand for themselves.
    alone = F.expr("n = 0 or doc_id is null")
    classes = sets.where(~alone).groupBy(F.col("sig").alias("class")).agg(F.min("doc_id").alias("rep"))
    ids = written(
        sets.where(alone).select("doc_id", "n", F.col("doc_id").alias("rep")).unionAll(
            sets.where(~alone).join(classes, F.col("sig") == F.col("class")).select("doc_id", "n", "rep")
        ),
        "ids",
    )
    shared = (
        rows.mapInArrow(prefix_keys(size, percent, buckets, frequent), "bucket int, keys binary, members binary")
        .groupBy("bucket")
        .applyInArrow(shared_keys, "key long, doc_id long")
    )
    found = ids.select(F.col("doc_id").alias("own_id"), "n", "rep").distinct()
    members = written(shared.join(found, F.col("doc_id") == F.col("own_id")).select("key", "rep", "n").distinct(), "members")
    members = written(different_blocks(members), "blocks")
    # A doc_id with several texts has several representatives.
    several = found.where("n > 0").groupBy("own_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi")
    links = found.join(several.select("own_id"), "own_id").where("n > 0").select(F.col("own_id").alias("a"), F.col("rep").alias("b"))
    empty = spark.createDataFrame([], "node long, component long")
    texts = written(rows.join(members.select("rep").distinct(), F.col("doc_id") == F.col("rep"), "left_semi"), "texts")
    component = empty
    tested = spark.createDataFrame([], "low long, high long")
    for turn in range(PIVOT_ROUNDS + 1):
        open_blocks = written(unresolved(members, component), "blocks")
        if open_blocks.isEmpty():
            break
        # A block with one component stays so.
        members = open_blocks.select("key", "rep", "n")
        if turn < PIVOT_ROUNDS:
            pairs = pivot_pairs(open_blocks, tested, turn, percent)
        else:
            pairs = tree_pairs(open_blocks, tested, texts, size, percent)
        pairs = written(pairs, "pairs")
        if pairs.isEmpty():
            continue
        tested = tested.unionAll(pairs.select(F.least("p", "x"), F.greatest("p", "x")))
        links = written(links.unionAll(verified(pairs, texts, size, percent)), "links")
        component = connected(links)
    if component is empty:
        component = connected(links)
    return ids.join(component, F.col("rep") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, all its columns kept.

    Rows of one doc_id and one text are one document, of which one row stays. Different texts under one doc_id are different
    documents: they link only if their sets do, and of those that share the smallest doc_id of a component the one with
    the smallest hash stays. Rows without a doc_id, and null, empty or blank texts, link with nothing and stay. An empty
    table stays empty.
    """
    own, gone, text, free = (free_name(documents, name) for name in ("own_key", "gone_key", "text_hash", "lost_key"))
    rows = documents.where("doc_id is not null").withColumn(text, F.xxhash64("text"))
    # Ids of several rows. This list and that of lost documents are stored, so that Spark knows their sizes before it joins:
    # short ones are broadcast, and the texts stay where they are.
    times = rows.groupBy("doc_id").agg(F.min(text).alias("low"), F.max(text).alias("high"), F.count("*").alias("n"))
    shared = written(times.where("n > 1").select(F.col("doc_id").alias(gone), (F.col("low") != F.col("high")).alias(own)), "shared-ids")
    rows = rows.join(shared, F.col("doc_id") == F.col(gone), "left")
    # The doc_id names a document where it has one text.
    key = F.when(F.coalesce(own, F.lit(False)), F.xxhash64("doc_id", text)).otherwise(F.col("doc_id").cast("long"))
    rows = rows.withColumn(own, key).withColumn(gone, F.col(gone).isNotNull()).select(*documents.columns, own, gone)
    linked = jaccard_components(rows.select(F.col(own).alias("doc_id"), "text"))
    linked = written(linked.where("doc_id is not null").select(F.col("doc_id").alias("node"), "component_id").distinct(), "linked")
    names = rows.select("doc_id", F.col(own).alias("node")).distinct()
    # Only components of several documents lose any.
    larger = linked.where("node <> component_id").select("component_id").distinct()
    members = linked.join(larger, "component_id", "left_semi").join(names, "node")
    kept = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "node"))["node"].alias("kept"))
    lost = members.join(kept, "component_id").where("node <> kept").select(F.col("node").alias(free))
    stay = rows.join(written(lost, "lost"), F.col(own) == F.col(free), "left_anti")
    stay = stay.where(~F.col(gone)).unionByName(stay.where(gone).dropDuplicates([own])).select(*documents.columns)
    return stay.unionByName(documents.where("doc_id is null"))
