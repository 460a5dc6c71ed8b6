"""Problem 1: the most similar vectors of every vector.

Method: NN-descent. A neighbour graph is improved by iterative Spark joins: every node sends its (compressed) vector to
the nodes it is linked with in either direction, and each node compares all those it has heard from, so
that neighbours of neighbours become neighbours. Two that have met before are not compared again: of a pair at least one must be heard as
a fresh link. Rounds go on until the share of links that changed is below ``settled``. The first graph, a poor one, comes from ``trees``
random partitions of the vectors into leaves of about ``leaf``, compared within. At the end the kept candidates are scored again with the full
vectors. Queries that are not part of the collection walk the finished graph greedily (``graph_search``).

Vectors of the same direction (norms are divided out) are one node, however many there are, so copies cost
nothing; their ids come back at the end, at most ``k`` + 1 a node being needed. Leaves and lists longer than a bound are ordered by a random
projection and compared in windows of that length which overlap by half, so that all of their rows take part and near ones meet; they are
spread over tasks by ranges of the projection, so neither a dense region nor a node that very many point at collects into one task.

Defined results: a null vector or id, another length than ``dim``, a null, NaN or infinite value and an all-zero vector take no
part; rows with the same id count once; equal similarities are ordered by id; a collection of fewer than k + 1 vectors
gives what there is; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import cut_lineage, drop_written, free_shuffles, wide, written

SAMPLE = 20_000  # vectors on which the partitions are fitted, about
LEAF = 1024  # vectors of a partition compared with each other
HEARD = 512  # vectors of one node's list compared with each other
SPREAD = 1024  # tasks that one long leaf or list can be spread over
BROADCAST_ROWS = 1_000_000  # of two numbers each; larger tables are joined by a shuffle
ENTRIES = 50_000  # random nodes that every task of a search holds, at most


# --- vectors -------------------------------------------------------------------------------------------------


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dim)


def _pack(x: np.ndarray) -> pa.Array:
    """float32 rows as binary values."""
    raw = np.ascontiguousarray(x, dtype=np.float32)
    width = raw.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.array(np.arange(len(raw) + 1, dtype=np.int32) * width).buffers()[1], pa.py_buffer(raw.tobytes())])


def _compress(x: np.ndarray) -> np.ndarray:
    """Rows of 4 bytes of scale and a signed byte a component."""
    scale = np.abs(x).max(axis=1, keepdims=True).astype(np.float32) / 127
    scale[scale == 0] = 1
    return np.concatenate((scale.view(np.uint8).reshape(-1, 4), np.rint(x / scale).astype(np.int8).view(np.uint8)), axis=1)


def _pack_bytes(x: np.ndarray) -> pa.Array:
    width = x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.array(np.arange(len(x) + 1, dtype=np.int32) * width).buffers()[1], pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _expand(column: pa.Array, dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, dim + 4)
    scale = raw[:, :4].copy().view(np.float32)
    return raw[:, 4:].view(np.int8).astype(np.float32) * scale


def unit_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """``(id, node, vec)`` of the usable rows: node is a hash of the direction, vec its float32 bytes."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & (F.size("v") == dim)).filter(~bad & F.exists("v", lambda x: x != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            grid = np.rint(x * 65536).astype(np.int64).astype(np.uint64)
            h = np.zeros(len(x), dtype=np.uint64)
            for j in range(dim):
                h = (h ^ grid[:, j]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h.astype(np.int64)), _pack(x)], names=["id", "node", "vec"])

    return rows.mapInArrow(run, f"id {kind}, node bigint, vec binary")


# --- the first graph -----------------------------------------------------------------------------------------


def _fit_trees(sample: np.ndarray, trees: int, depth: int, seed: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Of each tree the levels, each with a direction and a threshold for every node of the level.

    Directions join two random vectors of the node's sample, thresholds are medians. Levels beyond what the sample can tell apart share one of each.
    """
    rng = np.random.default_rng(seed)
    fitted = min(depth, int(np.log2(max(1, len(sample) / 16))))
    out = []
    for _ in range(trees):
        place = np.zeros(len(sample), dtype=np.int64)
        levels = []
        for level in range(fitted):
            n = 1 << level
            direction = rng.standard_normal((n, sample.shape[1])).astype(np.float32)
            threshold = np.zeros(n, dtype=np.float32)
            order = np.argsort(place, kind="stable")
            ends = np.searchsorted(place[order], np.arange(n + 1))
            for k in range(n):
                own = order[ends[k] : ends[k + 1]]
                if len(own) > 1:
                    a, b = sample[rng.choice(own, 2, replace=False)]
                    if np.any(a != b):
                        direction[k] = a - b
                    threshold[k] = np.median(sample[own] @ direction[k])
            levels.append((direction, threshold))
            place = place * 2 + (np.einsum("ij,ij->i", sample, direction[place]) > threshold[place])
        for _ in range(depth - fitted):
            a, b = sample[rng.choice(len(sample), 2, replace=False)]
            levels.append(((a - b)[None], np.array([np.median(sample @ (a - b))], dtype=np.float32)))
        out.append(levels)
    return out


def _leaves(nodes: DataFrame, dim: int, trees: int, leaf: int, seed: int) -> DataFrame:
    """``(key, turn, node, small)``: a row for each vector and tree; key is the leaf, turn the projection that orders it."""
    n = nodes.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
    rows = nodes.filter(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(max(1, n // SAMPLE))) == 0).select("vec").collect() if depth else []
    sample = np.frombuffer(b"".join(bytes(r.vec) for r in rows), dtype=np.float32).reshape(-1, dim)
    model = _fit_trees(sample, trees if depth else 1, depth if len(sample) > 1 else 0, seed)
    along = np.random.default_rng(seed + 1).standard_normal((len(model), dim)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim)
            small = _pack_bytes(_compress(x))
            for t, levels in enumerate(model):
                place = np.zeros(len(x), dtype=np.int64)
                for direction, threshold in levels:
                    own = place if len(direction) > 1 else np.zeros(len(x), dtype=np.int64)
                    place = place * 2 + (np.einsum("ij,ij->i", x, direction[own]) > threshold[own])
                yield pa.RecordBatch.from_arrays([pa.array(place * len(model) + t), pa.array(x @ along[t]), b.column(0), small], names=["key", "turn", "node", "small"])

    return nodes.select("node", "vec").mapInArrow(run, "key bigint, turn float, node bigint, small binary")


def _grouped(rows: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """``rows`` (with ``key`` and ``turn``), those of a key together and ordered by turn.

    ``sizes`` are the ``(key, count)``; keys of far more than ``most`` rows are spread over tasks by ranges of turn.
    """
    spark = rows.sparkSession
    long = written(sizes.filter(F.col("count") > 4 * most))
    n = long.count()
    if not n:
        return rows.repartition(wide(spark), "key").sortWithinPartitions("key", "turn")
    few = n * SPREAD <= BROADCAST_ROWS
    of_long = rows.select("key", "turn").join(F.broadcast(long) if few else long, "key")
    cuts = F.percentile_approx("turn", [i / SPREAD for i in range(1, SPREAD)], 10 * SPREAD).alias("cuts")
    long = written(of_long.groupBy("key").agg(F.least(F.ceil(F.max("count") / most), F.lit(SPREAD)).alias("pieces"), cuts))
    place = F.size(F.filter("cuts", lambda x: x < F.col("turn")))
    part = F.coalesce(F.floor(place * F.col("pieces") / SPREAD), F.lit(0)).alias("part")
    parted = rows.join(F.broadcast(long) if few else long, "key", "left").select(*rows.columns, part)
    return parted.repartition(wide(spark), "key", "part").sortWithinPartitions("key", "part", "turn").drop("part")


def _top(s: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest of each row: first the groups of 32 with the largest maxima, which hold them all, then within these."""
    m = s.shape[1]
    groups = m // 32
    if groups <= 2 * k:
        return np.argpartition(-s, k - 1, axis=1)[:, :k] if k < m else np.argsort(-s, axis=1)[:, :k]
    best = s[:, : groups * 32].reshape(len(s), groups, 32).max(axis=2)
    own = np.argpartition(-best, k - 1, axis=1)[:, :k]
    cols = (own[:, :, None] * 32 + np.arange(32)).reshape(len(s), -1)
    cols = np.concatenate((cols, np.broadcast_to(np.arange(groups * 32, m), (len(s), m - groups * 32))), axis=1)
    some = np.take_along_axis(s, cols, 1)
    return np.take_along_axis(cols, np.argpartition(-some, k - 1, axis=1)[:, :k], 1)


def _windows(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and size of the runs of equal keys, those longer than ``most`` as windows of ``most`` that overlap by half."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    begin = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1))
    size = np.diff(np.concatenate((begin, [len(keys)])))
    step = most // 2
    parts = np.where(size > most, -(-(size - most) // step) + 1, 1)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, size = np.repeat(begin, parts) + k * step, np.repeat(size, parts) - k * step
    return begin, np.minimum(size, most)


def _open_lists(batches: Iterator[list[np.ndarray]], most: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(columns, begin, size) of whole lists, the first column being the key; of a list that goes on over batches at most ``most`` rows are held."""
    rest: list[np.ndarray] | None = None
    for cols in batches:
        if rest is not None:
            cols = [np.concatenate(p) for p in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1]))  # where the open list begins
        if len(cols[0]) - last > most:  # its windows so far; the last half window meets what follows
            yield cols, *_windows(cols[0], most)
            last = len(cols[0]) - most // 2
        elif last:
            yield cols, *_windows(cols[0][:last], most)
        rest = [c[last:] for c in cols]
    if rest is not None and len(rest[0]):
        yield rest, *_windows(rest[0], most)


def _compare_leaves(leaves: DataFrame, dim: int, keep: int, most: int) -> DataFrame:
    """``(node, others, sims)``: the most similar ones of each node within each of its leaves."""

    def best(nodes: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        m = len(nodes)
        k = min(keep, m - 1)
        s = x @ x.T
        np.fill_diagonal(s, -2)
        top = _top(s, k)
        ends = pa.array(np.arange(m + 1, dtype=np.int32) * k)
        others, sims = pa.array(nodes[top].reshape(-1)), pa.array(np.take_along_axis(s, top, 1).reshape(-1))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.ListArray.from_arrays(ends, others), pa.ListArray.from_arrays(ends, sims)], names=["node", "others", "sims"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ([b.column(0).to_numpy(), b.column(2).to_numpy(), _expand(b.column(3), dim)] for b in batches)
        for (_, nodes, x), begin, size in _open_lists(columns, most):
            for a, m in zip(begin, size, strict=True):
                if m > 1:
                    yield best(nodes[a : a + m], x[a : a + m])

    return _grouped(leaves, leaves.groupBy("key").count(), most).mapInArrow(run, "node bigint, others array<bigint>, sims array<float>")


# --- NN-descent ----------------------------------------------------------------------------------------------


def _keep_best(pairs: DataFrame, keep: int) -> DataFrame:
    """``(node, nbrs array<struct<sim, other, fresh>>)`` of ``(node, other, sim, fresh)``: the best of each node. A pair that comes as known isn't fresh."""
    one = pairs.repartition(wide(pairs.sparkSession), "node").groupBy("node", "other").agg(F.max("sim").alias("sim"), F.bool_and("fresh").alias("fresh"))
    w = Window.partitionBy("node").orderBy(F.desc("sim"), "other")
    top = one.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep)
    return top.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("sim", "other", "fresh")), asc=False).alias("nbrs"))


def _descend(nodes: DataFrame, graph: DataFrame, dim: int, keep: int, seed: int) -> DataFrame:
    """``(node, other, sim)``: the pairs of one round that are better than the worst their node has."""
    forward = graph.select("node", F.explode("nbrs").alias("n")).select("node", F.col("n.other").alias("key"), F.col("n.fresh").alias("fresh"))
    both = forward.unionByName(forward.select(F.col("key").alias("node"), F.col("node").alias("key"), "fresh"))
    to = both.repartition(wide(nodes.sparkSession), "node").groupBy("node", "key").agg(F.bool_or("fresh").alias("fresh"))
    floor = F.when(F.size("nbrs") >= keep, F.element_at("nbrs", keep)["sim"]).otherwise(F.lit(-2.0)).cast("float")
    along = np.random.default_rng(seed).standard_normal(dim).astype(np.float32)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x @ along), _pack_bytes(_compress(x))], names=["node", "turn", "small"])

    small = nodes.select("node", "vec").mapInArrow(shrink, "node bigint, turn float, small binary")
    heard = to.join(small, "node").join(graph.select("node", floor.alias("floor")), "node").select("key", "turn", "node", "floor", "fresh", "small")

    def compare(nodes_: np.ndarray, floors: np.ndarray, fresh: np.ndarray, x: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        widths = (4, 8, 12, 16, 20, 24, 32, 48, 64, 128, 256, HEARD)
        for low, width in zip((1, *widths), widths, strict=False):
            own = np.flatnonzero((size > low) & (size <= width))
            some = max(1, 8_000_000 // (width * max(width, dim)))
            for a in range(0, len(own), some):
                g = own[a : a + some]
                at = begin[g][:, None] + np.arange(width)
                real = np.arange(width) < size[g][:, None]
                at = np.where(real, at, 0)
                v = x[at]
                s = v @ v.transpose(0, 2, 1)
                n, f, new = nodes_[at], np.where(real, floors[at], 2), fresh[at] & real
                s[~(real[:, None, :] & (new[:, :, None] | new[:, None, :]))] = -3
                s[n[:, :, None] == n[:, None, :]] = -3
                i, j, k = np.nonzero(s > f[:, :, None])
                yield pa.RecordBatch.from_arrays([pa.array(n[i, j]), pa.array(n[i, k]), pa.array(s[i, j, k])], names=["node", "other", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ([b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4).to_numpy(zero_copy_only=False), _expand(b.column(5), dim)] for b in batches)
        for (_, *cols), begin, size in _open_lists(columns, HEARD):
            yield from compare(*cols, begin, size)

    return _grouped(heard, forward.groupBy("key").count(), HEARD).mapInArrow(run, "node bigint, other bigint, sim float")


def neighbour_graph(nodes: DataFrame, dim: int, keep: int = 12, trees: int = 5, rounds: int | None = None, settled: float = 0.03, leaf: int = LEAF, seed: int = 5) -> DataFrame:
    """``(node, nbrs array<struct<sim, other, fresh>>)`` over ``(node, vec)``, best first; ``sim`` is of the compressed vectors.

    ``rounds`` None: as many as it takes until less than a share of ``settled`` of the links is new, which every round makes fewer.
    """
    spark = nodes.sparkSession
    first = _compare_leaves(_leaves(nodes, dim, trees, leaf, seed), dim, min(keep, 8), leaf)
    pairs = first.repartition(wide(spark), "node").select("node", F.explode(F.arrays_zip("others", "sims")).alias("p"))
    graph = written(_keep_best(pairs.select("node", F.col("p.others").alias("other"), F.col("p.sims").alias("sim"), F.lit(True).alias("fresh")), keep))
    del first, pairs
    free_shuffles(spark)
    done = 0
    while rounds is None or done < rounds:
        known = graph.select("node", F.explode("nbrs").alias("n")).select("node", F.col("n.other").alias("other"), F.col("n.sim").alias("sim"), F.lit(False).alias("fresh"))
        found_ = _descend(nodes, graph, dim, keep, seed + done).withColumn("fresh", F.lit(True))
        better = written(_keep_best(known.unionByName(found_), keep))
        drop_written(graph)
        graph = better
        del known, found_
        free_shuffles(spark)
        done += 1
        if rounds is None:
            share = graph.agg(F.sum(F.size(F.filter("nbrs", lambda n: n["fresh"]))) / F.sum(F.size("nbrs"))).first()[0]
            if (share or 0.0) < settled:
                break
    return graph


def _rescore(pairs: DataFrame, nodes: DataFrame, dim: int) -> DataFrame:
    """``(node, other, similarity)`` with the full vectors."""

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.einsum("ij,ij->i", _matrix(b.column(2), dim).astype(np.float64), _matrix(b.column(3), dim).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.clip(s, -1, 1))], names=["node", "other", "similarity"])

    a = nodes.select("node", F.col("vec").alias("va"))
    b = nodes.select(F.col("node").alias("other"), F.col("vec").alias("vb"))
    return pairs.join(a, "node").join(b, "other").select("node", "other", "va", "vb").mapInArrow(dots, "node bigint, other bigint, similarity double")


def most_similar(
    df: DataFrame, id_col: str = "id", vector_col: str = "embeddings", dim: int = 64, k: int = 5, least: float | None = None,
    keep: int = 12, trees: int = 5, rounds: int | None = None, settled: float = 0.03, leaf: int = LEAF, seed: int = 5,
) -> DataFrame:
    """``(id, other_id, similarity, rank)``: of every usable row the k most similar others.

    ``least`` keeps only neighbours of at least that similarity, which spares scoring the others again.
    """
    rows = unit_vectors(df, id_col, vector_col, dim)  # read again for the ids: cheaper than to write them with their vectors
    nodes = written(rows.groupBy("node").agg(F.first("vec").alias("vec")))
    ids = rows.select("node", "id").distinct()
    graph = neighbour_graph(nodes, dim, max(keep, k + 3), trees, rounds, settled, leaf, seed)
    pairs = graph.select("node", F.explode(F.slice("nbrs", 1, k + 3)).alias("n"))  # compression costs a rank or two at most
    if least is not None:
        pairs = pairs.filter(F.col("n.sim") >= least - 0.01)
    exact = _rescore(pairs.select("node", F.col("n.other").alias("other")), nodes, dim)
    first = ids.withColumn("rn", F.row_number().over(Window.partitionBy("node").orderBy("id"))).filter(F.col("rn") <= k + 1)
    first = cut_lineage(first.groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("members")))
    others = exact.join(first.select(F.col("node").alias("other"), "members"), "other").select("node", "similarity", F.explode("members").alias("other_id"))
    own = first.filter(F.size("members") > 1).select("node", F.lit(1.0).alias("similarity"), F.explode("members").alias("other_id"))
    w = Window.partitionBy("node").orderBy(F.desc("similarity"), "other_id")
    lists = others.unionByName(own).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k + 1)
    lists = lists.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rn", "similarity", "other_id"))).alias("list"))
    # a row among its node's first members is in its own list: it is taken out, and k remain
    out = ids.join(lists, "node").withColumn("list", F.filter("list", lambda x: x["other_id"] != F.col("id")))
    out = out.select("id", F.posexplode(F.slice("list", 1, k)).alias("pos", "n"))
    out = out.select("id", F.col("n.other_id").alias("other_id"), F.col("n.similarity").alias("similarity"), (F.col("pos") + 1).alias("rank"))
    return out if least is None else out.filter(F.col("similarity") >= least)


def found(chunks: DataFrame) -> DataFrame:
    """``(id_a, id_b)``: pairs of a similarity of at least 0.9 of which one is among the five most similar of the other."""
    near = most_similar(chunks, least=0.9)
    return near.select(F.least("id", "other_id").alias("id_a"), F.greatest("id", "other_id").alias("id_b")).distinct()


# --- queries -------------------------------------------------------------------------------------------------


def graph_search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, dim: int, k: int = 5, beam: int = 24, width: int = 12, seed: int = 3) -> DataFrame:
    """``(query, node, similarity, rank)``: greedy walks over the graph from ``(query, vec)``.

    All queries walk at once, a hop being a join with the graph and one with the vectors, both read as a whole, so that several nodes are opened
    at once: each query opens its ``width`` most similar nodes that aren't open yet, hears of their neighbours (in both directions) and keeps the ``beam`` best; it is done when all it keeps are
    open, and the walk when all queries are. Entry points are random nodes, four times the square root of their number, which every task holds.
    What the queries hold is broadcast to the graph as long as it is small, so that a hop shuffles only that; beyond it both sides are shuffled.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    entries = min(ENTRIES, max(512, int(4 * n**0.5)))
    starts = nodes.select("node", "vec").orderBy(F.xxhash64("node", F.lit(seed))).limit(entries).collect()
    e_nodes = np.array([r.node for r in starts], dtype=np.int64)
    e_vecs = np.frombuffer(b"".join(bytes(r.vec) for r in starts), dtype=np.float32).reshape(-1, dim)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = min(beam, len(e_nodes))
        for b in batches:
            x = _matrix(b.column(1), dim)
            for a in range(0, len(x), 256):
                s = x[a : a + 256] @ e_vecs.T
                top = np.argsort(-s, axis=1)[:, :m]
                q = b.column(0).take(pa.array(np.repeat(np.arange(a, a + len(s)), m)))
                sims = np.take_along_axis(s, top, 1).reshape(-1).astype(np.float64)
                yield pa.RecordBatch.from_arrays([q, pa.array(e_nodes[top].reshape(-1)), pa.array(sims)], names=["query", "node", "similarity"])

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _pack_bytes(_compress(_matrix(b.column(1), dim)))], names=["node", "small"])

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.einsum("ij,ij->i", _expand(b.column(2), dim), _matrix(b.column(3), dim)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["query", "node", "similarity"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.einsum("ij,ij->i", _matrix(b.column(2), dim).astype(np.float64), _matrix(b.column(3), dim).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.clip(s, -1, 1))], names=["query", "node", "similarity"])

    small = written(nodes.select("node", "vec").mapInArrow(shrink, "node bigint, small binary"))  # a quarter to walk on
    fields = "query bigint, node bigint, similarity double"
    step = graph.select("node", F.explode("nbrs").alias("n")).select("node", F.col("n.other").alias("next"))
    step = written(step.unionByName(step.select(F.col("next").alias("node"), F.col("node").alias("next"))).distinct())
    # the walk moves numbers in place of the queries' ids; the names come back at the end
    named = written(queries.select(F.monotonically_increasing_id().alias("query"), F.col("query").alias("name"), F.col("vec").alias("qv")))
    q = named.select("query", "qv")
    asked = q.count()

    def narrow(x: DataFrame, a_query: int) -> DataFrame:
        return F.broadcast(x) if asked * a_query <= BROADCAST_ROWS else x

    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "node")
    held = written(q.select("query", F.col("qv").alias("vec")).mapInArrow(enter, fields).withColumn("open", F.lit(False)))
    while True:
        turn = F.row_number().over(Window.partitionBy("query", "open").orderBy(F.desc("similarity"), "node"))
        now = written(held.withColumn("now", (~F.col("open")) & (turn <= width)))
        new = step.join(narrow(now.filter("now").select("query", "node"), width), "node").select("query", F.col("next").alias("node")).distinct()
        new = written(new.join(now.select("query", "node"), ["query", "node"], "left_anti"))
        scored = small.join(F.broadcast(new) if new.count() <= BROADCAST_ROWS else new, "node").join(q, "query").select("query", "node", "small", "qv").mapInArrow(dots, fields)
        both = now.select("query", "node", "similarity", (F.col("open") | F.col("now")).alias("open")).unionByName(scored.withColumn("open", F.lit(False)))
        after = written(both.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= beam).drop("rn"))
        for t in (held, now, new):
            drop_written(t)
        held = after
        if asked * beam > BROADCAST_ROWS:  # else a hop shuffles what the queries hold, and no more
            free_shuffles(spark)
        if held.filter("NOT open").isEmpty():
            break
    final = nodes.select("node", "vec").join(narrow(held.select("query", "node"), beam), "node").join(q, "query").select("query", "node", "vec", "qv").mapInArrow(exact, fields)
    final = final.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return final.join(named.select("query", "name"), "query").select(F.col("name").alias("query"), "node", "similarity", "rank")


def search(df: DataFrame, id_col: str, vector_col: str, queries: DataFrame, dim: int = 64, k: int = 5, **graph_options: int) -> DataFrame:
    """``(query_id, id, similarity, rank)``: for the rows of ``queries`` (same columns) their k most similar rows of ``df`` by graph search."""
    rows = unit_vectors(df, id_col, vector_col, dim)
    nodes = written(rows.groupBy("node").agg(F.first("vec").alias("vec")))
    graph = neighbour_graph(nodes, dim, **graph_options)
    q = unit_vectors(queries, id_col, vector_col, dim).dropDuplicates(["id"]).select(F.col("id").alias("query"), "vec")
    near = graph_search(q, nodes, graph, dim, k + 1)
    ids = rows.select("node", "id").distinct().withColumn("rn", F.row_number().over(Window.partitionBy("node").orderBy("id"))).filter(F.col("rn") <= k + 1)
    hits = near.join(ids.select("node", "id"), "node").filter(~F.col("query").eqNullSafe(F.col("id")))
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("query").alias("query_id"), "id", "similarity", "rank")
