"""Problem 3: groups of records that share most of their content.

Method: tensored banding. Two small collections of minhash bands are drawn; every pair of a band of
the first and a band of the second forms the key of one table, so ``bands`` + ``bands`` bands serve
``bands`` x ``bands`` tables and the minhashes to compute are about the square root of what separate
tables would need. Records that meet under a key are candidates and each candidate is verified
by its exact similarity; groups are the connected components of the verified links.

Copies (the same words in the same order) are one node throughout, however many there are. Links are
verified in two waves. The first only gathers groups cheaply: in the tables of the diagonal the nodes under a key are put in an order
of that key's own and each is linked to the ``reach`` ones before it. The second is whole: in all tables, every two nodes
under a key that are in different groups of the first wave are compared, since no other pair can change a group. A hot key of alike texts costs no
more than its rows then. A key of more than ``hot`` nodes that aren't in one group isn't paired at all: its nodes are compared by
an exact prefix filter instead (two alike texts must share one of the rarest runs of each), so that many texts which share nothing but a common
passage aren't compared with each other.

Before two texts' runs are brought together, four bits of each of their minhashes are compared: pairs that agree in four standard deviations fewer than texts
at the threshold do (3 in 100 000 of those are lost), or whose numbers of runs differ too much, aren't verified.

Alike: at least ``threshold`` of the distinct runs of ``run_length`` words in either text occur in both.
A miss needs that no band of one of the collections agrees; at similarity 0.5 that is 3 % a pair and
direct link with the default 15 bands of 2 (1.2 % at 0.55, 0.4 % at 0.6), and a chain of alike texts needs only some of its links.

Defined results: null and blank texts and texts under ``min_words`` words take no part; rows with the same
id count once; a record alike to no other is in no group; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.arrowtools import map_batches
from lodestrata.operators.graph import connected_components
from lodestrata.session import free_shuffles, wide, written

_WORD = re.compile(r"[^\W_]+")
_U = np.uint64
_PIECE = 1_000_000  # pairs made at a time


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (wraps around)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _word_hash() -> _WordHash:
    return _WordHash()


def runs_of(texts: list[str | None], run_length: int, min_words: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """(rows that take part, hashes of all their runs, offset of each row's runs, digest of each row's words)."""
    known = _word_hash()
    rows: list[int] = []
    flat: list[int] = []
    lengths: list[int] = []
    for k, t in enumerate(texts):
        words = _WORD.findall(t.lower()) if t else ()
        if len(words) >= max(min_words, run_length):
            rows.append(k)
            flat += map(known.__getitem__, words)
            lengths.append(len(words))
    w = np.array(flat, dtype=np.uint64)
    n = np.array(lengths, dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(n)))
    if not rows:
        return rows, w, begin, w
    size = len(w) - run_length + 1
    h = np.zeros(size, dtype=np.uint64)
    for j in range(run_length):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + w[j : j + size])
    keep = np.ones(size, dtype=bool)
    for j in range(1, run_length):  # runs that would reach into the next text
        at = begin[1:-1] - j
        keep[at[at < size]] = False
    place = np.arange(len(w), dtype=np.uint64) - np.repeat(begin[:-1], n).astype(np.uint64)
    digest = np.add.reduceat(_mix(w + place * _U(0xD6E8FEB86659FD93)), begin[:-1])
    digest = _mix(digest + n.astype(np.uint64))
    offsets = np.concatenate(([0], np.cumsum(n - run_length + 1)))
    return rows, h[keep], offsets, digest


def _signatures(h: np.ndarray, offsets: np.ndarray, bands: int, band_size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """2 x bands band hashes a text, and four bits of every minhash in a byte each."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 2**63, size=2 * bands * band_size, dtype=np.int64).astype(np.uint64) * _U(2) + _U(1)
    out = np.zeros((len(offsets) - 1, 2 * bands), dtype=np.uint64)
    bits = np.zeros((len(offsets) - 1, len(factors)), dtype=np.uint8)
    for f, a in enumerate(factors):
        x = h * a
        x ^= x >> _U(32)
        low = np.minimum.reduceat(x * a, offsets[:-1])
        b = f // band_size
        out[:, b] = _mix(out[:, b] * _U(0x9E3779B97F4A7C15) + low)
        bits[:, f] = (_mix(low) & _U(15)).astype(np.uint8)
    return out, bits


def _packed(bits: np.ndarray) -> pa.Array:
    """Rows of four-bit values as binary values of half their length."""
    even = np.pad(bits, ((0, 0), (0, bits.shape[1] % 2)))
    raw = np.ascontiguousarray(even[:, ::2] * 16 + even[:, 1::2])
    ends = pa.array(np.arange(len(raw) + 1, dtype=np.int32) * raw.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, ends.buffers()[1], pa.py_buffer(raw.tobytes())])


def _sketch(texts: DataFrame, run_length: int, min_words: int, bands: int, band_size: int, seed: int) -> DataFrame:
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows, h, offsets, digest = runs_of(b.column(1).to_pylist(), run_length, min_words)
        sig, bits = _signatures(h, offsets, bands, band_size, seed) if rows else (np.zeros((0, 2 * bands), dtype=np.uint64), np.zeros((0, 2), dtype=np.uint8))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (2 * bands)), pa.array(sig.reshape(-1).astype(np.int64)))
        sizes = pa.array([len(np.unique(h[offsets[k] : offsets[k + 1]])) for k in range(len(rows))], type=pa.int32())
        cols = [b.column(0).take(pa.array(rows, type=pa.int64())), pa.array(digest.astype(np.int64)), lists, _packed(bits), sizes]
        return pa.RecordBatch.from_arrays(cols, names=["id", "node", "sig", "bits", "n"])

    return map_batches(texts, run, "id string, node bigint, sig array<bigint>, bits binary, n int")


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: float, minhashes: int) -> DataFrame:
    """The pairs that can be alike by their numbers of runs, and are likely enough to be by their minhashes."""
    agree = threshold + (1 - threshold) / 16
    least = int(minhashes * agree - 4 * (minhashes * agree * (1 - agree)) ** 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
                differ = x ^ y
                same = ((differ >> 4) == 0).sum(axis=1) + ((differ & 15) == 0).sum(axis=1) - (2 * x.shape[1] - minhashes)
                own = pa.array(same >= least)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(own), b.column(1).filter(own)], names=["a", "b"])

    j = pairs.join(nodes.select(F.col("node").alias("a"), F.col("bits").alias("bits_a"), F.col("n").alias("na")), "a")
    j = j.join(nodes.select(F.col("node").alias("b"), F.col("bits").alias("bits_b"), F.col("n").alias("nb")), "b")
    j = j.filter(F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9)
    return j.select("a", "b", "bits_a", "bits_b").mapInArrow(run, "a bigint, b bigint")


def _run_sets(texts: DataFrame, run_length: int, min_words: int) -> DataFrame:
    """``(node, runs)``: the distinct runs of each node."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows, h, offsets, digest = runs_of(b.column(0).to_pylist(), run_length, min_words)
        sets = [np.unique(h[offsets[k] : offsets[k + 1]]) for k in range(len(rows))]
        ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        flat = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(digest.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "runs"])

    return map_batches(texts.select("document"), run, "node bigint, runs array<bigint>")


def _links(keys: DataFrame, reach: int) -> DataFrame:
    """``(a, b)``: each node with the ``reach`` nodes before it under the same key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_node = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for b in batches:
            k = np.concatenate((last_key, b.column(0).to_numpy()))
            v = np.concatenate((last_node, b.column(1).to_numpy()))
            fresh = len(last_key)
            a_out, b_out = [], []
            for r in range(1, reach + 1):
                same = np.flatnonzero((k[r:] == k[:-r]) & (np.arange(r, len(k)) >= fresh)) if len(k) > r else np.zeros(0, dtype=np.int64)
                a_out.append(v[same])
                b_out.append(v[same + r])
            last_key, last_node = k[-reach:], v[-reach:]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], names=["a", "b"])

    ordered = keys.repartition(wide(keys.sparkSession), "key").sortWithinPartitions("key", F.xxhash64("node", "key"))
    return ordered.mapInArrow(run, "a bigint, b bigint").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _pairs_between(key: np.ndarray, node: np.ndarray, part: np.ndarray) -> Iterator[np.ndarray]:
    """All pairs of nodes under one key in different parts, as 2 x n arrays of about ``_PIECE`` pairs; the rows are sorted by key and part."""
    n = len(key)
    if not n:
        return
    new_key = np.flatnonzero(key[1:] != key[:-1]) + 1
    new_part = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
    at = np.arange(n)
    key_end = np.append(new_key, n)[np.searchsorted(new_key, at, side="right")]
    part_end = np.append(new_part, n)[np.searchsorted(new_part, at, side="right")]
    total = np.concatenate(([0], np.cumsum(key_end - part_end)))
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + _PIECE, side="right")) - 1)
        count = total[lo + 1 : hi + 1] - total[lo:hi]
        a = np.repeat(np.arange(lo, hi), count)
        if len(a):
            b = part_end[a] + np.arange(len(a)) - np.repeat(total[lo:hi] - total[lo], count)
            x, y = node[a], node[b]
            yield np.stack((np.minimum(x, y), np.maximum(x, y)))
        lo = hi


def _links_between(keys: DataFrame, hot: int) -> DataFrame:
    """``(a, b, part)``: all pairs of nodes under the same key whose ``part`` differs, with a null part; of keys of more than ``hot`` nodes their nodes as a, with part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, dtype=np.int64)] * 3
        long: int | None = None  # a key that goes on and has been found hot

        def nodes(rows: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[1]), pa.nulls(len(rows[1]), pa.int64()), pa.array(rows[2])], names=["a", "b", "part"])

        def out(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if not len(rows[0]):
                return
            begin = np.concatenate(([0], np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1))
            size = np.diff(np.append(begin, len(rows[0])))
            many = np.repeat((size > hot) & (rows[2][begin] != rows[2][begin + size - 1]), size)
            if many.any():
                yield nodes([r[many] for r in rows])
            for p in _pairs_between(*(r[~many] for r in rows)):
                yield pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1]), pa.nulls(len(p[0]), pa.int64())], names=["a", "b", "part"])

        for b in batches:
            rows = [np.concatenate((k, c.to_numpy())) for k, c in zip(kept, b.columns, strict=True)]
            if not len(rows[0]):
                continue
            if long is not None:
                end = int(np.searchsorted(rows[0], long, side="right"))
                yield nodes([r[:end] for r in rows])
                rows = [r[end:] for r in rows]
                kept = rows
                if not len(rows[0]):
                    continue
                long = None
            whole = int(np.searchsorted(rows[0], rows[0][-1]))  # the last key may go on in the next batch
            yield from out([r[:whole] for r in rows])
            kept = [r[whole:] for r in rows]
            if len(kept[0]) > hot and kept[2][0] != kept[2][-1]:
                long = int(kept[0][0])
                yield nodes(kept)
                kept = [r[:0] for r in kept]
        yield from out(kept)

    ordered = keys.select("key", "node", "part").repartition(wide(keys.sparkSession), "key").sortWithinPartitions("key", "part")
    return ordered.mapInArrow(run, "a bigint, b bigint, part bigint").distinct()


def _by_rare_runs(nodes: DataFrame, texts: DataFrame, ids: DataFrame, threshold: float, run_length: int, min_words: int) -> DataFrame:
    """``(a, b)``: all pairs of ``(node, part)`` in different parts that can be alike: each text's runs are put in order of how many of the texts hold them, and alike ones share one of the first ``n - ceil(threshold * n) + 1``."""
    needed = nodes.join(ids, "node").select("id")
    sets = written(_run_sets(texts.join(needed, "id", "left_semi"), run_length, min_words).dropDuplicates(["node"]))
    flat = sets.select("node", F.size("runs").alias("n"), F.explode("runs").alias("run"))
    df = flat.groupBy("run").agg(F.count("*").alias("df"))
    ordered = flat.join(df, "run").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "run"))).alias("runs"))  # as many as a text has
    first = F.slice("runs", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    rows = ordered.select("node", F.explode(first).alias("r")).select(F.col("r.run").alias("key"), "node").join(nodes, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, dtype=np.int64)] * 3
        for b in batches:
            both = [np.concatenate((k, c.to_numpy())) for k, c in zip(kept, b.columns, strict=True)]
            if len(both[0]):
                whole = int(np.searchsorted(both[0], both[0][-1]))
                yield from (pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], names=["a", "b"]) for p in _pairs_between(*(r[:whole] for r in both)))
                kept = [r[whole:] for r in both]
        yield from (pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], names=["a", "b"]) for p in _pairs_between(*kept))

    sorted_ = rows.select("key", "node", "part").repartition(wide(rows.sparkSession), "key").sortWithinPartitions("key", "part")
    return sorted_.mapInArrow(run, "a bigint, b bigint").distinct()


def _verify(pairs: DataFrame, texts: DataFrame, ids: DataFrame, threshold: float, run_length: int, min_words: int) -> DataFrame:
    """The pairs whose exact similarity is at least the threshold, with it."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(ids, "node").select("id")
    sets = _run_sets(texts.join(needed, "id", "left_semi"), run_length, min_words)
    sa = sets.select(F.col("node").alias("a"), F.col("runs").alias("ra"))
    sb = sets.select(F.col("node").alias("b"), F.col("runs").alias("rb"))
    both = F.size(F.array_intersect("ra", "rb"))
    j = pairs.join(sa, "a").join(sb, "b").select("a", "b", both.alias("both"), (F.size("ra") + F.size("rb") - both).alias("either"))
    return j.filter(F.col("both") >= F.col("either") * threshold - 1e-9).select("a", "b", (F.col("both") / F.col("either")).alias("similarity"))


def near_duplicate_groups(
    df: DataFrame, id_col: str = "id", text_col: str = "document", threshold: float = 0.8, run_length: int = 5,
    min_words: int = 20, bands: int = 15, band_size: int = 2, reach: int = 3, hot: int = 1000, seed: int = 11,
) -> DataFrame:
    """``(id, group_id, copy_of)``: the group of every record that is alike to another one.

    ``group_id`` is the least id of the group, ``copy_of`` the least id among the record's exact copies.
    """
    texts = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("document")).filter(F.col("id").isNotNull() & F.col("document").isNotNull())
    rows = written(_sketch(texts, run_length, min_words, bands, band_size, seed))
    nodes = rows.groupBy("node").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("bits").alias("bits"), F.first("n").alias("n"))
    nodes = written(nodes)
    left, right = F.slice("sig", 1, bands), F.slice("sig", bands + 1, bands)

    def keyed(nodes: DataFrame, diagonal: bool) -> DataFrame:
        i = nodes.select("node", "part", F.posexplode(left).alias("i", "l"), right.alias("r"))
        ij = i.select("node", "part", "i", "l", F.posexplode("r").alias("j", "r"))
        ij = ij.filter("i = j") if diagonal else ij
        return ij.select(F.xxhash64("i", "l", "j", "r").alias("key"), "node", "part")

    ids = nodes.select("node", "id")
    def checked(pairs: DataFrame) -> DataFrame:
        return _verify(written(_likely(pairs, nodes, threshold, 2 * bands * band_size)), texts, ids, threshold, run_length, min_words)

    first = written(checked(_links(keyed(nodes.withColumn("part", F.col("node")), True), reach)))
    parts = connected_components(first, "a", "b").select("node", F.col("component").alias("part"))
    free_shuffles(df.sparkSession)
    met = written(_links_between(keyed(nodes.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), False), hot))
    free_shuffles(df.sparkSession)
    rest = met.filter("b IS NOT NULL").select("a", "b")
    crowded = met.filter("b IS NULL").select(F.col("a").alias("node"), "part").distinct()
    if not crowded.isEmpty():
        rest = rest.unionByName(_by_rare_runs(written(crowded), texts, ids, threshold, run_length, min_words)).distinct()
    second = checked(rest)
    # the second wave joins whole groups of the first
    links = first.select("a", "b").unionByName(second.select("a", "b"))
    groups = connected_components(links, "a", "b").select("node", "component")
    members = rows.select("id", "node").dropDuplicates(["id"])
    sizes = members.groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("copy_of"))
    grouped = sizes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = grouped.groupBy("component").agg(F.sum("copies").alias("size"), F.min("copy_of").alias("group_id")).filter("size > 1")
    return members.join(grouped.join(named, "component").select("node", "group_id", "copy_of"), "node").select("id", "group_id", "copy_of")


def prose_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.lower(F.trim("file_ext")).isin(".md", ".txt")).select("id", "document")


def groups(chunks: DataFrame) -> DataFrame:
    """The groups of the .md and .txt chunks, by runs of three words and a similarity of one half."""
    return near_duplicate_groups(prose_chunks(chunks), threshold=0.5, run_length=3)


def found(chunks: DataFrame) -> DataFrame:
    """``(id_a, id_b)``: all pairs within each group, as the problem's statement lists them."""
    g = written(groups(chunks).select("id", "group_id"))
    a = g.select(F.col("id").alias("id_a"), "group_id")
    b = g.select(F.col("id").alias("id_b"), "group_id")
    return a.join(b, "group_id").filter("id_a < id_b").select("id_a", "id_b")
