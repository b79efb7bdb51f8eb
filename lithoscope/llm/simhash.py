"""SimHash near-duplicates: fingerprints per document, links at few differing bits by a Gray-order hierarchical index.

1. Fingerprints are a function of one row (Arrow batches, no shuffle). Equal fingerprints collapse to one row each by
   a pre-aggregated ``groupBy``, so copies never meet as pairs.
2. The distinct fingerprints are sorted by Gray rank, so that neighbours differ in few bits, and cut into upper nodes:
   runs of at most ``run`` fingerprints that share the first bits of their rank. An upper node holds what its
   fingerprints share, a mask of agreeing bits and their pattern.
3. Upper nodes meet those whose first bits differ in at most two places (a join of narrow rows, by these bits); a pair
   whose shared patterns differ in more than two bits is pruned as a whole. Only the pairs left fetch their fingerprints.
4. Inside a pair of upper nodes, runs of eight are factored into a lower node each, runs of eight of these into the next
   level. Pairs descend level by level; the bits that become shared on the way add to the differences found above, and a
   pair is pruned as soon as they are more than two, until single fingerprints meet.
5. Each pair of upper nodes emits one edge per fingerprint, to the smallest member of its local cluster, never all pairs.
   Components over these edges are found by star rounds on DataFrames.

Defined results: a null, empty or blank text has fingerprint zero, linked like any other; repeated rows give repeated
result rows; null ids form components by fingerprint and never become a component's id unless all ids in it are null;
only the two named columns are read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations
from math import ceil, log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, cut, free_name

BITS, SEED, WIDTH, DISTANCE, FAN = 64, 42, 3, 2, 8


def fingerprint(text: bytes | None, width: int = WIDTH, seed: int = SEED) -> int:
    """SimHash of a text's word shingles; zero if it has no word."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    hashes = np.fromiter((xxh64_intdigest(s, seed) for s in shingles), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[k:k + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = []
            for low in range(0, batch.num_rows, 256):
                fps += [fingerprint(t, width, seed) for t in batch.column(1).slice(low, 256).to_pylist()]
            signed = [f - (1 << 64) if f >> 63 else f for f in fps]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def gray_rank(fps):
    """Position of each bit pattern in the Gray code (a parallel prefix of exclusive or)."""
    import numpy as np

    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_order(fp):
    """The Gray rank of a fingerprint column, as a signed long that sorts like the unsigned rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def tree(fps, depth: int):
    """Levels of nodes over ``fps`` in Gray order: (shared pattern, mask of the bits that all below agree on) of each."""
    import numpy as np

    levels = [(fps, np.full(len(fps), ~np.uint64(0)))]
    while len(levels) < depth:
        pattern, agree = levels[-1]
        starts = np.arange(0, len(pattern), FAN)
        ones = np.bitwise_and.reduceat(pattern & agree, starts)
        zeros = np.bitwise_and.reduceat(~pattern & agree, starts)
        levels.append((ones, ones | zeros))
    return levels


def near_pairs(fps, others=None, distance: int = DISTANCE, block: int = 1 << 20):
    """Index pairs (i in ``fps``, j in ``others``) with at most ``distance`` differing bits, in blocks of arrays (i, j).

    Both must be in Gray rank order; without ``others``, the pairs i < j of distinct ``fps``.
    """
    import numpy as np

    alone, depth = others is None, 1
    while FAN**depth < max(len(fps), 0 if others is None else len(others)):
        depth += 1
    left_tree = tree(fps, depth)
    right_tree = left_tree if alone else tree(others, depth)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(left_tree[-1][0])), np.arange(len(right_tree[-1][0])), indexing="ij"))
    if alone:
        a, b = a[a <= b], b[a <= b]
    stack = [(depth - 1, a, b, np.zeros(len(a), np.uint8), np.zeros(len(a), np.uint64))]
    offsets = np.arange(FAN)
    while stack:
        level, a, b, differ, shared = stack.pop()
        (one, agree_one), (two, agree_two) = left_tree[level], right_tree[level]
        both = agree_one[a] & agree_two[b]
        differ = differ + np.bitwise_count((one[a] ^ two[b]) & both & ~shared)  # only bits that were not shared above
        on = np.flatnonzero(differ <= distance)
        a, b, differ, shared = a[on], b[on], differ[on], both[on]
        if level == 0:
            if alone:
                a, b = a[a < b], b[a < b]
            if len(a):
                yield a, b
            continue
        n_left, n_right = len(left_tree[level - 1][0]), len(right_tree[level - 1][0])
        for k in range(0, len(a), block // (FAN * FAN)):
            some = slice(k, k + block // (FAN * FAN))
            i = np.repeat(a[some, None] * FAN + offsets, FAN, axis=1).ravel()
            j = np.tile(b[some, None] * FAN + offsets, (1, FAN)).ravel()
            good = np.flatnonzero((i < n_left) & (j < n_right) & ((i <= j) if alone else True))
            stack.append((level - 1, i[good], j[good], np.repeat(differ[some], FAN * FAN)[good], np.repeat(shared[some], FAN * FAN)[good]))


def local_roots(n: int, pairs):
    """Smallest index of each cluster of 0..n-1 under the index pairs."""
    import numpy as np

    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
    return root


def upper_nodes(fps: DataFrame, bits: int, run: int = 2048) -> DataFrame:
    """(node, top, pattern, agree, fps): runs of ``fps`` in Gray order with equal first ``bits``; a node's name is its first."""

    def factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def node(values: np.ndarray) -> tuple:
            ones, zeros = np.bitwise_and.reduce(values), np.bitwise_and.reduce(~values)
            return (*(int(x.view(np.int64)) for x in (values[0], ones, ones | zeros)), int(values[0] >> np.uint64(64 - bits)), values.astype("<u8").tobytes())

        held = np.zeros(0, np.uint64)
        for batch in chain(batches, [None]):
            if batch is not None:
                held = np.concatenate((held, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            top = held >> np.uint64(64 - bits)
            starts = np.r_[0, np.flatnonzero(top[1:] != top[:-1]) + 1] if len(held) else np.zeros(0, np.int64)
            starts = [k for low, high in zip(starts, [*starts[1:], len(held)], strict=True) for k in range(low, high, run)]
            if batch is not None:
                whole = list(zip(starts[:-1], starts[1:], strict=True))  # the last run may go on
            else:
                whole = list(zip(starts, [*starts[1:], len(held)], strict=True))
            rows = [node(held[low:high]) for low, high in whole]
            if rows:
                first, ones, agree, tops, packed = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(tops, pa.int64()), pa.array(ones, pa.int64()),
                                                  pa.array(agree, pa.int64()), pa.array(packed, pa.binary())], names=["node", "top", "pattern", "agree", "fps"])
                held = held[whole[-1][1]:]

    ordered = fps.select("fp", gray_order(F.col("fp")).alias("rank")).repartitionByRange("rank").sortWithinPartitions("rank")
    return ordered.select("fp").mapInArrow(factored, "node long, top long, pattern long, agree long, fps binary")


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, run: int = 2048) -> DataFrame:
    """Edges (u, v) between distinct fingerprints: one per fingerprint and pair of upper nodes where it has a near one.

    Upper nodes are told apart by as many first bits as leave about ``run`` fingerprints to each.
    """
    bits = max(4, ceil(log2(max(1, fps.count()) / run)))
    nodes = cut(upper_nodes(fps, bits, run))
    flips = [sum(1 << b for b in some) for n in range(distance + 1) for some in combinations(range(bits), n)]
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("node", "pattern", "agree")]
    asking = nodes.select(*side("a"), F.explode(F.transform(F.lit(flips).cast("array<long>"), lambda m: F.col("top").bitwiseXOR(m))).alias("top"))
    differing = F.bit_count(F.col("pattern_a").bitwiseXOR(F.col("pattern_b")).bitwiseAND(F.col("agree_a")).bitwiseAND(F.col("agree_b")))
    pairs = asking.join(nodes.select("top", *side("b")), "top").filter((F.col("node_a") <= F.col("node_b")) & (differing <= distance)).select("node_a", "node_b")
    payload = lambda s: nodes.select(F.col("node").alias(f"node_{s}"), F.col("fps").alias(f"fps_{s}"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for one, two, same in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                a, b = np.frombuffer(one, "<u8"), np.frombuffer(two, "<u8")
                found = near_pairs(a, None if same else b, distance)
                values = a if same else np.concatenate((a, b))
                root = local_roots(len(values), found if same else ((i, j + len(a)) for i, j in found))
                linked = np.flatnonzero(root != np.arange(len(values)))
                if len(linked):
                    yield pa.RecordBatch.from_arrays([pa.array(values[x].view(np.int64)) for x in (linked, root[linked])], names=["u", "v"])

    met = pairs.join(payload("a"), "node_a").join(payload("b"), "node_b").select("fps_a", "fps_b", (F.col("node_a") == F.col("node_b")).alias("same"))
    return met.mapInArrow(search, "u long, v long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(id, fingerprint, component_id) for every row: component_id is the smallest id reachable by links."""
    each = cut(fingerprints(docs, id_col, text_col))
    per_print = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(fingerprint_links(per_print.select("fp"), distance))
    joined = per_print.join(roots, per_print.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = joined.join(least, "root").select("fp", "component_id")
    hex_print = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return each.join(by_print, "fp").select(F.col("doc_id").alias(id_col), hex_print.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, one of each group of near-duplicates: the smallest id (null only if all are), of its texts the one
    with the smallest digest, once if the row repeats. Ids may be of any type that has an order; ``docs`` may have any other
    columns.

    The wide rows are shuffled once: the semi join and the removal of repeated rows share their key.
    """
    given, key = F.col(id_col), free_name(docs, "__k")
    value = F.struct(given.isNull().alias("none"), given.alias("id"), F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("")).alias("text"))
    keyed = docs.withColumn(key, value)
    found = simhash_components(keyed, key, text_col).filter(F.col(key).eqNullSafe(F.col("component_id"))).select(key).distinct()
    return keyed.join(found, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
