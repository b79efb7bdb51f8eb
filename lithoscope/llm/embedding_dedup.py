"""Embedding near-duplicates: product quantisation with coarse inverted lists, then exact cosines.

1. Equal vectors of one label collapse to a class with a count (pre-aggregated), so copies never meet as pairs. A
   vector is scaled by the power of two of its largest component, which changes no cosine and lets squares neither
   overflow nor vanish; vectors of other lengths are kept apart like other labels, and padded with zeros for the index.
2. Coarse centroids and residual sub-space codebooks are trained on a bounded sample of the classes (unit vectors).
   Every class is indexed: its list, the codes of its residual, and the error that the codes leave.
3. A class probes every list from its own number on whose cell comes within the search radius of it: a neighbour at
   distance r can lie in another cell only if the bisector of the two centroids is at most r away. That holds for both
   sides of a link, so the one with the smaller list finds it. Near lists form groups of about ``block`` classes, and
   a class is sent once to each group that holds a list to probe.
4. In a cell (label, group, block of about ``block`` members, part of at most about ``block`` times sixteen queries) queries meet the members' codes, decoded, in one matrix
   product. A member is left out only if even its coded distance less its code error exceeds the radius, so the codes
   lose nothing; what remains is decided by the exact cosine in double precision.
5. Cells emit sums, not pairs: links per class, and one edge per class to the smallest of its local cluster. Within a
   list both sides ask and each counts its own links; between lists the side that asks counts for both.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows without a label, link
with nothing and are their own component; vectors link only with vectors of their own length; repeated rows count as vectors of their own; ids should be unique (an id that comes with several vectors is one node
of the components); a null id gives a null component unless its class has others; ids that are not whole numbers are numbered in their order; extra columns are never read; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._common import components, cut, ordered_numbers
from .simhash import local_roots

MEMBER, QUERY = 0, 1


@dataclass
class ProductQuantiser:
    """Coarse centroids and, per sub-space of the residual, a codebook."""

    centroids: np.ndarray
    books: list[np.ndarray]
    spans: list[tuple[int, int]]
    radius: float
    groups: np.ndarray

    def lists(self, unit: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Own list and the groups of the lists to probe of each unit vector."""
        c = self.centroids
        d = (c * c).sum(1) - 2 * unit @ c.T
        own = d.argmin(1)
        size = (c * c).sum(1)
        gaps = np.sqrt(np.maximum(size[own][:, None] + size[None] - 2 * c[own] @ c.T, 1e-12))
        away = (d - d[np.arange(len(unit)), own][:, None]) / (2 * gaps)
        away[np.arange(len(unit)), own] = -1
        probed = (away <= self.radius + 1e-7) & (np.arange(len(c)) >= own[:, None])
        return own, [np.unique(self.groups[row]) for row in probed]

    def encode(self, unit: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the distances that they leave."""
        rest = unit - self.centroids[own]
        codes = np.empty((len(unit), len(self.books)), np.uint8)
        left = np.zeros(len(unit))
        for m, ((a, b), book) in enumerate(zip(self.spans, self.books, strict=True)):
            d = (book * book).sum(1) - 2 * rest[:, a:b] @ book.T
            codes[:, m] = d.argmin(1)
            left += ((rest[:, a:b] - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(left)

    def decode(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        out = self.centroids[own]
        for m, ((a, b), book) in enumerate(zip(self.spans, self.books, strict=True)):
            out[:, a:b] += book[codes[:, m]]
        return out


def scaled(vectors: list, width: int) -> np.ndarray:
    """Vectors as rows of a matrix, each padded with zeros and divided by the power of two of its largest component."""
    x = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        x[k, :len(v)] = v
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Lloyd's centroids of ``x``; lists that run empty start again at a drawn row."""
    draw = np.random.default_rng(seed)
    c = x[draw.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([((c * c).sum(1) - 2 * x[i:i + 4096] @ c.T).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[draw.choice(len(x), len(c))])
    return c


def train_quantiser(sample: np.ndarray, n_lists: int, parts: int, words: int, radius: float, n_groups: int) -> ProductQuantiser:
    """A quantiser from sample vectors."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centroids = k_means(unit, n_lists)
    near = np.concatenate([((centroids * centroids).sum(1) - 2 * unit[i:i + 4096] @ centroids.T).argmin(1) for i in range(0, len(unit), 4096)])
    rest = unit - centroids[near]
    edges = np.linspace(0, unit.shape[1], min(parts, unit.shape[1]) + 1).astype(int)
    spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    middles = k_means(centroids, n_groups)
    groups = ((middles * middles).sum(1) - 2 * centroids @ middles.T).argmin(1)
    return ProductQuantiser(centroids, [k_means(rest[:, a:b], words, 6) for a, b in spans], spans, radius, groups)


def vector_classes(vectors: DataFrame) -> DataFrame:
    """(label, embedding, cid, n): classes of equal usable vectors; cid is their smallest id."""
    e = F.col("embedding")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = vectors.filter(F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0)).filter(~bad).filter(F.exists(e, lambda v: v != 0))
    return usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("cid"), F.count("*").alias("n")).filter("cid is not null")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    sample: int = 16_384, max_lists: int = 1024, parts: int = 8, words: int = 64, block: int = 4096) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; ids of any type that has an order."""
    if not isinstance(vectors.schema[id_col].dataType, IntegralType):
        given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
        numbers = ordered_numbers(given.select("id"))
        found = near_duplicates(given.join(numbers, "id", "left"), threshold, "number", "embedding", "label", sample, max_lists, parts, words, block)
        name = lambda c, number: numbers.select(F.col("id").alias(c), F.col("number").alias(number))
        named = found.withColumnRenamed("component_id", "root").join(name(id_col, "number"), "number", "left").join(name("component_id", "root"), "root", "left")
        return named.select(id_col, "n_links", "component_id", "kept")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    classes = cut(vector_classes(rows))
    found = classes.count()
    alone = rows.select(F.col("vec_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not found:
        return alone.withColumn("kept", F.col(id_col).isNotNull())
    width = classes.agg(F.max(F.size("embedding"))).first()[0]
    drawn = scaled([r["embedding"] for r in classes.select("embedding", F.xxhash64("embedding").alias("h"), "cid").orderBy("h", "cid").limit(sample).collect()], width)
    n_lists = int(max(1, min(max_lists, 2 * found**0.5, len(drawn) / 4)))
    model = rows.sparkSession.sparkContext.broadcast(train_quantiser(drawn, n_lists, parts, words, float(np.sqrt(2 - 2 * threshold)), -(-found // block)))
    kind, vector_kind = (classes.schema[c].dataType.simpleString() for c in ("label", "embedding"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pq = model.value
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                x = scaled(part.column(1).to_pylist(), width)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                own, probes = pq.lists(unit)
                codes, left = pq.encode(unit, own)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), part.column(1), pa.array(own, pa.int32()), pa.array(pq.groups[own], pa.int32()),
                     pa.array([p.tolist() for p in probes], pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left)],
                    names=["label", "cid", "n", "embedding", "own", "group", "probes", "codes", "left"])

    coded = cut(classes.select("label", "embedding", "cid", "n").mapInArrow(
        index, f"label {kind}, cid long, n long, embedding {vector_kind}, own int, group int, probes array<int>, codes binary, left double"))
    coded = coded.withColumn("width", F.size("embedding"))
    cell = ["label", "width", "group"]
    sent = coded.select(*cell[:2], F.explode(F.concat(F.array(F.struct("group", F.lit(1).alias("m"), F.lit(0).alias("q"))), F.transform(
        "probes", lambda g: F.struct(g.alias("group"), F.lit(0).alias("m"), F.lit(1).alias("q"))))).alias("s")).select(*cell[:2], "s.*")
    cells = sent.groupBy(*cell).agg(F.ceil(F.sum("m") / block).cast("int").alias("blocks"), F.ceil(F.sum("q") / (16 * block)).cast("int").alias("parts"))
    dealt = lambda n, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = (coded.join(cells, cell).filter("parts > 0").withColumn("block", dealt("blocks", 0)).withColumn("part", every("parts")).withColumn("role", F.lit(MEMBER)))
    queries = (coded.withColumn("group", F.explode("probes")).join(cells.filter("blocks > 0"), cell).withColumn("part", dealt("parts", 1))
               .withColumn("block", every("blocks")).withColumn("role", F.lit(QUERY)).withColumn("codes", F.lit(None).cast("binary")))
    place = [*cell, "block", "part"]
    fields = [*place, "role", "cid", "n", "embedding", "own", "codes", "left"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pq, key, held, links, edges = model.value, None, None, {}, []

        def flush() -> Iterator[pa.RecordBatch]:
            if edges:
                edges[:] = spanning(edges)
            u = [*links, *(a for a, _ in edges)]
            if u:
                v = [*links, *(b for _, b in edges)]
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array([*links.values(), *[0] * len(edges)], pa.int64())], names=["u", "v", "links"])
            links.clear()
            edges.clear()

        for batch in batches:
            table = batch.to_pydict()
            n = batch.num_rows
            starts = [k for k in range(n) if k == 0 or any(table[f][k] != table[f][k - 1] for f in (*place, "role"))]
            for a, b in zip(starts, [*starts[1:], n], strict=True):
                at = tuple(table[f][a] for f in place)
                part = {f: table[f][a:b] for f in ("cid", "n", "embedding", "own", "codes", "left")}
                if at != key:
                    yield from flush()
                    key, held = at, None
                if table["role"][a] == MEMBER:
                    held = part if held is None else {f: held[f] + part[f] for f in held}
                    continue
                if held is not None:
                    meet(pq, held, part, links, edges)
                    if len(links) > 100_000:
                        yield from flush()
        yield from flush()

    def meet(pq: ProductQuantiser, held: dict, asked: dict, links: dict, edges: list) -> None:
        if "x" not in held:
            held["x"] = scaled(held["embedding"], width)
            held["norm"] = np.linalg.norm(held["x"], axis=1)
            held["list"] = np.asarray(held["own"])
            held["coded"] = pq.decode(held["list"], np.frombuffer(b"".join(held["codes"]), np.uint8).reshape(len(held["cid"]), -1))
            # |query - coded|^2 <= reach^2 as a bound below the product of the two
            held["least"] = (1 + (held["coded"] ** 2).sum(1) - (pq.radius + np.asarray(held["left"]) + 1e-7) ** 2) / 2
        step = max(1, 2_000_000 // len(held["cid"]))
        for low in range(0, len(asked["cid"]), step):
            x = scaled(asked["embedding"][low:low + step], width)
            norm = np.linalg.norm(x, axis=1)
            lists = np.asarray(asked["own"][low:low + step])
            q, m = np.nonzero(((x / norm[:, None]) @ held["coded"].T >= held["least"]) & (lists[:, None] <= held["list"]))
            for k in range(0, len(q), 100_000):
                i, j = q[k:k + 100_000], m[k:k + 100_000]
                near = (x[i] * held["x"][j]).sum(1) / (norm[i] * held["norm"][j]) >= threshold
                for a, b in zip((i[near] + low).tolist(), j[near].tolist(), strict=True):
                    u, v = asked["cid"][a], held["cid"][b]
                    if u == v:
                        continue
                    links[u] = links.get(u, 0) + held["n"][b]
                    if asked["own"][a] != held["own"][b]:
                        links[v] = links.get(v, 0) + asked["n"][a]
                    edges.append((u, v))
                if len(edges) > 10_000:
                    edges[:] = spanning(edges)

    def spanning(edges: list) -> list:
        """One edge per node to the smallest node of its cluster."""
        u, v = np.array(edges, np.int64).T
        nodes, where = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = local_roots(len(nodes), [(where[:len(u)], where[len(u):])])
        far = np.flatnonzero(root != np.arange(len(nodes)))
        return list(zip(nodes[far].tolist(), nodes[root[far]].tolist(), strict=True))

    placed = members.select(*fields).unionByName(queries.select(*fields)).repartition(*place).sortWithinPartitions(*place, "role")
    sums = cut(placed.mapInArrow(search, "u long, v long, links long"))
    linked = sums.groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("links"))
    roots = components(sums.select("u", "v")).select(F.col("node").alias("cid"), "root")
    facts = classes.join(linked, "cid", "left").join(roots, "cid", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("component_id"))
    out = rows.join(facts, ["label", "embedding"], "left")
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id"),
                      F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))
