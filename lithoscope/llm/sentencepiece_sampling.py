"""SentencePiece encoding, decoding, and sampled segmentations without replacement.

The lattice of a text has its characters' boundaries as nodes and vocabulary pieces as edges; a segmentation is a path
with probability proportional to the product of ``exp(alpha * score)`` over its pieces. ``k`` distinct paths are drawn
by Gumbel top-k: an A* search over the lattice whose priorities are exact, perturbed log masses. The heap's entries are
groups "all paths that leave this path within this stretch of edges"; a group's best perturbed value is a Gumbel of its
log mass, cut off at the value of the group it is part of. Popping the best group draws the node where its best path
leaves, the edge and the rest top down, where the largest value stays with the sampled child; what is left of the group
goes back as up to three smaller ones, and the new path's own as another. So the paths come out in order of their
perturbed log probability, exactly as if every path had been perturbed. The (k+1)-th value is the threshold of the
inclusion scores, log(1 - exp(-exp(log p - threshold))).

All randomness is a hash of (row key, seed, draw), so a row's samples depend on nothing else. A text is cut where no
piece can cross: between two characters that no piece holds side by side, and around characters outside the
vocabulary, which are written as bytes. The lattices of these chunks are kept per worker; of a chunk with few
segmentations, each is an edge of one step. The steps of all chunks of many texts are taken together as arrays. Whole texts
of any length are sampled. Chunks keep their best segmentation too, so that a text's encoding comes from the same
lattices, and every sample is decoded and compared with its text.

Defined results: a null or empty text has one segmentation, without pieces; a text with fewer than ``k``
segmentations gives them all, with inclusion 1; rows that repeat a key and text repeat their samples; a null key is
key zero; only the two named columns are read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: A character outside every piece, between chunks that are read together.
SEPARATOR = "\n"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the best segmentation of each text."""
    kind, where = docs.schema[id_col].dataType.simpleString(), path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(where)
        for batch in batches:
            ids = [sp.encode(t or "", num_threads=1) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each list of ids, as an array or as little-endian 32-bit bytes; a null list is empty."""
    kind, where = rows.schema[id_col].dataType.simpleString(), path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(where)
        for batch in batches:
            texts = [sp.decode(np.frombuffer(i, "<i4").tolist() if isinstance(i, bytes) else i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return rows.select(F.col(id_col).alias("id"), ids_col).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """``array`` with room for ``size`` items at least."""
    if size <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(size, len(array) * 3 // 2) - len(array), array.dtype)])


class PieceTrie:
    """All pieces that begin at any place of a text, found for all places at once, a character a step.

    Steps by the commonest characters are a table; the others are looked up among sorted (state, character) keys.
    """

    def __init__(self, pieces: dict[str, int], common: int = 95):
        begun = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
        state = {p: i for i, p in enumerate(sorted(begun), 1)} | {"": 0}
        often = [c for c, _ in Counter(p[-1] for p in sorted(begun)).most_common(common)]
        self.kind, self.width = np.zeros(0x110000, np.uint8), common + 1
        self.kind[[ord(c) for c in often]] = np.arange(1, len(often) + 1)
        self.table, rare = np.zeros((len(state), self.width), np.int32), {}
        for p in begun:
            if kind := self.kind[ord(p[-1])]:
                self.table[state[p[:-1]], kind] = state[p]
            else:
                rare[state[p[:-1]] << 21 | ord(p[-1])] = state[p]
        self.table = self.table.ravel()
        self.rare = np.array(sorted(rare), np.int64)
        self.rare_to = np.array([rare[k] for k in self.rare.tolist()], np.int32)
        self.piece = np.full(len(state), -1, np.int32)
        for p, i in pieces.items():
            self.piece[state[p]] = i

    def matches(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) in order of start, long pieces first; the text must end with a character of no piece."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, place, state, found, size = self.kind[codes], np.arange(len(codes), dtype=np.int32), np.zeros(len(codes), np.int32), [], 0
        while len(place):
            kind = kinds[place + size]
            after = self.table[state * np.int32(self.width) + kind]
            odd = np.flatnonzero(kind == 0)
            if len(odd) and len(self.rare):
                key = state[odd].astype(np.int64) << 21 | codes[place[odd] + size]
                slot = np.minimum(np.searchsorted(self.rare, key), len(self.rare) - 1)
                after[odd] = np.where(self.rare[slot] == key, self.rare_to[slot], 0)
            on = np.flatnonzero(after)
            place, state, size = place[on], after[on], size + 1
            piece = self.piece[state]
            hit = np.flatnonzero(piece >= 0)
            found.append((place[hit], piece[hit]))
        count = np.zeros(len(codes), np.int32)
        for at, _ in found:
            count[at] += 1
        slot = np.cumsum(count)
        start, length, ids = (np.empty(slot[-1] if len(slot) else 0, np.int32) for _ in range(3))
        for k, (at, piece) in enumerate(found, 1):
            to = slot[at] - 1
            start[to], length[to], ids[to] = at, k, piece
            slot[at] = to
        return start, length, ids


class Lattices:
    """Chunk lattices as flat arrays of edges, with their cumulative conditional probabilities.

    A node is known by its edges: 256 times the number of the first plus their count, 0 at a chunk's end; ``next`` is
    where an edge leads. The last edge of a node has the cumulative share 1. An edge is a piece, or all pieces of a chunk
    at once: chunks of at most ``most`` segmentations have one edge for each of them, and ``guide`` says where the search
    for an edge begins. Ids are slices of ``flat``, which begins with the vocabulary. What a chunk's lattice is depends on
    the chunk alone, not on what was read before; with more than ``room`` edges, only chunks met ``often`` are kept.
    """

    def __init__(self, path: str, alpha: float, room: int = 8_000_000, often: int = 40, most: int = 32):
        self.sp, self.alpha, self.room, self.often, self.most = processor(path), alpha, room, often, most
        sp, size = self.sp, self.sp.get_piece_size()
        usable = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): i for i in usable}
        if {c for p in self.pieces for c in p} - self.pieces.keys():
            raise ValueError("a character of a piece is no piece")
        if SEPARATOR in self.pieces:
            raise ValueError("the separator is a piece")
        scores = np.array([sp.get_score(i) for i in range(size)])
        self.weight = alpha * np.maximum(scores, scores[scores > -1e8].min())
        self.bytes = {b: sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.trie = PieceTrie(self.pieces)
        joined = sorted({c for p in self.pieces if len(p) > 1 for c in p})
        self.kind, self.kinds = np.zeros(0x110000, np.int32), len(joined) + 1
        self.kind[[ord(c) for c in joined]] = np.arange(1, self.kinds)
        self.parted = np.ones((self.kinds, self.kinds), bool)  # no piece holds the two characters side by side
        for p in self.pieces:
            for a, b in zip(p, p[1:], strict=False):
                self.parted[self.kind[ord(a)], self.kind[ord(b)]] = False
        self.parted = self.parted.ravel()
        spelt = {i: p.encode() for p, i in self.pieces.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.letters = np.array([len(spelt.get(i, b"")) for i in range(size)])
        words = -(-int(self.letters.max()) // 8)
        self.spelling = np.frombuffer(b"".join(spelt.get(i, b"").ljust(8 * words, b"\0") for i in range(size)), "<u8").reshape(size, words).T.copy()
        self.masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
        self.flat = np.arange(size, dtype=np.int32)
        self.n_words = size
        some = room + room // 4  # memory that is touched only as it fills
        self.cum, self.log_p, self.next = np.zeros(some, np.float32), np.zeros(some), np.zeros(some, np.int64)
        self.ids_at, self.n_ids, self.guide = np.zeros(some, np.int32), np.zeros(some, np.uint8), np.zeros(some, np.uint8)
        self.first, self.joined = np.zeros(room // 16, np.int64), np.zeros(room // 16, bool)
        self.seen, self.best_at, self.n_best = (np.zeros(room // 16, np.int32) for _ in range(3))
        self.chunks: dict[bytes, int] = {}
        self.n_edges, self.n_flat = 0, size

    def forget(self) -> None:
        """Keep only the chunks that were met often and are one step, in the same arrays, and only if they take a third."""
        kept = [(c, at) for c, at in self.chunks.items() if self.joined[at] and self.seen[at] >= self.often]
        at = np.array([at for _, at in kept], np.int64)
        degree, best = self.first[at] & 255, self.ids_of(self.best_at[at], self.n_best[at])
        ends, sizes = np.cumsum(degree), self.n_best[at]
        if not len(at) or ends[-1] > self.room // 3:
            self.chunks, self.n_edges, self.n_flat = {}, 0, self.n_words
            return
        edges = np.repeat((self.first[at] >> 8) - (ends - degree), degree) + np.arange(ends[-1])
        ids, lengths = self.ids_of(self.ids_at[edges], self.n_ids[edges].astype(np.int64)), self.n_ids[edges].astype(np.int64)
        log_p, cum, guide, seen = self.log_p[edges], self.cum[edges], self.guide[edges], self.seen[at]
        self.n_edges, self.n_flat = 0, self.n_words
        begin = self.keep_edges(log_p, cum, np.zeros(len(edges), np.int64), self.keep_ids(ids) + np.cumsum(lengths) - lengths, lengths, guide)
        self.chunks = {c: k for k, (c, _) in enumerate(kept)}
        self.first[:len(at)] = (begin + ends - degree << 8) + degree
        self.best_at[:len(at)] = self.keep_ids(best) + np.cumsum(sizes) - sizes
        self.n_best[:len(at)], self.seen[:len(at)], self.joined[:len(at)] = sizes, seen, True

    def keep_ids(self, ids: np.ndarray) -> int:
        """Put ids after those kept; the place of the first."""
        at = self.n_flat
        self.flat = grown(self.flat, at + len(ids))
        self.flat[at:at + len(ids)] = ids
        self.n_flat += len(ids)
        return at

    def keep_edges(self, log_p: np.ndarray, cum: np.ndarray, onto: np.ndarray, ids_at: np.ndarray, n_ids, guide) -> int:
        """Put edges after those kept; the number of the first."""
        low, self.n_edges = self.n_edges, self.n_edges + len(log_p)
        for name, value in (("log_p", log_p), ("cum", cum), ("next", onto), ("ids_at", ids_at), ("n_ids", n_ids), ("guide", guide)):
            setattr(self, name, grown(getattr(self, name), self.n_edges))
            getattr(self, name)[low:self.n_edges] = value
        return low

    def learn(self, keys: list[bytes]) -> None:
        """Add the lattices of chunks; log masses to the end come from right to left, all chunks at once."""
        if not keys:
            return
        # One match over all chunks, a separator (no piece holds it) after each: a chunk's nodes are its characters'
        # places and the separator's. Characters outside the vocabulary follow, as chains of bytes.
        texts = [k.decode() for k in keys]
        known = [len(t) > 1 or t in self.pieces for t in texts]
        plain = [t for t, k in zip(texts, known, strict=True) if k]
        other = [k for k, found in zip(keys, known, strict=True) if not found]
        start, size, piece = self.trie.matches(SEPARATOR.join([*plain, ""]))
        lengths = np.array([*map(len, plain), *map(len, other)], np.int64)
        goals = np.cumsum(lengths + 1) - 1
        n_bytes = lengths[len(plain):]
        byte_at = np.repeat(goals[len(plain):] - n_bytes, n_bytes) + np.arange(n_bytes.sum()) - np.repeat(np.cumsum(n_bytes) - n_bytes, n_bytes)
        byte_id = np.array([self.bytes[b] for raw in other for b in raw], np.int64)
        at, end, ids = np.r_[start, byte_at], np.r_[start + size, byte_at + 1], np.r_[piece, byte_id]
        mass, paths = np.zeros(int(goals[-1]) + 1), np.ones(int(goals[-1]) + 1)
        rest = np.repeat(goals, lengths + 1) - np.arange(len(mass))
        w = self.weight[ids]
        far = rest[at]
        far = far.astype(np.uint16) if far.max() < 1 << 16 else far  # short numbers are sorted by counting
        by_rest = np.argsort(far, kind="stable")
        steps = np.searchsorted(far[by_rest], np.arange(1, int(far.max()) + 2))
        from_, onto, weight = at[by_rest], end[by_rest], w[by_rest]
        nodes = np.flatnonzero(np.concatenate(((True,), from_[1:] != from_[:-1])))  # where each node's edges start
        begun = np.searchsorted(nodes, steps)
        for a, b, i, j in zip(steps[:-1], steps[1:], begun[:-1], begun[1:], strict=True):
            if i < j:
                to, here = onto[a:b], nodes[i:j]
                mass[from_[here]] = np.logaddexp.reduceat(weight[a:b] + mass[to], here - a)
                paths[from_[here]] = np.minimum(np.add.reduceat(paths[to], here - a), 1e9)
        log_p = np.minimum(w + mass[end] - mass[at], 0.0)
        p = np.exp(log_p)
        starts = np.flatnonzero(np.concatenate(((True,), at[1:] != at[:-1])))
        node = np.zeros(len(mass), np.int64)
        node[at[starts]] = (self.n_edges + starts << 8) + np.diff(np.append(starts, len(p)))
        self.keep_edges(log_p, shares(p, starts), node[end], ids, 1, 0)
        # a chunk's entry has its first node, how often it was met, and its best segmentation
        count = len(self.chunks)
        best, kept = self.encoded(plain), self.n_flat
        stops = np.flatnonzero(best == self.bytes[ord(SEPARATOR)])
        sizes = np.diff(stops) - 1
        sizes = np.concatenate((sizes[sizes > 0], n_bytes))
        self.keep_ids(np.concatenate((best[best != self.bytes[ord(SEPARATOR)]], byte_id)))
        entries = slice(count, count + len(keys))
        self.first, self.joined, self.seen, self.best_at, self.n_best = (grown(x, entries.stop) for x in (self.first, self.joined, self.seen, self.best_at, self.n_best))
        self.first[entries], self.seen[entries] = node[goals - lengths], 0
        self.joined[entries] = (self.first[entries] & 255 == 1) & (self.next[self.first[entries] >> 8] == 0)
        self.best_at[entries], self.n_best[entries] = kept + np.cumsum(sizes) - sizes, sizes
        self.chunks.update(zip([k for k, found in zip(keys, known, strict=True) if found] + other, range(count, entries.stop), strict=True))
        self.join_paths(count + np.flatnonzero((paths[goals - lengths] <= self.most) & (lengths < 256) & ~self.joined[entries]))

    def encoded(self, chunks: list[str], at_once: int = 64) -> np.ndarray:
        """Best segmentations of chunks, separators around each; the mark that begins a text is left out."""
        lists = self.sp.encode([SEPARATOR.join(["", *chunks[k:k + at_once], ""]) for k in range(0, len(chunks), at_once)], num_threads=1)
        return np.fromiter(chain.from_iterable(x[1:] for x in lists), np.int32)

    def join_paths(self, every: np.ndarray) -> None:
        """Give the first nodes of these chunks one edge for each segmentation."""
        for low in range(0, len(every), 4096):
            entries = every[low:low + 4096]
            chunk, node, log_p, ids = np.arange(len(entries)), self.first[entries], np.zeros(len(entries)), np.zeros((len(entries), 0), np.int32)
            done = []
            while len(chunk):
                more = node & 255
                ends = np.cumsum(more)
                edge = np.repeat((node >> 8) - (ends - more), more) + np.arange(ends[-1])
                chunk, log_p, node = np.repeat(chunk, more), np.repeat(log_p, more) + self.log_p[edge], self.next[edge]
                ids = np.column_stack((np.repeat(ids, more, axis=0), self.flat[self.ids_at[edge]]))
                done.append((chunk[node == 0], log_p[node == 0], ids[node == 0]))
                on = node > 0
                chunk, node, log_p, ids = chunk[on], node[on], log_p[on], ids[on]
            of, log_p = (np.concatenate(x) for x in list(zip(*done, strict=True))[:2])
            at = np.concatenate([self.keep_ids(rows.ravel()) + rows.shape[1] * np.arange(len(rows)) for *_, rows in done])
            size = np.concatenate([np.full(len(rows), rows.shape[1]) for *_, rows in done])
            order = np.lexsort((-log_p, of))
            of, log_p, at, size = (x[order] for x in (of, log_p, at, size))
            starts = np.flatnonzero(np.concatenate(((True,), of[1:] != of[:-1])))
            degree = np.diff(np.append(starts, len(of)))
            cum, wide, start = shares(np.exp(log_p), starts), np.repeat(degree, degree), np.repeat(starts, degree)
            rank = np.repeat(np.arange(len(starts)), degree)
            guide = np.searchsorted(rank + cum, rank + (np.arange(len(of)) - start) / wide, side="right") - start
            edges = self.keep_edges(log_p, cum, np.zeros(len(of), np.int64), at, size, np.clip(guide, 0, wide - 1)) + starts
            self.first[entries[of[starts]]] = (edges << 8) + degree
            self.joined[entries[of[starts]]] = True

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
        """Entries of all chunks of the texts, the number of chunks of each text, the normalised texts and where each begins."""
        if self.n_edges > self.room:
            self.forget()
        normal = [self.sp.normalize(t) if t else "" for t in texts]
        text = "".join(normal)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        raw = text.encode()
        limits = np.cumsum([0, *map(len, normal)])
        kind = self.kind.take(codes)
        begins = np.concatenate(((True,), self.parted.take(kind[:-1] * np.int32(self.kinds) + kind[1:])))[:len(codes)]
        begins[limits[limits < len(codes)]] = True
        places = np.append(np.flatnonzero(begins), len(codes))
        byte_of = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(byte_of[places].astype(np.int64)), pa.py_buffer(raw)])
        coded = chunks.dictionary_encode()
        unique, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        found = list(map(self.chunks.get, unique))
        if None in found:
            self.learn([c for c, at in zip(unique, found, strict=True) if at is None])
            found = list(map(self.chunks.__getitem__, unique))
        entry = np.array(found, np.int64)
        self.seen[entry] += np.bincount(which, minlength=len(entry)).astype(np.int32)
        counts = np.diff(np.searchsorted(places[:-1], limits))
        return entry[which], counts, raw, byte_of[limits]

    def pick(self, nodes: np.ndarray, u: np.ndarray, guided: bool) -> np.ndarray:
        """An edge of each node, by its conditional probability; only first nodes of chunks have guides."""
        edges = nodes >> 8
        if guided:
            edges += self.guide.take(edges + (u * (nodes & 255)).astype(np.int64))
        left = np.flatnonzero(self.cum.take(edges) <= u)
        at, least = edges.take(left), u.take(left)
        while len(left):
            at += 1
            edges[left] = at
            more = np.flatnonzero(self.cum.take(at) <= least)
            left, at, least = left.take(more), at.take(more), least.take(more)
        return edges

    def ids_of(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ids of slices, one after the other."""
        ends = np.cumsum(size)
        return self.flat.take(np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0))

    def spells(self, ids: np.ndarray, at: np.ndarray, raw: bytes) -> np.ndarray:
        """Whether each piece's letters stand in ``raw`` from the given place on, eight bytes at a time."""
        padded = raw + bytes(8 * len(self.spelling) + 8)
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,)).copy()
        size, right = self.letters.take(ids), np.ones(len(ids), bool)
        for k, word in enumerate(self.spelling):
            if k:
                more = np.flatnonzero(size > 8)
                ids, at, size = ids.take(more), at.take(more) + 8, size.take(more) - 8
            same = ((eight.take(at) ^ word.take(ids)) & self.masks.take(size, mode="clip")) == 0
            if k:
                right[places := places.take(more) if k > 1 else more] &= same
            else:
                right &= same
        return right


def shares(p: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Cumulative sums of ``p`` within the runs that begin at ``starts``; a run ends with 1."""
    run = np.cumsum(p)
    run -= np.repeat(np.concatenate(((0.0,), run[starts[1:] - 1])), np.diff(np.append(starts, len(p))))
    run[np.append(starts[1:] - 1, len(p) - 1)] = 1.0
    return np.minimum(run, 1.0)


@lru_cache(maxsize=1)
def kept_lattices(path: str, alpha: float) -> Lattices:
    """One set of lattices per worker process, for all of its tasks; ``room`` bounds it."""
    return Lattices(path, alpha)


def mixed(key: np.ndarray, *parts) -> np.ndarray:
    """A key hashed with counters, one after the other (splitmix finalisers)."""
    x = np.asarray(key, np.uint64)
    with np.errstate(over="ignore"):
        for part in parts:
            x = np.asarray(part).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + x
            x += np.uint64(0xD1B54A32D192ED03)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                y = x >> np.uint64(shift)
                y ^= x
                if factor > 1:
                    y *= np.uint64(factor)
                x = y
    return x


def uniform(key: np.ndarray, *parts) -> np.ndarray:
    """Numbers in (0, 1) hashed from a key and counters."""
    return ((mixed(key, *parts) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def log_sum(a: float, b: float) -> float:
    """log(exp(a) + exp(b)) of two numbers."""
    a, b = max(a, b), min(a, b)
    return a + math.log1p(math.exp(b - a)) if math.isfinite(a) else a


@dataclass(eq=False)
class Path:
    """A sampled path: its edges, the log probability up to each of them and in all, and its perturbed value."""

    edges: np.ndarray
    reach: np.ndarray
    value: float


@dataclass(eq=False)
class Group:
    """A heap entry: the paths that follow ``path`` up to edge ``low`` and leave it before edge ``high``, with their best
    perturbed value; or, with ``gone``, those that leave at ``low`` by an edge that is not gone."""

    value: float
    path: Path
    low: int
    high: int
    gone: tuple[int, ...] = ()


class Search:
    """Paths of many texts at once: for each text the first ``k`` in perturbed order and the next value."""

    def __init__(self, lattices: Lattices, texts: list[str], keys: np.ndarray, k: int):
        self.lat, self.keys, self.k = lattices, keys, k
        self.entries, self.counts, self.raw, self.begins = lattices.read(texts)
        self.nodes = np.split(lattices.first[self.entries], np.cumsum(self.counts)[:-1])

    def walk(self, heads: list[np.ndarray], keys: np.ndarray, draw: int) -> list[np.ndarray]:
        """Edges of a sampled path through each row of nodes, in order."""
        lat, sizes = self.lat, np.array([len(h) for h in heads])
        nodes = np.concatenate(heads)
        back = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(nodes))  # counted from the end, as a resumed path starts inside
        state = mixed(np.repeat(mixed(keys, 2 * draw), sizes), back)
        live = np.flatnonzero(nodes)
        at, bits, count, found = nodes.take(live), state.take(live), np.zeros(len(nodes), np.int64), []
        while len(live):
            step = len(found)
            if step and step % 2 == 0:  # a hash serves two steps, 32 bits each
                bits = mixed(state.take(live), step)
            half = bits & np.uint64(0xFFFFFFFF) if step % 2 else bits >> np.uint64(32)
            edges = lat.pick(at, (half.astype(np.float64) + 0.5) * 2.0**-32, step == 0)
            found.append((live, edges))
            count[live] += 1
            at = lat.next.take(edges)
            on = np.flatnonzero(at)
            live, at, bits = live.take(on), at.take(on), bits.take(on)
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for step, (place, edges) in enumerate(found):
            out[begin.take(place) + step] = edges
        return np.split(out, np.r_[0, np.cumsum(count)][np.cumsum(sizes)][:-1])

    def path(self, edges: np.ndarray, value: float) -> Path:
        reach = np.zeros(len(edges) + 1)
        np.cumsum(self.lat.log_p.take(edges), out=reach[1:])
        return Path(edges, reach, value)

    def chunks(self, path: Path, at: int) -> int:
        """How many chunks end before the path's edge ``at``."""
        return at - np.count_nonzero(self.lat.next.take(path.edges[:at]))

    @staticmethod
    def stretch(path: Path, low: int, high: int) -> tuple[float, Path, int, int, tuple]:
        """The part of all paths that leave between two edges."""
        return -math.expm1(path.reach[high] - path.reach[low]), path, low, high, ()

    def others(self, text: int, path: Path, at: int, gone: tuple[int, ...]) -> tuple[int, np.ndarray]:
        """The first edge of the node before the path's edge ``at``, and the probabilities of its edges, of those gone 0."""
        lat = self.lat
        node = int((at and lat.next[path.edges[at - 1]]) or self.nodes[text][self.chunks(path, at)])
        head = node >> 8
        p = np.exp(lat.log_p[head:head + (node & 255)])
        for edge in gone:
            p[edge - head] = 0.0
        return head, p

    def groups(self, top: float, parts: list[tuple], u: list[float]) -> Iterator[Group]:
        """The parts (share of the mass at low, path, low, high, gone) that are not empty; each value is a Gumbel of the log
        mass, cut off at ``top``."""
        for (share, path, low, high, gone), x in zip(parts, u, strict=True):
            if share > 0:
                yield Group(-log_sum(-top, math.log(-math.log(x)) - float(path.reach[low]) - math.log(share)), path, low, high, gone)

    def leave(self, text: int, group: Group, u: float, v: float) -> tuple[int, int, float]:
        """Where the best path of a group leaves, by which edge, and the share of the edges that are left there."""
        path, at, gone = group.path, group.low, group.gone
        if not gone:
            drop = path.reach[at] - path.reach[at:group.high + 1]
            at += min(int(drop[1:].searchsorted(-math.log1p(u * math.expm1(-drop[-1])))), len(drop) - 2)
            gone = (int(path.edges[at]),)
        head, p = self.others(text, path, at, gone)
        while not (total := p.sum()):  # rounding may choose a node that nothing leaves
            at = at + 1 if at + 1 < group.high else group.low
            head, p = self.others(text, path, at, (int(path.edges[at]),))
        k = int(p.cumsum().searchsorted(v * total, side="right"))
        k = k if k < len(p) and p[k] else int(np.flatnonzero(p)[-1])
        p[k] = 0.0
        return at, head + k, float(p.sum())

    def run(self) -> tuple[list[list[Path]], np.ndarray]:
        """The paths of each text, and the perturbed value of the first that is not among them."""
        n, lat = len(self.nodes), self.lat
        roots = (-np.log(-np.log(uniform(self.keys, 1, 0)))).tolist()
        paths = [[self.path(edges, value)] for edges, value in zip(self.walk(self.nodes, self.keys, 0), roots, strict=True)]
        firsts = uniform(self.keys, 1, 1).tolist()
        open_groups = [list(self.groups(p.value, [self.stretch(p, 0, len(p.edges))], [u])) for [p], u in zip(paths, firsts, strict=True)]
        beyond, rows = np.full(n, -np.inf), list(range(n))
        for draw in range(1, self.k + 1):
            rows = [t for t in rows if open_groups[t]]
            best = [max(open_groups[t], key=lambda g: g.value) for t in rows]
            if draw == self.k or not rows:
                beyond[rows] = [g.value for g in best]
                break
            keys = self.keys[rows]
            numbers = uniform(keys[:, None], 2 * draw + 1, np.arange(6)).tolist()
            turns = [self.leave(t, g, *u[:2]) for t, g, u in zip(rows, best, numbers, strict=True)]
            heads = []
            for t, g, (at, edge, _) in zip(rows, best, turns, strict=True):
                heads.append(np.concatenate((lat.next[edge:edge + 1], self.nodes[t][self.chunks(g.path, at) + 1:])))
            for t, g, (at, edge, share), rest, u in zip(rows, best, turns, self.walk(heads, keys, draw), numbers, strict=True):
                old, new = g.path, self.path(np.concatenate((g.path.edges[:at], (edge,), rest)), g.value)
                left = [(share, old, at, at, (*(g.gone or (int(old.edges[at]),)), edge)), self.stretch(new, at + 1, len(new.edges))]
                if not g.gone:
                    left += [self.stretch(old, g.low, at), self.stretch(old, at + 1, g.high)]
                open_groups[t].remove(g)
                open_groups[t] += self.groups(g.value, left, u[2:2 + len(left)])
                paths[t].append(new)
        return paths, beyond

    def columns(self) -> list[np.ndarray | list]:
        """Of each sample: text, number from 1, ids in all, log probability, perturbed value, log inclusion, ids' checksum,
        whether they spell the text, and the ids; then of each text its best segmentation's length and checksum."""
        lat, (paths, beyond) = self.lat, self.run()
        flat = [(t, s, p) for t, some in enumerate(paths) for s, p in enumerate(some, 1)]
        text = np.array([t for t, *_ in flat], np.int64)
        log_p = np.array([p.reach[-1] for *_, p in flat])
        over = np.clip(log_p - beyond[text], -700, 5.1)
        inclusion = np.where(over > 5, 0.0, np.where(over < -30, log_p - beyond[text], np.log(-np.expm1(-np.exp(over)))))
        edges = np.concatenate([p.edges for *_, p in flat]) if flat else np.zeros(0, np.int64)
        sizes = lat.n_ids.take(edges).astype(np.int64)
        ids = lat.ids_of(lat.ids_at.take(edges), sizes)
        to = np.r_[0, np.cumsum(sizes)][np.cumsum([0, *(len(p.edges) for *_, p in flat)])]
        letters = lat.letters.take(ids)
        reach = np.r_[0, np.cumsum(letters)]
        size, begin = np.diff(reach[to]), self.begins[text]
        wrong = np.r_[0, np.cumsum(~lat.spells(ids, np.repeat(begin - reach[to[:-1]], np.diff(to)) + reach[:-1], self.raw))]
        decodes = (size == self.begins[text + 1] - begin) & (np.diff(wrong[to]) == 0)
        raw = ids.astype("<u4", copy=False).tobytes()
        best_sizes = lat.n_best[self.entries]
        best = lat.ids_of(lat.best_at[self.entries], best_sizes).astype("<u4", copy=False).tobytes()
        ends = np.r_[0, np.cumsum(best_sizes)][np.r_[0, np.cumsum(self.counts)]]
        return [text, np.array([s for _, s, _ in flat], np.int32), np.diff(to), log_p, np.array([p.value for *_, p in flat]), inclusion,
                [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)],
                decodes,
                pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(ids, pa.int32())),
                np.diff(ends), [zlib.crc32(best[4 * a:4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]]


def packed_ids(ids: pa.ListArray) -> pa.Array:
    """Lists of ids as little-endian 32-bit bytes."""
    places = 4 * ids.offsets.to_numpy().astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(places), pa.py_buffer(ids.values.to_numpy().astype("<i4", copy=False))])


OUTPUT = ("sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids_crc32 long, decodes boolean, "
          "best_n_pieces long, best_ids_crc32 long, ids")


def sample_segmentations(docs: DataFrame, k: int = 3, alpha: float = 2e-4, seed: int = 17, path: str | None = None,
                         id_col: str = "doc_id", text_col: str = "text", packed: bool = False) -> DataFrame:
    """Up to ``k`` segmentations of each row, with what they decode to, and the row's encoding (its best segmentation).

    (id, sample, n_pieces, log_prob, perturbed, log_inclusion, ids_crc32, decodes, best_n_pieces, best_ids_crc32, ids):
    checksums are of little-endian 32-bit ids; ``decodes`` says whether the pieces spell the normalised text. With ``packed``, ids are such bytes as well, which are written much faster than arrays.
    """
    kind, where = docs.schema[id_col].dataType.simpleString(), path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = kept_lattices(where, alpha)
        for batch in batches:
            low = size = 0
            texts: list[str] = []
            for r in range(batch.num_rows):
                texts.append(batch.column(2)[r].as_py() or "")
                size += len(texts[-1])
                if size >= 1 << 20 or r == batch.num_rows - 1:
                    keys = batch.column(1).slice(low, len(texts)).to_numpy(zero_copy_only=False).view(np.uint64)
                    text, *columns, ids, best_size, best_crc = Search(lattices, texts, keys, k).columns()
                    types = (pa.int32(), pa.int64(), *[pa.float64()] * 3, pa.int64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(low + text)), *map(pa.array, columns, types),
                         *(pa.array(np.asarray(c, np.int64)[text]) for c in (best_size, best_crc)), packed_ids(ids) if packed else ids],
                        names=["id", *(c.split()[0] for c in OUTPUT.split(", "))])
                    low, texts, size = r + 1, [], 0

    key = F.coalesce(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(0))
    return docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {OUTPUT}" + (" binary" if packed else " array<int>")).withColumnRenamed("id", id_col)
