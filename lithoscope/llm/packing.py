"""Best-fit packing of tokenised documents into sequences of fixed length.

Documents are tokenised once (Arrow batches of UTF-8 bytes, ids of a chunk cached per worker), cut into pieces of at
most one sequence, and the narrow piece rows are written to the shared folder. A first shuffle spreads the pieces by
hash over lanes of equal expected weight; each lane streams its pieces, longest first, through a bounded-space online
best fit: at most ``open_bins`` bins are open, a bitset keyed by free space finds the tightest one in a few machine
operations, and when no bin fits and none may be opened, the fullest closes. Whatever lies in bins that are still open
and less than ``good_fill`` full when a lane ends (at most ``open_bins`` of them) is packed again, in at most half as
many lanes, until one lane is left; so the waste does not grow with the number of lanes.

Defined results: a null or empty text is the end token alone; a long text is cut into full pieces, the last may be
shorter; repeated rows are packed as often as they occur (their pieces are told apart by place, not by id, and are spread over
all lanes); a null id is kept; only the two named columns are read; an empty table gives an empty table. Lanes are sorted by a total order
of what is packed, so a lane that runs again gives the same bins.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut

DEFAULT_TOKENIZER = "word_bpe_49k.json"
END_ID = 1
PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Byte classes: white space, a-z, ASCII marks that never join a letter run, anything else (digits, ' and non-ASCII).
_CLASS = np.full(256, 3, np.uint8)
_CLASS[list(b" \t\n\r\x0b\x0c")] = 0
_CLASS[97:123] = 1
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = 2
#: A run of letters, or of ASCII marks without the apostrophe.
_PARTS = re.compile(r"[^\W\d_]+|[!-&(-/:-@\[-`{-~]+")


class WordCache:
    """Ids of whole texts by way of their chunks: runs without white space, cut where ASCII letters meet ASCII marks.

    Exact for the word BPE: it lower-cases, drops white space, never joins across it, and never joins a letter with a
    mark other than the apostrophe; so a text's ids are its chunks' ids in order. Batches are cut and numbered as
    arrays; only chunks new to the worker are encoded. Plain ones (runs of Latin letters and of marks, one pre-token
    each) skip the normaliser; others take the full tokenizer, parted by the end-of-text token. Texts with a
    special token's beginning are encoded whole. At most ``room`` chunks are kept.
    """

    def __init__(self, path: str, part: str = "<|endoftext|>", room: int = 1_200_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.part, self.room = Tokenizer.from_file(path), part, room
        self.part_id = self.tokenizer.token_to_id(part)
        with open(path, encoding="utf-8") as file:
            plan = json.load(file)
        plan |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        self.bare = Tokenizer.from_str(json.dumps(plan))
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.start = np.zeros(1 << 16, np.int64)
        self.used = self.count = 0

    def add(self, chunks: list[bytes], ids: np.ndarray, stops: np.ndarray) -> None:
        """Keep the ids of ``chunks``; ``stops`` are the places in ``ids`` where each chunk's end."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(chunks) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.start[self.count + 1:self.count + 1 + len(chunks)] = self.used + stops
        self.known.update(zip(chunks, range(self.count, self.count + len(chunks)), strict=True))
        self.used, self.count = self.used + len(ids), self.count + len(chunks)

    def learn(self, chunks: list[bytes]) -> None:
        plain, other = [], []
        for chunk in chunks:
            text = chunk.decode("utf-8", "replace")
            if text.isascii() and text.isalpha():
                plain.append((chunk, text, 1))
                continue
            low = text.lower()
            parts = _PARTS.findall(low)
            if (len(low) == len(text) == sum(map(len, parts)) and max(low) < "\u0250" and unicodedata.is_normalized("NFC", text)
                    and all(p.isalpha() or p.isascii() for p in parts)):
                plain.append((chunk, " ".join(parts), len(parts)))
            else:
                other.append((chunk, text))
        for low in range(0, len(plain), 1024):
            some = plain[low:low + 1024]
            ids = np.asarray(self.bare.encode(" ".join(t for _, t, _ in some), add_special_tokens=False).ids, np.uint32)
            stops, counts = np.flatnonzero(self.ends[ids]) + 1, np.cumsum([n for _, _, n in some])
            if len(stops) == counts[-1]:
                self.add([c for c, _, _ in some], ids, stops[counts - 1])
            else:
                other += [(c, c.decode("utf-8", "replace")) for c, _, _ in some]
        for low in range(0, len(other), 1024):
            some = other[low:low + 1024]
            ids = np.asarray(self.tokenizer.encode(self.part.join(t for _, t in some), add_special_tokens=False).ids, np.uint32)
            parts = np.append(np.flatnonzero(ids == self.part_id), len(ids))
            if len(parts) == len(some):
                self.add([c for c, _ in some], ids[ids != self.part_id], parts - np.arange(len(parts)))
            else:
                for chunk, text in some:
                    one = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                    self.add([chunk], one, np.array([len(one)]))

    def encode(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        whole = {k: t for k, t in enumerate(texts) if t and b"<|" in t}
        rest = [b"" if not t or k in whole else t.lower() for k, t in enumerate(texts)]
        buffer = np.frombuffer(b"\n".join(rest) + b"\n", np.uint8)
        kind = _CLASS[buffer]
        before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
        begins = (kind != 0) & ((before == 0) | ((kind == 1) & (before == 2)) | ((kind == 2) & (before == 1)))
        solid = kind != 0
        values = buffer[solid]
        offsets = np.append(np.flatnonzero(begins[solid]), len(values))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values)])
        coded = chunks.dictionary_encode()
        unique = coded.dictionary.to_pylist()
        if self.count > self.room:
            self.forget()
        self.learn([c for c in unique if c not in self.known])
        known = self.known
        entry = np.fromiter((known[c] for c in unique), np.int64, len(unique))[coded.indices.to_numpy()]
        first = self.start[entry]
        size = self.start[entry + 1] - first
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        limits = np.cumsum([len(t) + 1 for t in rest])
        stops = np.concatenate([[0], ends])[np.searchsorted(np.flatnonzero(begins), limits)]
        at = 0
        for k, stop in enumerate(stops):
            if k in whole:
                yield np.asarray(self.tokenizer.encode(whole[k].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
            else:
                yield ids[at:stop]
            at = stop


def portions(texts: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, texts) of a batch in portions of about ``most`` bytes."""
    low, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(text.as_py())
        size += len(held[-1] or b"")
        if size >= most:
            yield low, held
            low, held, size = k + 1, [], 0
    if held:
        yield low, held


def pieces_of(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = END_ID, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, crc32 of its ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(path)
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            doc_ids, rows, texts = batch.column(0), [], batch.column(1)
            for low, some in portions(texts):
                for k, found in enumerate(cache.encode(some), low):
                    ids = found.astype("<u4").tobytes() + end
                    for n, at in enumerate(range(0, len(ids), step)):
                        one = ids[at:at + step]
                        rows.append((k, n, at // 4, len(one) // 4, zlib.crc32(one)))
            row, n, start, length, crc = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([
                doc_ids.take(pa.array(row, pa.int64())), pa.array(n, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, PIECES.format(id=kind))


class OpenBins:
    """A fixed number of open bins; bit f of ``bits`` is set if a bin with f free tokens is open."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit, self.bits, self.count, self.made = capacity, limit, 0, 0, 0
        self.by_free: list[list] = [[] for _ in range(capacity + 1)]

    def put(self, length: int) -> tuple[list, list | None]:
        """The bin [number, free, rows...] that takes ``length`` tokens, and a bin that had to close for it."""
        closed, fits = None, self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            box = self.pop(free)
        else:
            if self.count >= self.limit:
                closed = self.pop((self.bits & -self.bits).bit_length() - 1)
            box = [self.made, self.capacity, []]
            self.made += 1
        box[1] -= length
        return box, closed

    def pop(self, free: int) -> list:
        box = self.by_free[free].pop()
        self.count -= 1
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        return box

    def keep(self, box: list) -> None:
        self.by_free[box[1]].append(box)
        self.bits |= 1 << box[1]
        self.count += 1

    def rest(self) -> Iterator[list]:
        while self.bits:
            yield self.pop((self.bits & -self.bits).bit_length() - 1)


def pack_round(pieces: DataFrame, lanes: int, capacity: int, open_bins: int, good_fill: float, last: bool, stamp: int) -> DataFrame:
    """Pieces with sequence_id and offset; both null in bins that a lane's end found less than ``good_fill`` full."""
    fields = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, out = OpenBins(capacity, open_bins), []
        lane = (stamp << 56) | (TaskContext.get().partitionId() << 34)

        def close(box: list, ended: bool = False) -> None:
            good = last or not ended or capacity - box[1] >= good_fill * capacity
            at = 0
            for row in box[2]:
                out.append((*row, lane + box[0] if good else None, at if good else None))
                at += row[3]

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(schema)
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
            out.clear()
            return made

        schema = None
        for batch in batches:
            if schema is None:
                schema = batch.schema.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                box, closed = bins.put(row[3])
                box[2].append(row)
                if closed:
                    close(closed)
                if box[1]:
                    bins.keep(box)
                else:
                    close(box)
            if out:
                yield flush()
        for box in bins.rest():
            close(box, ended=True)
            if len(out) >= 10_000:
                yield flush()
        if out:
            yield flush()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    order = [F.col("length").desc(), *[c for c in fields if c != "length"]]
    # the row's place in the written pieces is part of the hash: equal rows, however many, are spread over all lanes
    spread = pieces.repartition(lanes, F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()))
    return spread.sortWithinPartitions(*order).mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def best_fit_pack(docs: DataFrame, path: str | None = None, capacity: int = 4096, end_id: int = END_ID, id_col: str = "doc_id",
                  text_col: str = "text", open_bins: int = 2048, good_fill: float = 0.995, lane_tokens: int = 1 << 25) -> DataFrame:
    """Pieces of ``docs`` with sequence_id and offset: (id, piece, start, length, ids_crc32, sequence_id, offset)."""
    left = cut(pieces_of(docs, path or tokenizer_path(), capacity, end_id, id_col, text_col))
    done: list[DataFrame] = []
    lanes, stamp = 1 << 48, 0
    while lanes > 1:
        total = left.agg(F.sum("length")).first()[0] or 0
        lanes = max(1, min(lanes // 2, -(-total // lane_tokens)))
        last = lanes == 1
        packed, stamp = pack_round(left, lanes, capacity, open_bins, good_fill, last, stamp), stamp + 1
        if last:
            done.append(packed)
            break
        packed = cut(packed)
        done.append(packed.filter("sequence_id is not null"))
        left = packed.filter("sequence_id is null").drop("sequence_id", "offset")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out


def full_sequences(packed: DataFrame) -> DataFrame:
    """What the packing is worth: sequences, tokens and the least number of sequences that could hold them."""
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    return per.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"))
