"""Removal of repeated byte strings by column-wise construction of a collection's BWT and common prefixes.

Every string of ``length`` bytes has a minimizer: the gram of ``GRAM`` bytes in it with the smallest hash.
Neighbouring strings that share one occurrence of a minimizer form a segment of at most 2 * length - GRAM
bytes. Equal strings have equal minimizers at equal places, so once the segments of one minimizer bucket
are brought together and written with their minimizers in the same columns, equal strings start in the
same column, and every string lies whole in one segment of its bucket.

A bucket's segments are the collection: column by column, from the last to the first, one symbol is
inserted in front of each segment's suffix. What is known of the collection between two columns stands in
sequential files in the shared folder: the suffixes' order, the common prefix of each with the one above it,
and the transform, which is each suffix's next symbol. A round reads these files from front to back with a
bounded buffer. The new order follows from the old one and the transform alone (a stable sort by symbol), the
new common prefix is one more than the smallest of the old ones between two rows of one symbol, and the next
column's symbols are the new transform. A buffer is written as one run, sorted; runs are merged by symbol when
they are read. Segments that end in a column come in there; ones that began right of it go out. Where at
least ``length`` bytes are common, suffixes are one string, and the smallest doc_id among them is the string's.

What is brought together is cut down first, without loss: minimizers that occur in one document only are
found from their hashes, and equal segments of a chunk of documents are sent once. A minimizer that a third
of all documents have with equal bytes beside it is thus one row a chunk. One with more than ``crowd``
occurrences may have any bytes beside it: each of its strings becomes a segment of its own, dealt by a hash
of the whole string, so no bucket holds them all and equal strings still meet.

Texts stay in compressed chunks in a bucketed table in the warehouse, which each pass reads in order and joins
without moving; a chunk sends no more blobs than it has minimizers. Texts of more than a chunk are cut into
pieces that overlap by what a string can reach, and put together again in the end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treefuse.llm.shared import cut, scratch_table, shared_dir
from treefuse.llm.textarrays import parts, release

GRAM = 20
BUFFER = 1 << 18  # rows of a sequential file that are read or sorted at once
_BYTE = np.random.default_rng(17).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
PLACE = 17  # low bits of a key hold the place in a run of 2**16 bytes, so that ties go to the left


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64)
    return zstandard.ZstdCompressor(level=level).compress(b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = np.frombuffer(raw, np.int64, len(kinds), 8), 8 * (len(kinds) + 1), []
    for kind, n in zip(kinds, sizes.tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def power(n: int) -> np.uint64:
    return np.uint64(pow(_A, n, 2**64))


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_A to the 0 .. n, and its inverses."""
    up, down = np.full(n + 1, _A, np.uint64), np.full(n + 1, pow(_A, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def smallest_keys(data: np.ndarray, length: int) -> np.ndarray:
    """For each string of ``length`` bytes its smallest gram's hash, with the gram's place in the low bits."""
    have, p = {1: _BYTE[data]}, 1
    while 2 * p <= GRAM:
        have[2 * p] = have[p][:-p] * power(p) + have[p][p:]
        p *= 2
    gram, size, q = have[p], p, p
    while size < GRAM:
        q //= 2
        if size + q <= GRAM:
            n = len(gram) - q
            gram = gram[:n] * power(q) + have[q][size : size + n]
            size += q
    key = gram * _MIX
    key ^= key >> np.uint64(32)
    key *= _MIX
    key = (key & ~np.uint64((1 << PLACE) - 1)) | np.arange(len(key), dtype=np.uint64)
    span, p = length - GRAM + 1, 1
    while 2 * p <= span:
        key = np.minimum(key[:-p], key[p:])
        p *= 2
    return np.minimum(key[: len(key) - (span - p)], key[span - p :])


def occurrences(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of strings with one minimizer occurrence: first and last string, the minimizer's place and hash, the row."""
    n, lens = len(data), np.diff(at)
    empty = np.zeros(0, np.int64)
    if n < length or not (lens >= length).any():
        return empty, empty, empty, empty.astype(np.uint64), empty
    long = lens >= length
    change = np.zeros(n + 1, np.int8)
    np.add.at(change, at[:-1][long], 1)
    np.add.at(change, at[1:][long] - length + 1, -1)
    inside = np.cumsum(change[:n], dtype=np.int8) > 0
    hashes, place = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    run = 1 << 16
    for a in range(0, n - length + 1, run):
        key = smallest_keys(data[a : min(a + run + length - 1, n)], length)
        hashes[a : a + len(key)] = key >> np.uint64(PLACE)
        place[a : a + len(key)] = (key & np.uint64((1 << PLACE) - 1)).astype(np.int64) + a
    starts = np.zeros(n, bool)
    starts[at[:-1][lens > 0]] = True
    new = inside.copy()
    new[1:] &= (place[1:] != place[:-1]) | starts[1:] | ~inside[:-1]
    first = np.flatnonzero(new)
    row = np.searchsorted(at, first, "right") - 1
    last = np.minimum(np.concatenate((first[1:], [n])) - 1, at[row + 1] - length)
    return first, last, place[first], hashes[first], row


def pieces(data: np.ndarray, at: np.ndarray, most: int, length: int) -> tuple[np.ndarray, ...]:
    """Rows in pieces that own at most ``most`` bytes (whole characters) and reach ``length`` - 1 bytes beyond on
    either side: the row, the piece's number, its first and last byte, its first and last own byte."""
    lens = np.diff(at)
    count = np.maximum(1, -(-lens // most))
    row = np.repeat(np.arange(len(lens)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    own = at[row] + number * most
    for _ in range(3):  # back to a character's first byte
        inner = np.flatnonzero(number > 0)
        own[inner] -= (data[own[inner]] & 0xC0) == 0x80
    stop = np.where(number == count[row] - 1, at[row + 1], np.concatenate((own[1:], [0])))
    return row, number, np.maximum(own - length + 1, at[row]), np.minimum(stop + length - 1, at[row + 1]), own, stop


def gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many stretches one after another."""
    return data[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def chunks(docs: DataFrame, chunk_bytes: int, length: int) -> DataFrame:
    """docs(doc_id, text) -> chunk, texts: documents packed together, sorted by doc_id within a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, rows = 0, 0, []

        def close() -> pa.RecordBatch:
            ids, number, low, high, size, data = (np.concatenate([r[i] for r in rows]) for i in range(6))
            order = np.lexsort((number, ids))
            begin = (np.cumsum(size) - size)[order]
            size = size[order]
            blob = pack(ids[order], number[order], low[order], high[order], np.concatenate(([0], np.cumsum(size))), gathered(data, begin, size), level=3)
            name = (TaskContext.get().partitionId() << 32) + made
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "texts"])

        for part, data, at in parts(batches, "__text", chunk_bytes):
            row, number, first, last, own, stop = pieces(data, at, chunk_bytes, length)
            ids, size = part.column("doc_id").to_numpy()[row], last - first
            filled = np.cumsum(size + 64)
            a = 0
            while a < len(row):
                b = max(a + 1, int(np.searchsorted(filled, (filled[a - 1] if a else 0) + chunk_bytes - held, "right")))
                rows.append((ids[a:b], number[a:b], (own - first)[a:b], (stop - first)[a:b], size[a:b], gathered(data, first[a:b], size[a:b])))
                held += int(filled[b - 1] - (filled[a - 1] if a else 0))
                a = b
                if held >= chunk_bytes // 2 and (a < len(row) or held >= chunk_bytes):
                    yield close()
                    made, held, rows = made + 1, 0, []
        if rows:
            yield close()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("__text")).mapInArrow(run, "chunk bigint, texts binary")


def bucketed(df: DataFrame, key: str, n: int) -> DataFrame:
    """The same rows as a table in the shared folder, dealt by the key once: later joins on it leave these rows in place."""
    name, folder = scratch_table(df.sparkSession, "texts")
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("compression", "none").option("path", folder).saveAsTable(name)
    return df.sparkSession.table(name)


class Chunk:
    """A chunk's texts and its distinct minimizers, in the order in which all passes number them."""

    def __init__(self, blob: bytes, buckets: int, length: int):
        self.ids, self.number, self.low, self.high, self.at, self.data = unpack(blob, np.int64, np.int64, np.int64, np.int64, np.int64, np.uint8)
        self.first, self.last, self.place, hashes, self.row = occurrences(self.data, self.at, length)
        bucket = hashes % np.uint64(buckets)
        rest = (hashes // np.uint64(buckets)) & np.uint64((1 << 40) - 1)
        key = (bucket << np.uint64(40)) | rest
        self.keys, begin, self.which, self.times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        top = np.full(len(self.keys), np.iinfo(np.int64).min)
        np.maximum.at(top, self.which, self.ids[self.row])
        self.shared = top != self.ids[self.row[begin]]  # in two documents of the chunk
        self.full, cuts = np.unique((self.keys >> np.uint64(40)).astype(np.int64), return_index=True)
        self.cuts = np.append(cuts, len(self.keys))  # where each of the full buckets begins


def send_minimizers(staged: DataFrame, buckets: int, length: int) -> DataFrame:
    """By bucket: a chunk's minimizers, how often they occur (as a power of two) and whether in two documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, texts in zip(batch.column("chunk").to_pylist(), batch.column("texts").to_pylist(), strict=True):
                c = Chunk(texts, buckets, length)
                rest = c.keys & np.uint64((1 << 40) - 1)
                low, high = (rest & np.uint64(0xFFFFFFFF)).astype(np.uint32), (rest >> np.uint64(32)).astype(np.uint8)
                often = (2 * np.frexp(c.times.astype(np.float64))[1] + c.shared).astype(np.uint8)
                blobs = [pack(low[x:y], high[x:y], often[x:y]) for x, y in zip(c.cuts[:-1], c.cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c.full, pa.int32()), pa.array([name] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "blob"])
        release()

    return staged.mapInArrow(run, "bucket int, chunk bigint, blob binary")


def find_repeated(sent: DataFrame, crowd: int) -> DataFrame:
    """Per chunk and bucket one bit a minimizer: does it occur in two documents of the corpus? And which of them
    occur more than about ``crowd`` times."""

    def run(table: pa.Table) -> pa.Table:
        keys, often = [], []
        for blob in table.column("blob").to_pylist():
            low, high, code = unpack(blob, np.uint32, np.uint8, np.uint8)
            keys.append(low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)))
            often.append(code)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        every, code = np.concatenate(keys), np.concatenate(often)
        order = np.argsort(every, kind="stable")
        begin = np.flatnonzero(np.concatenate(([True], every[order][1:] != every[order][:-1])))
        count = np.diff(np.append(begin, len(every)))
        times = np.add.reduceat(np.exp2(code[order] // 2 - 1.0), begin)
        hit, hot = np.empty(len(every), bool), np.empty(len(every), bool)
        hit[order] = np.repeat((count > 1) | np.maximum.reduceat(code[order] % 2 == 1, begin), count)
        hot[order] = np.repeat(times > crowd, count)
        flags = [np.packbits(x).tobytes() for x in np.split(hit, ends)]
        crowded = [np.flatnonzero(x).astype(np.int32).tobytes() for x in np.split(hot, ends)]
        release()
        return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "flags": pa.array(flags, pa.binary()), "hot": pa.array(crowded, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, "bucket int, chunk bigint, flags binary, hot binary")


class Segments:
    """A chunk's segments of repeated minimizers, each distinct one numbered once, by bucket and then by document."""

    def __init__(self, c: Chunk, flags: list, buckets: int, length: int):
        known = {f["bucket"]: f for f in flags or []}
        repeated, hot = np.zeros(len(c.keys), bool), np.zeros(len(c.keys), bool)
        for b, x, y in zip(c.full.tolist(), c.cuts[:-1], c.cuts[1:], strict=True):
            repeated[x:y] = np.unpackbits(np.frombuffer(known[b]["flags"], np.uint8), count=y - x)
            hot[x + np.frombuffer(known[b]["hot"], np.int32)] = True
        one = np.flatnonzero(repeated[c.which] & ~hot[c.which])
        many = np.flatnonzero(repeated[c.which] & hot[c.which])
        strings = c.last[many] - c.first[many] + 1
        each = np.repeat(many, strings)
        start = c.first[each] + np.arange(len(each)) - np.repeat(np.cumsum(strings) - strings, strings)
        self.first = np.concatenate((c.first[one], start))
        self.end = np.concatenate((c.last[one] + length, start + length))
        self.place, self.row = (np.concatenate((x[one], x[each])) for x in (c.place, c.row))
        up, down = powers(-(-len(c.data) // (1 << 19)) << 19)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[c.data] * up[: len(c.data)])))
        content = (sums[self.end] - sums[self.first]) * down[self.first] + (self.place - self.first).astype(np.uint64) * _MIX + (self.end - self.first).astype(np.uint64)
        content ^= content >> np.uint64(29)
        del sums
        bucket = np.concatenate(((c.keys[c.which[one]] >> np.uint64(40)).astype(np.int64), ((content[len(one) :] * _MIX >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)))
        order = np.lexsort((content, bucket))
        new = np.concatenate(([True], (content[order][1:] != content[order][:-1]) | (bucket[order][1:] != bucket[order][:-1]))) if len(order) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        lead = order[begin]  # lexsort is stable, and occurrences stand by document: a segment's smallest one
        turn = np.lexsort((lead, self.row[lead], bucket[lead]))  # in the order of documents, so that neighbours look alike
        number = np.empty(len(lead), np.int64)
        number[turn] = np.arange(len(lead))
        self.number = np.empty(len(order), np.int64)  # of each occurrence
        self.number[order] = number[np.cumsum(new) - 1]
        self.lead = lead[turn]
        self.full, cuts = np.unique(bucket[self.lead], return_index=True)
        self.cuts = np.append(cuts, len(self.lead))


def with_flags(staged: DataFrame, repeated: DataFrame) -> DataFrame:
    flags = repeated.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "flags", "hot")).alias("flags"))
    return staged.join(flags, "chunk", "left")


def send_segments(flagged: DataFrame, buckets: int, length: int) -> DataFrame:
    """A chunk's distinct segments, by bucket: bytes left of the minimizer, size, smallest doc_id, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, texts, flags in zip(batch.column("chunk").to_pylist(), batch.column("texts").to_pylist(), batch.column("flags").to_pylist(), strict=True):
                c = Chunk(texts, buckets, length)
                found = Segments(c, flags, buckets, length)
                blobs = []
                for x, y in zip(found.cuts[:-1], found.cuts[1:], strict=True):
                    s = found.lead[x:y]
                    size = found.end[s] - found.first[s]
                    blobs.append(pack((found.place[s] - found.first[s]).astype(np.uint8), size.astype(np.uint8), np.diff(c.ids[found.row[s]], prepend=0), gathered(c.data, found.first[s], size), level=3))
                yield pa.RecordBatch.from_arrays([pa.array(found.full, pa.int32()), pa.array([name] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "blob"])
        release()

    return flagged.select("chunk", "texts", "flags").mapInArrow(run, "bucket int, chunk bigint, blob binary")


def range_minima(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all runs of 1, 2, 4, ... values."""
    out, p = [values], 1
    while 2 * p <= len(values):
        out.append(np.minimum(out[-1][:-p], out[-1][p:]))
        p *= 2
    return out


class Files:
    """A bucket's sequential files: a folder of its own for each attempt of a task."""

    def __init__(self, root: str):
        self.fs, path = pafs.FileSystem.from_uri(root)
        self.path = f"{path}/{uuid.uuid4().hex}"
        self.fs.create_dir(self.path, recursive=True)

    def write(self, name: str, values: np.ndarray) -> None:
        with self.fs.open_output_stream(f"{self.path}/{name}") as f:
            f.write(np.ascontiguousarray(values).data)

    def reader(self, name: str, kind: type):
        stream, width = self.fs.open_input_stream(f"{self.path}/{name}"), np.dtype(kind).itemsize
        return lambda n: np.frombuffer(stream.read(n * width), kind)

    def part(self, name: str, kind: type, a: int, b: int) -> np.ndarray:
        width = np.dtype(kind).itemsize
        with self.fs.open_input_file(f"{self.path}/{name}") as f:
            return np.frombuffer(f.read_at((b - a) * width, a * width), kind)

    def drop(self) -> None:
        self.fs.delete_dir(self.path)


class Collection:
    """A bucket's segments (bytes left of the minimizer, size, document, bytes one after another) and what is
    known of their suffixes, which stands in ``files`` between two columns."""

    def __init__(self, files: Files, left: np.ndarray, size: np.ndarray, doc: np.ndarray, text: np.ndarray, length: int, buffer: int = BUFFER):
        self.files, self.doc, self.length, self.buffer = files, doc, length, buffer
        self.most = length - GRAM
        self.start, self.stop = self.most - left, self.most - left + size  # columns; minimizers begin in column ``most``
        begin = np.cumsum(size) - size
        self.columns = np.zeros((2 * length - GRAM, len(size)), np.uint8)
        for a in range(0, len(size), 1 << 14):  # in parts, since the index is many times the text
            part = slice(a, a + (1 << 14))
            own = size[part]
            within = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            self.columns[np.repeat(self.start[part], own) + within, np.repeat(np.arange(a, a + len(own)), own)] = text[begin[a] : begin[a] + len(within)]
        self.runs: list[np.ndarray] = []  # of the files: rows by the symbol they are sorted by
        self.side = 0

    def rows(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Order, common prefixes and transform in bounded parts: of each symbol first to last run."""
        readers = [[self.files.reader(f"{name}-{self.side}-{r}", kind) for name, kind in (("order", np.int32), ("prefix", np.uint8), ("symbol", np.uint8))] for r in range(len(self.runs))]
        turns = [(0, int(self.runs[0].sum()))] if len(self.runs) == 1 else [(r, int(n[s])) for s in range(256) for r, n in enumerate(self.runs) if n[s]]
        held, n = [], 0
        for r, left in turns:
            while left:
                k = min(left, self.buffer - n)
                held.append([read(k) for read in readers[r]])
                left, n = left - k, n + k
                if n == self.buffer:
                    yield tuple(np.concatenate([h[i] for h in held]) for i in range(3))
                    held, n = [], 0
        if n:
            yield tuple(np.concatenate([h[i] for h in held]) for i in range(3))

    def staying(self, c: int, enter: np.ndarray, found: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
        """The rows of column c + 1 that have a symbol in column c, behind those that end there. On the way the
        strings of column c + 1 get their smallest documents in ``found``."""
        for a in range(0, len(enter), self.buffer):
            part = enter[a : a + self.buffer]
            yield part, np.zeros(len(part), np.uint8), self.columns[c][part]
        low, open_, smallest, top = 255, [], 0, len(enter) > 0
        for order, common, symbol in self.rows() if self.runs else ():
            if found is not None:
                breaks = np.flatnonzero(common < self.length)
                head = order[: breaks[0]] if len(breaks) else order
                if len(head):
                    open_.append(head)
                    smallest = min(smallest, self.doc[head].min())
                if len(breaks):
                    for rows in open_:
                        found[rows] = smallest
                    least = np.minimum.reduceat(self.doc[order], breaks)
                    inner = np.diff(breaks)
                    found[order[breaks[0] : breaks[-1]]] = np.repeat(least[:-1], inner)
                    open_, smallest = [order[breaks[-1] :]], least[-1]
            if c < 0:
                continue
            kept = np.flatnonzero(self.start[order] <= c)
            if not len(kept):
                low = min(low, int(common.min()))
                continue
            # A row that goes out leaves its limit to the row below.
            limit = np.minimum.reduceat(common[: kept[-1] + 1], np.concatenate(([0], kept[:-1] + 1)))
            limit[0] = 0 if top else min(int(limit[0]), low)
            low, top = int(common[kept[-1] + 1 :].min(initial=255)), False
            yield order[kept], limit, symbol[kept]
        for rows in open_:
            found[rows] = smallest

    def insert(self, c: int, enter: np.ndarray, found: np.ndarray | None) -> None:
        """One round: the symbols of column c come in front of all suffixes."""
        runs, seen, since = [], np.zeros(256, bool), np.full(256, 255, np.uint8)
        for order, common, symbol in self.staying(c, enter, found):
            moved = np.argsort(symbol, kind="stable")
            sorted_, n = symbol[moved], np.bincount(symbol, minlength=256)
            new = np.zeros(len(order), np.uint8)
            same = np.flatnonzero(sorted_[1:] == sorted_[:-1]) + 1
            lo, hi = moved[same - 1] + 1, moved[same] + 1
            level, minima = np.frexp((hi - lo).astype(np.float64))[1] - 1, range_minima(common)
            for k in range(len(minima)):
                at = np.flatnonzero(level == k)
                if len(at):
                    new[same[at]] = 1 + np.minimum(minima[k][lo[at]], minima[k][hi[at] - (1 << k)])
            # A symbol's first row follows its last one in an earlier part, if there was one.
            here = np.flatnonzero(n)
            firsts, lasts = moved[np.cumsum(n)[here] - n[here]], moved[np.cumsum(n)[here] - 1]
            before, behind = np.minimum.accumulate(common), np.append(np.minimum.accumulate(common[::-1])[::-1], np.uint8(255))
            new[np.cumsum(n)[here] - n[here]] = np.where(seen[here], 1 + np.minimum(since[here], before[firsts]), 0)
            since = np.minimum(since, before[-1])
            since[here], seen[here] = behind[lasts + 1], True
            order = order[moved]
            for name, values in (("order", order.astype(np.int32)), ("prefix", new), ("symbol", self.columns[c - 1][order] if c else np.zeros(len(order), np.uint8))):
                self.files.write(f"{name}-{1 - self.side}-{len(runs)}", values)
            runs.append(n)
        self.runs, self.side = runs, 1 - self.side

    def smallest_documents(self) -> None:
        """Writes, for each column in which strings can start, each segment's smallest document (-1: no string)."""
        ending = np.argsort(self.stop, kind="stable")
        edges = np.searchsorted(self.stop[ending], np.arange(len(self.columns) + 2))
        for c in range(len(self.columns) - 1, -2, -1):
            found = np.full(len(self.doc), -1, np.int32) if c < self.most else None  # of column c + 1
            enter = ending[edges[c + 1] : edges[c + 2]].astype(np.int32) if c >= 0 else ending[:0]
            if c >= 0:
                self.insert(c, enter, found)
            else:
                for _ in self.staying(c, enter, found):
                    pass
            if found is not None:
                found[(self.stop - (c + 1) < self.length) | (self.start > c + 1)] = -1
                self.files.write(f"found-{c + 1}", found)

    def found(self, a: int, b: int) -> np.ndarray:
        """Segments a to b x columns: what was found."""
        return np.stack([self.files.part(f"found-{c}", np.int32, a, b) for c in range(self.most + 1)], 1)


def judge(sent: DataFrame, length: int, folder: str) -> DataFrame:
    """Per chunk and bucket: the smallest doc_id of each string of each segment, as runs of equal values."""

    def run(table: pa.Table) -> pa.Table:
        found = [unpack(b, np.uint8, np.uint8, np.int64, np.uint8) for b in table.column("blob").to_pylist()]
        left, size, text = (np.concatenate([f[i] for f in found]) for i in (0, 1, 3))
        doc = np.concatenate([np.cumsum(f[2]) for f in found])
        ends = np.cumsum([len(f[0]) for f in found])
        begins = ends - [len(f[0]) for f in found]
        del found
        left, size = left.astype(np.int64), size.astype(np.int64)
        ids, rank = np.unique(doc, return_inverse=True)
        files = Files(folder)
        try:
            collection = Collection(files, left, size, rank.astype(np.int32), text, length)
            del text
            collection.smallest_documents()
            blobs, low, high = [], 0, 0
            for a, b in zip(begins, ends, strict=True):
                if b > high:  # the next chunks' segments, about a buffer of them
                    low, high = a, max(b, min(len(size), a + BUFFER // 4))
                    block = collection.found(low, high)
                mine = block[a - low : b - low]
                flat = mine[mine >= 0]  # by segment, then by column
                begin = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
                blobs.append(pack(begin.astype(np.uint32), ids[flat[begin]], (size[a:b] - length + 1).astype(np.uint8)))
        finally:
            files.drop()
        del collection
        release()
        return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "blob": pa.array(blobs, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, "bucket int, chunk bigint, blob binary")


def removed_mask(c_ids: np.ndarray, at: np.ndarray, n: int, segment: np.ndarray, first: np.ndarray, verdicts: list[tuple[np.ndarray, ...]], length: int) -> np.ndarray:
    """Which bytes of a chunk are covered by a string that a smaller document has."""
    change = np.zeros(n + 1, np.int32)
    if len(segment):
        strings = np.concatenate([v[2] for v in verdicts]).astype(np.int64)
        smallest = np.concatenate([np.repeat(v[1], np.diff(np.concatenate((v[0].astype(np.int64), [int(v[2].sum(dtype=np.int64))])))) for v in verdicts])
        begin = np.cumsum(strings) - strings
        count = strings[segment]
        inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(first, count) + inner
        doc = c_ids[np.repeat(np.searchsorted(at, first, "right") - 1, count)]
        start = start[smallest[np.repeat(begin[segment], count) + inner] < doc]
        change += np.bincount(start, minlength=n + 1).astype(np.int32) - np.bincount(start + length, minlength=n + 1)[: n + 1].astype(np.int32)
    return np.cumsum(change[:n]) > 0


PIECES = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, text string, piece bigint, alone boolean, opens boolean, closes boolean"
WHOLE = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "text"]


def put_together(table: pa.Table) -> pa.Table:
    """A document's pieces as one row; a removed run that goes on in the next piece is one run."""
    table = table.sort_by("piece")
    opens, closes = table.column("opens").to_pylist(), table.column("closes").to_pylist()
    twice = sum(a and b for a, b in zip(closes[:-1], opens[1:], strict=True))
    total = lambda c: sum(table.column(c).to_pylist())
    values = [table.column("doc_id")[0].as_py(), total("n_bytes"), total("n_removed"), total("n_spans") - twice, b"".join(table.column("kept").to_pylist()), "".join(table.column("text").to_pylist())]
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.string()]
    return pa.table({n: pa.array([v], k) for n, v, k in zip(WHOLE, values, kinds, strict=True)})


def remove_repeats(docs: DataFrame, length: int = 50, chunk_bytes: int = 1 << 20, bucket_bytes: int = 8 << 20, crowd: int = 1 << 17) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept (binary), text.

    A byte of a text (UTF-8) goes if a string of ``length`` bytes covers it that also starts in a document
    with a smaller doc_id; strings are judged on the input. ``kept`` is what is left, ``text`` the same but
    for characters that lost only a part of their bytes, which stay whole. Null texts are empty; texts
    shorter than ``length`` stay. Repeated rows of one doc_id count once, with the first of their texts in
    order; rows without doc_id are left out; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = cut(docs.groupBy("doc_id").agg(F.min("text").alias("text")))
    total, longest = (x or 0 for x in docs.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first())
    buckets = max(8, -(-total // bucket_bytes))
    # As many buckets as shuffles have partitions at least, else Spark would deal the texts out anew to join them.
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = bucketed(chunks(docs, chunk_bytes, length), "chunk", max(parallel, -(-total // (32 * chunk_bytes))))
    repeated = cut(find_repeated(send_minimizers(staged, buckets, length), crowd))
    sent = send_segments(with_flags(staged, repeated), buckets, length)
    judged = judge(sent, length, f"{shared_dir(spark)}/columns-{uuid.uuid4().hex}")
    verdicts = judged.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "blob"))).alias("verdicts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, flags, found in zip(batch.column("texts").to_pylist(), batch.column("flags").to_pylist(), batch.column("verdicts").to_pylist(), strict=True):
                c = Chunk(texts, buckets, length)
                ids, number, at, data = c.ids, c.number, c.at, c.data
                own, last = at[:-1] + c.low, c.high == np.diff(at)
                places = Segments(c, flags, buckets, length)
                gone = removed_mask(ids, at, len(data), places.number, places.first, [unpack(v["blob"], np.uint32, np.int64, np.uint8) for v in found or []], length)
                size = c.high - c.low
                del c, places
                alone = (number == 0) & last
                if not alone.all():  # only the bytes that pieces own
                    data, gone = gathered(data, own, size), gathered(gone, own, size)
                    at = np.concatenate(([0], np.cumsum(size)))
                lead = (data & 0xC0) != 0x80
                letter = np.cumsum(lead) - 1
                whole = gone.copy()
                if len(data):
                    whole = np.logical_and.reduceat(gone, np.flatnonzero(lead))[letter]
                begin = gone.copy()
                begin[1:] &= ~gone[:-1]
                some = np.diff(at) > 0
                begin[at[:-1][some]] = gone[at[:-1][some]]
                opens, closes = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
                opens[some], closes[some] = gone[at[:-1][some]], gone[at[1:][some] - 1]
                total = lambda x: np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[at]
                columns = [pa.array(ids), pa.array(np.diff(at)), pa.array(np.diff(total(gone))), pa.array(np.diff(total(begin)))]
                for mask, kind in ((~gone, pa.large_binary()), (~whole, pa.large_string())):
                    left = data[mask]
                    columns.append(pa.Array.from_buffers(kind, len(ids), [None, pa.py_buffer(total(mask).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(left))]))
                columns[4], columns[5] = columns[4].cast(pa.binary()), columns[5].cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(number), pa.array(alone), pa.array(opens), pa.array(closes)], names=[*WHOLE, "piece", "alone", "opens", "closes"])
        release()

    joined = with_flags(staged, repeated).join(verdicts, "chunk", "left").select("texts", "flags", "verdicts")
    out = joined.mapInArrow(run, PIECES)
    if longest <= chunk_bytes:
        return out.select(WHOLE)
    parts_ = out.where("not alone").groupBy("doc_id").applyInArrow(put_together, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, text string")
    return out.where("alone").select(WHOLE).unionByName(parts_)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# Every string of 50 bytes by its place: right, but far too large for more than small tables.
SQL = """
WITH d AS (SELECT doc_id::BIGINT AS doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, p, b[p + 1 : p + 50] AS w FROM d, unnest(range(0, octet_length(b) - 49)) t(p)),
f AS (SELECT w, min(doc_id) AS first FROM s GROUP BY w HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, p FROM s JOIN f USING (w) WHERE first < doc_id),
marked AS (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 50, true) AS new FROM hit),
numbered AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM marked),
runs AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS e FROM numbered GROUP BY doc_id, span),
gaps AS (SELECT doc_id, span, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY span), 0) AS left_ FROM runs),
cut AS (
  SELECT g.doc_id, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(CASE WHEN a > left_ THEN hex(b[left_ + 1 : a]) ELSE '' END, '' ORDER BY span) AS head, max(e) AS e
  FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id
)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || CASE WHEN octet_length(b) > coalesce(e, 0) THEN hex(b[coalesce(e, 0) + 1 : octet_length(b)]) ELSE '' END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
