"""Alignment of two tokenizers' tokens over the same bytes.

A byte-level vocabulary (A) and a piece vocabulary with byte fallback (B) encode each text; where tokens of both
end at one byte, the text can be cut, and what lies between two cuts is a group.

Cuts are found by divide and conquer on the ends of A's tokens: near the middle of an interval, going outwards,
the first end is taken that bisecting B's ends finds there too, and both sides are searched on. Ends that were
tried in vain lie beside the new cut and need no second try, so each is tried once; an interval without any
common end is a leaf group. All intervals of many fragments go through a round together, as arrays.

Texts are cut into fragments that begin at a space after something that isn't white space: neither vocabulary
can join bytes across such a place, so fragments end together in A and B, and a text's groups are its fragments' in a
row. Each distinct fragment is encoded and cut into groups once; its groups, spelt out, and its links are remembered
up to a number of bytes. A worker process reads its vocabularies once.

Corpus-wide counts of linked id pairs come from a group-by. The most frequent pairs, a fixed number, are looked up
in an array that goes to all tasks; the others, each rare, are joined by a shuffle, so no key is hot in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treefuse.llm.bpe import Vocabulary, public_vocabulary
from treefuse.llm.textarrays import parts
from treefuse.shared import cut

SPACE_MARK = "▁"
B_BITS = 20  # an id pair is one number: A's id above B's, and no vocabulary has so many ids


class Pieces:
    """A piece vocabulary, its pieces' bytes, and after which bytes a piece may go on with a space."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(names)]
        self.lone_space = self.model.piece_to_id(SPACE_MARK)
        self.into_space = np.zeros(256, bool)
        for p in self.bytes:
            a = np.frombuffer(p, np.uint8)
            self.into_space[a[:-1][a[1:] == 0x20]] = True

    def encode(self, fragments: list[str]) -> list[list[int]]:
        """Ids of fragments that begin with a space, which the model adds itself."""
        found = self.model.encode([f[1:] for f in fragments], num_threads=1)
        return [ids if len(f) > 1 else [self.lone_space] for f, ids in zip(fragments, found, strict=True)]


@lru_cache(2)
def vocabularies(a: str, b: str) -> tuple[Vocabulary, Pieces]:
    """The process's own pair; A's special tokens are plain text."""
    left, right = Vocabulary(a), Pieces(b)
    left.tokenizer.encode_special_tokens = True
    return left, right


def public_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Positions in ends_a, in order, of the ends that ends_b has too. ``begin``: where each row's tokens begin
    (one more than rows); ends ascend over all rows, and a row's last end is common."""
    some = begin[1:] > begin[:-1]
    lo, hi = begin[:-1][some], begin[1:][some] - 1  # positions lo to hi - 1 are not decided
    found = [hi]
    mid, tried = (lo + hi) // 2, np.zeros(len(lo), np.int64)
    while len(lo):
        go = tried < hi - lo  # the others are leaves
        lo, hi, mid, tried = lo[go], hi[go], mid[go], tried[go]
        far, left = (tried + 1) // 2, tried % 2 == 1
        p = np.where(left, mid - far, mid + far)
        end = ends_a[p]
        hit = ends_b[np.searchsorted(ends_b, end)] == end
        found.append(p[hit])
        # Beside the cut lie the ends tried before: left of a cut on the right, right of a cut on the left.
        l_hi = np.where(left, p, mid - far)[hit]
        r_lo = np.where(left, mid + far, p + 1)[hit]
        miss = ~hit
        new_lo, new_hi = np.concatenate((lo[hit], r_lo)), np.concatenate((l_hi, hi[hit]))
        lo, hi = np.concatenate((lo[miss], new_lo)), np.concatenate((hi[miss], new_hi))
        mid = np.concatenate((mid[miss], (new_lo + new_hi) // 2))
        tried = np.concatenate((tried[miss] + 1, np.zeros(len(new_lo), np.int64)))
    return np.sort(np.concatenate(found))


def token_ends(ids: np.ndarray, begin: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where each token ends in the run, its row's bytes beginning at ``at``."""
    ends = np.cumsum(lengths[ids])
    before = np.concatenate(([0], ends))[begin[:-1]]
    return ends + np.repeat(at[:-1] - before, np.diff(begin))


def take_rows(values: np.ndarray, begin: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the values of rows that are not kept."""
    n = np.where(keep, np.diff(begin), 0)
    return values[np.repeat(keep, np.diff(begin))], np.concatenate(([0], np.cumsum(n)))


def spell_groups(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, words: list[bytes], shift: int) -> list[bytes]:
    """`a1,a2|b1;...` as pieces in order, a separator behind each: ``words`` holds id, then `,`, for A and B, and id
    with `|` or `;` for a group's last."""
    end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    end_a[last_a], end_b[last_b] = 1, 1
    group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + np.concatenate(([0], last_b + 1))[group_a]] = a + end_a * shift
    out[np.arange(len(b)) + last_a[group_b] + 1] = b + 2 * shift + end_b * shift
    return [words[i] for i in out.tolist()]


class Growing:
    """Numbers in one array that is appended to in place."""

    def __init__(self, kind: type):
        self.room, self.n = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.room):
            self.room = np.concatenate((self.room[: self.n], np.zeros(max(end, 2 * len(self.room)) - self.n, self.room.dtype)))
        self.room[self.n : end] = values
        self.n = end

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.n]


def running(counts: np.ndarray) -> np.ndarray:
    """Sums of what stands before each, and of all."""
    return np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for, and lists those."""

    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class PairEncoder:
    ENTRY = 280  # bytes of a dictionary entry with its key's, number's and spelling's objects
    JOINED = 256  # fragments that A encodes as one text

    def __init__(self, a: Vocabulary, b: Pieces, memory: int):
        self.a, self.b, self.memory = a, b, memory
        self.len_a, self.len_b = (np.array([len(x) for x in v.bytes], np.int64) for v in (a, b))
        self.shift = max(len(self.len_a), len(self.len_b))
        self.words = [b"%d%b" % (i, mark) for mark in (b",", b"|", b",", b";") for i in range(self.shift)]
        self.forget()

    def forget(self) -> None:
        self.known, self.spelt, self.held = Numbers(), [], 0
        self.same, self.n_a, self.n_b = Growing(bool), Growing(np.int32), Growing(np.int32)
        self.pairs, self.begin = Growing(np.int64), Growing(np.int64)  # a fragment's links, and where they begin
        self.begin.add(np.zeros(1, np.int64))

    def fragments(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where fragments begin, and the end of the data; each begins with a space, as each row does."""
        row = np.zeros(len(data) + 1, bool)
        row[at] = True
        cuts = self.a.cuts(data, at)
        inner = cuts[1:-1]
        return np.concatenate((cuts[:1], inner[row[inner] | ((data[inner] == 0x20) & ~self.b.into_space[data[inner - 1]])], cuts[-1:]))

    def encode_a(self, new: list[bytes], texts: list[str], data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A's ids of the fragments, where each one's begin, and whether they spell it. Where A can't join bytes across
        fragments' borders, several are encoded as one text."""
        free = np.zeros(len(data) + 1, bool)
        free[self.a.cuts(data, at[[0, -1]])] = True
        ends = np.append(np.flatnonzero(~free[at[1:-1]] | (np.arange(1, len(new)) % self.JOINED == 0)) + 1, len(new)).tolist()
        encode = lambda x: [e.ids for e in self.a.tokenizer.encode_batch_fast(x, add_special_tokens=False)]
        ids = np.concatenate([np.array(x, np.int64) for x in encode(["".join(texts[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)])])
        token = running(self.len_a[ids])
        begin = np.searchsorted(token, at)
        if b"".join(map(self.a.bytes.__getitem__, ids.tolist())) == data.tobytes() and (token[begin] == at).all():
            return ids, begin, np.ones(len(new), bool)
        each = encode(texts)
        same = [b"".join(map(self.a.bytes.__getitem__, x)) == f for x, f in zip(each, new, strict=True)]
        return np.array([i for x in each for i in x], np.int64), running([len(x) for x in each]), np.array(same)

    def encode_b(self, new: list[bytes], texts: list[str], data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        each = self.b.encode(texts)
        flat = list(chain.from_iterable(each))
        ids, begin = np.array(flat, np.int64), running(np.fromiter(map(len, each), np.int64, len(each)))
        if b"".join(map(self.b.bytes.__getitem__, flat)) == data.tobytes() and (running(self.len_b[ids])[begin] == at).all():
            return ids, begin, np.ones(len(new), bool)
        return ids, begin, np.array([b"".join(map(self.b.bytes.__getitem__, x)) == f for x, f in zip(each, new, strict=True)])

    def learn(self, new: list[bytes]) -> None:
        """Encodes fragments and cuts them into groups."""
        data, at = np.frombuffer(b"".join(new), np.uint8), running(np.fromiter(map(len, new), np.int64, len(new)))
        texts = [f.decode() for f in new]
        (ia, begin_a, same), (ib, begin_b, same_b) = self.encode_a(new, texts, data, at), self.encode_b(new, texts, data, at)
        same = same & same_b
        ends_a, ends_b = token_ends(ia, begin_a, self.len_a, at), token_ends(ib, begin_b, self.len_b, at)
        if not same.all():
            (ends_a, _), (ends_b, _) = take_rows(ends_a, begin_a, same), take_rows(ends_b, begin_b, same)
            (ia, begin_a), (ib, begin_b) = take_rows(ia, begin_a, same), take_rows(ib, begin_b, same)
        last_a = shared_cuts(ends_a, ends_b, begin_a)
        last_b = np.searchsorted(ends_b, ends_a[last_a])
        words, both = spell_groups(ia, ib, last_a, last_b, self.words, self.shift), (begin_a + begin_b).tolist()
        spelt = [b"".join(words[i:j]) for i, j in zip(both[:-1], both[1:], strict=True)]
        self.spelt += spelt
        self.same.add(same)
        self.n_a.add(np.diff(begin_a))
        self.n_b.add(np.diff(begin_b))
        self.begin.add(self.pairs.n + np.searchsorted(last_a, begin_a[1:]))
        self.pairs.add((ia[last_a] << B_BITS) | ib[last_b])
        self.held += len(data) + sum(map(len, spelt)) + 8 * len(last_a) + self.ENTRY * len(new)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """For the rows of a run, which begin with a space: how many tokens A and B have, their groups' digest, all
        links, and where each row's begin. Rows of one byte or that either side doesn't spell have none."""
        cuts = self.fragments(data, at)
        raw, bounds = data.tobytes(), cuts.tolist()
        if self.held > self.memory:
            self.forget()
        found = map(raw.__getitem__, map(slice, bounds[:-1], bounds[1:]))
        which = np.fromiter(map(self.known.__getitem__, found), np.int64, len(bounds) - 1)
        if self.known.new:
            self.learn(self.known.new)
            self.known.new = []
        row = np.searchsorted(cuts, at)
        total = lambda v: np.diff(running(v.values[which])[row])
        same = (total(self.same) == np.diff(row)) & (np.diff(at) > 1)
        begin = self.begin.values[which]
        lens = self.begin.values[which + 1] - begin
        ends = running(lens)
        pairs, of = take_rows(self.pairs.values[np.repeat(begin - ends[:-1], lens) + np.arange(ends[-1])], ends[row], same)
        spelt, of_row = [self.spelt[i] for i in which.tolist()], row.tolist()
        shas = [hashlib.sha256(b"".join(spelt[i:j])[:-1]).hexdigest() if ok else "" for i, j, ok in zip(of_row[:-1], of_row[1:], same.tolist(), strict=True)]
        return total(self.n_a) * same, total(self.n_b) * same, shas, pairs, of


def align(docs: DataFrame, a: str | Callable[[], str], b: str | Callable[[], str], text: str = "text", memory: int = 128 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, pairs, times: each row's tokens, its groups, and its distinct links
    (A's id * 2^20 + B's id) with how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = vocabularies(a() if callable(a) else a, b() if callable(b) else b)
        encoder = PairEncoder(left, right, memory)
        for rows, data, at in parts(batches, "__text", 1 << 18):
            n_a, n_b, shas, pair, group = encoder.encode(data, at)
            # A run has at most 2^18 rows, of a byte at least: row and pair are one number.
            key = np.sort((np.repeat(np.arange(len(shas)), np.diff(group)) << 2 * B_BITS) | pair)
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(key)]
            times, key = np.diff(np.append(first, len(key))), key[first]
            begin = pa.array(np.searchsorted(key >> 2 * B_BITS, np.arange(len(shas) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(begin, pa.array(v, pa.int64())) for v in (key & ((1 << 2 * B_BITS) - 1), times)]
            counts = [pa.array(v, pa.int64()) for v in (n_a, n_b, np.diff(group))]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *counts, pa.array(shas, pa.string()), *lists], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    spaced = docs.select("doc_id", F.concat(F.lit(" "), F.coalesce(text, F.lit(""))).alias("__text"))
    return spaced.mapInArrow(run, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n, best: how many links hold each id pair, and whether that is the most of any pair with its B id."""
    counts = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("l")).groupBy(F.col("l.pairs").alias("pair")).agg(F.sum("l.times").alias("n"))
    counts = cut(counts.withColumn("b", F.col("pair").bitwiseAND((1 << B_BITS) - 1)))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # as many rows as B has ids
    return counts.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def tally(aligned: DataFrame, counts: DataFrame, frequent: int) -> DataFrame:
    """aligned(row, pairs, times, ...) -> the same rows with n_best and count_sum."""
    top = counts.orderBy(F.col("n").desc(), "pair").limit(frequent).toArrow().sort_by("pair")  # a fixed number of rows
    known = aligned.sparkSession.sparkContext.broadcast((top.column("pair").to_numpy(), top.column("n").to_numpy(), top.column("best").to_numpy().astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        for batch in batches:
            lists = batch.column("pairs")
            begin = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            mine, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            at = np.minimum(np.searchsorted(pair, mine), max(len(pair) - 1, 0))
            there = pair[at] == mine if len(pair) else np.zeros(len(mine), bool)
            at = at[there]
            total = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[begin])
            own, sums = np.zeros(len(mine), np.int64), np.zeros(len(mine), np.int64)
            own[there], sums[there] = times[there] * best[at], times[there] * n[at]
            rest = np.concatenate(([0], np.cumsum(~there)))[begin]
            lists = [pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(v[~there], pa.int64())) for v in (mine, times)]
            keep = [c for c in batch.schema.names if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(total(own), pa.int64()), pa.array(total(sums), pa.int64()), *lists], names=[*keep, "n_best", "count_sum", "rest", "rest_times"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name not in ("pairs", "times")]
    scored = cut(aligned.mapInArrow(run, ", ".join([*fields, "n_best bigint", "count_sum bigint", "rest array<bigint>", "rest_times array<bigint>"])))
    rare = scored.where(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("l")).select("row", F.col("l.rest").alias("pair"), F.col("l.rest_times").alias("k"))
    found = rare.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("more_best"), F.sum(F.col("k") * F.col("n")).alias("more_sum"))
    add = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).cast("bigint").alias(c)
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    return scored.drop("rest", "rest_times").join(found, "row", "left").select(*kept, add("n_best", "more_best"), add("count_sum", "more_sum"))


def alignment(docs: DataFrame, a: str | Callable[[], str] = public_vocabulary, b: str | Callable[[], str] = public_pieces, frequent: int = 1 << 18) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Space and text are encoded by A, the text by B, which adds the space; special tokens' strings are plain text. A
    link is a pair of tokens that end together: one for each group. n_best of a row's links belong to a pair that no
    other pair with its B id exceeds in the corpus; count_sum adds up all links' counts. Null and empty texts, and
    texts that either side doesn't spell byte by byte, have no tokens: zeros and ''. Repeated rows each count and
    come back each; a null doc_id is kept as it is; an empty table gives no rows; other columns are ignored.
    """
    aligned = cut(align(docs, a, b).withColumn("row", F.monotonically_increasing_id()))
    counts = cut(pair_counts(aligned))
    out = tally(aligned, counts, frequent)
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


def op12_token_align(spark, sf_dir: str) -> DataFrame:
    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
