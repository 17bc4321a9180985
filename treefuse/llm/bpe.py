"""Byte-pair encoding by forced boundaries.

A pair of neighbouring bytes that stands inside no vocabulary token can't be joined by any merge, so the
tokens of a text are cut between them for certain. Texts are cut at all such places, each distinct
fragment is encoded once, and the fragments' ids are concatenated. A cut is left out where the vocabulary's
word splitting could look across it: next to an apostrophe, after white space and inside a character.

Rows are encoded where they are (no shuffle). A worker process reads a vocabulary once, whatever number of
tasks it runs, and one encoder remembers fragments up to ``memory`` bytes, its dictionary included.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treefuse.llm.textarrays import SPACES, parts


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves,
    the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level vocabulary file, its tokens' bytes, and which byte pairs may not be cut."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        letter, added = byte_letters(), self.tokenizer.get_added_tokens_decoder()
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.bytes[i] = added[i].content.encode() if i in added else bytes(letter[c] for c in token)
        joined = np.zeros((256, 256), bool)
        for b in self.bytes:
            a = np.frombuffer(b, np.uint8)
            joined[a[:-1], a[1:]] = True
        joined[:, 0x80:0xC0] = True  # inside a character
        joined[SPACES] = joined[0x1C:0x20] = True
        joined[0x27] = joined[:, 0x27] = True
        self.free = (~joined).ravel()
        # White space beyond ASCII, by its last two bytes.
        self.wide_space = np.zeros((256, 256), bool)
        for c in (chr(i) for i in range(0x80, 0x3001)):  # no white space stands beyond U+3000
            if c.isspace():
                self.wide_space[tuple(c.encode()[-2:])] = True
        self.wide_space = self.wide_space.ravel()

    def cuts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where fragments begin, rows' starts included, and the end of the data."""
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            pair = (data[:-1].astype(np.uint16) << 8) | data[1:]
            cut[1:-1] = self.free[pair]
            cut[2:-1] &= ~self.wide_space[pair[:-1]]
        cut[at] = cut[0] = cut[-1] = True
        return np.flatnonzero(cut)


@lru_cache(2)
def read(path: str) -> Vocabulary:
    return Vocabulary(path)


def vocabulary(path: str | Callable[[], str]) -> Vocabulary:
    """The process's own copy. A function is asked for the path where the task runs."""
    return read(path() if callable(path) else path)


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    ENTRY = 220  # bytes of a dictionary entry with its key's and numbers' objects

    def __init__(self, vocabulary: Vocabulary, memory: int):
        self.v, self.memory = vocabulary, memory
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.ids, self.begin = [np.zeros(0, np.int32)], [0]

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids in one array, and at which id each row begins (one more than rows)."""
        cuts = self.v.cuts(data, at)
        raw, bounds = data.tobytes(), cuts.tolist()
        found = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        if self.held > self.memory:
            self.forget()
        known = self.known
        if new := list({f for f in found if f not in known}):
            ids = [e.ids for e in self.v.tokenizer.encode_batch_fast([f.decode() for f in new], add_special_tokens=False)]
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.ids.append(np.fromiter((i for x in ids for i in x), np.int32))
            self.begin.extend((self.begin[-1] + np.cumsum([len(x) for x in ids])).tolist())
            self.held += sum(map(len, new)) + 4 * len(self.ids[-1]) + self.ENTRY * len(new)
        if len(self.ids) > 1:
            self.ids = [np.concatenate(self.ids)]
        begin = np.asarray(self.begin, np.int64)
        which = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        lens = begin[which + 1] - begin[which]
        ends = np.cumsum(lens)
        place = np.repeat(begin[which] - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.ids[0][place], np.concatenate(([0], ends))[np.searchsorted(cuts, at)]


def encode(docs: DataFrame, path: str | Callable[[], str], keep: list[str], text: str = "text", memory: int = 48 << 20, decoded: bool = False) -> DataFrame:
    """The kept columns and ``ids`` (array of int); with ``decoded`` also the ids' text.

    As the tokenizer of the file encodes a whole text, special tokens not added (their strings in a text
    are recognised, as there). Null and empty texts have no ids. Repeated rows stay; an empty table gives
    none; other columns are dropped unless kept, and a kept one may not be named ids or decoded.
    """
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)] + [T.StructField("decoded", T.StringType(), False)] * decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path), memory)
        for rows, data, at in parts(batches, "__text", 1 << 18):
            ids, begin = encoder.encode(data, at)
            out = [rows.column(c) for c in keep] + [pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))]
            if decoded:
                out.append(pa.array(decode_rows(encoder.v.bytes, ids, begin), pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=[*keep, "ids", *["decoded"] * decoded])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def decode_rows(table: list[bytes], ids: np.ndarray, begin: np.ndarray) -> list[str]:
    flat, ends = ids.tolist(), begin.tolist()
    return [b"".join(map(table.__getitem__, flat[a:b])).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def decode(tokens: DataFrame, path: str | Callable[[], str], keep: list[str], ids: str = "ids") -> DataFrame:
    """The kept columns and ``decoded``: the text of each row's ids, special tokens included. Null: empty."""
    schema = T.StructType([tokens.schema[c] for c in keep] + [T.StructField("decoded", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(path).bytes
        for batch in batches:
            lists = batch.column("__ids")
            begin = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(decode_rows(table, flat, begin), pa.string())], names=[*keep, "decoded"])

    return tokens.select(*keep, F.col(ids).alias("__ids")).mapInArrow(run, schema)


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    return encoded.select(
        "doc_id", *more, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(encode(docs, public_vocabulary, ["doc_id"], decoded=True))
