import hashlib
import random

import numpy as np
import pytest

from tests.llm.fixtures import documents, shingles, texts
from treefuse.llm import suffix_dedup
from treefuse.llm.components import components
from treefuse.llm.near_dedup import near_duplicates
from treefuse.llm.suffix_dedup import remove_repeats


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        mine = [b[j : j + length] for j in range(len(b) - length + 1)]
        gone = [False] * len(b)
        for j, s in enumerate(mine):
            if s in seen:
                gone[j : j + length] = [True] * length
        seen.update(mine)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize(("chunk", "crowd"), [(1 << 12, 1 << 17), (1 << 21, 1 << 17), (1 << 12, 0)])
def test_repeats_equal_brute_force(spark, chunk, crowd):
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(documents(spark), chunk_bytes=chunk, crowd=crowd).collect()}
    assert found == brute_repeats(texts(), 50)


def test_a_hot_phrase_in_many_surroundings(spark):
    rng, phrase = random.Random(4), "the very same twenty-odd bytes"
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    rows = [(i, noise(25) + phrase + noise(25)) for i in range(3000)]
    rows += [(3000 + i, rows[i * 7][1][3:-3] + noise(10)) for i in range(100)]
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(documents(spark, rows, repeat=False), chunk_bytes=1 << 14, crowd=500).collect()}
    assert found == brute_repeats(rows, 50)


def test_texts_beyond_a_chunk(spark):
    rng = random.Random(6)
    word = ["".join(rng.choice("aéîbc🙂") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    long = " ".join(rng.choice(word) for _ in range(30_000))
    rows = [(1, long[5000:5400]), (2, long), (3, long[100:60_000] + "x" + long[60_000:]), (4, long[70_000:]), (5, None), (6, "y" * 200_000)]
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(documents(spark, rows, repeat=False), chunk_bytes=1 << 14).collect()}
    assert found == brute_repeats(rows, 50)


def test_repeats_keep_characters_whole(spark):
    rows = [(1, "é" * 40), (2, "a" + "é" * 40 + "b"), (3, "x")]
    found = {r["doc_id"]: r["text"] for r in remove_repeats(documents(spark, rows, repeat=False)).collect()}
    assert found == {1: "é" * 40, 2: "ab", 3: "x"}


def test_repeats_of_nothing(spark):
    assert remove_repeats(documents(spark).where("doc_id < 0")).count() == 0
    only_null = remove_repeats(documents(spark).where("doc_id = 0")).collect()
    assert [(r["n_bytes"], r["text"]) for r in only_null] == [(0, "")]


@pytest.mark.parametrize("buffer", [1, 7, 1 << 18])
def test_columns_find_the_smallest_document(tmp_path, buffer):
    rng = np.random.default_rng(0)
    strings = ["".join(rng.choice(list("ab"), 20 + 50)) for _ in range(6)]
    left, size, doc, text = [], [], [], b""
    for d in range(40):
        s = strings[rng.integers(6)]
        a, b = int(rng.integers(0, 20)), int(rng.integers(0, 20))
        piece = s[a : len(s) - b]
        if len(piece) >= 50:
            left.append(30 - a)
            size.append(len(piece))
            doc.append(int(rng.integers(100)))
            text += piece.encode()
    left, size, doc = np.array(left), np.array(size), np.array(doc)
    files = suffix_dedup.Files(f"file://{tmp_path}")
    collection = suffix_dedup.Collection(files, left, size, doc.astype(np.int32), np.frombuffer(text, np.uint8), 50, buffer)
    collection.smallest_documents()
    got = collection.found(0, len(size)).T
    best, begin = {}, np.cumsum(size) - size
    for i in range(len(size)):
        for c in range(30 - left[i], 30 - left[i] + size[i] - 49):
            at = begin[i] + c - (30 - left[i])
            best[c, text[at : at + 50]] = min(best.get((c, text[at : at + 50]), 10**9), doc[i])
    for i in range(len(size)):
        for c in range(31):
            at = begin[i] + c - (30 - left[i])
            whole = 30 - left[i] <= c <= 30 - left[i] + size[i] - 50
            assert got[c, i] == (best[c, text[at : at + 50]] if whole else -1)


def brute_components(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "crowd"), [(4, 20_000), (5, 2)])
def test_near_duplicates_equal_brute_force(spark, k, crowd):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(documents(spark), k=k, crowd=crowd).collect()}
    assert found == brute_components(texts(), k, 80)


def crowd_of_copies(n: int = 400):
    """Copies of one text, most of them less similar to each other than 0.8, with few links among many."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        copy = list(base)
        for j in rng.sample(range(150), rng.randint(3, 5)):
            copy[j] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    return rows


def test_near_duplicates_find_far_links_in_a_crowd(spark):
    rows = crowd_of_copies()
    brute = brute_components(rows, 4, 80)
    assert 10 < len({c for _, c in brute.values()}) < len(rows) - 10
    for block in (4_000_000, 20_000):  # one block, and pairs of several
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(documents(spark, rows, repeat=False), k=4, block=block).collect()}
        assert found == brute


@pytest.mark.parametrize("crowd", [2, 20])
def test_near_duplicates_do_not_depend_on_the_crowd(spark, crowd):
    rows = crowd_of_copies()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(documents(spark, rows, repeat=False), k=4, crowd=crowd).collect()}
    assert found == brute_components(rows, 4, 80)


def test_near_duplicates_find_pairs_that_share_no_branch(spark):
    rows, rng = [], random.Random(2)
    for i in range(60):
        words = [f"p{i}w{j}" for j in range(60)]
        copy = [f"c{w}" if j in (8, 20, 33, 47) else w for j, w in enumerate(words)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    rng.shuffle(rows)
    docs = documents(spark, rows, repeat=False)
    one, all_ = ({r["doc_id"]: r["component_id"] for r in near_duplicates(docs, k=4, percent=50, crowd=c).collect()} for c in (1, 20_000))
    assert one == all_ and len(set(all_.values())) < 75


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(documents(spark).where("doc_id < 0")).count() == 0
    assert near_duplicates(documents(spark).where("doc_id < 3")).where("kept").count() == 3


def test_near_duplicates_lose_no_link_in_a_sample(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    brute = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
    assert found == {i: c for i, (_, c) in brute.items()}


def test_components_of_chain_star_and_loop(spark):
    edges = [(i, i + 1) for i in range(1, 20)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 21)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_digests_do_not_depend_on_partitions(spark):
    docs = documents(spark)
    a, b = ({r["doc_id"]: hashlib.sha256(bytes(r["kept"])).hexdigest() for r in remove_repeats(d).collect()} for d in (docs.repartition(1), docs.repartition(7)))
    assert a == b
