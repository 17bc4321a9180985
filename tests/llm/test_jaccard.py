import random

import numpy as np
import pytest

from tests.llm.fixtures import documents, shingles, texts
from treefuse.llm import jaccard_join


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and top(a) != top(b):
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (len(sets[i]), top(i)) for i in ids}


def edited(rng, words, share):
    out = list(words)
    for _ in range(round(share * len(words))):
        at, kind = rng.randrange(len(out)), rng.random()
        out[at : at + (kind < 0.7)] = [] if kind < 0.2 else [f"w{rng.randrange(10**6)}"]
    return out


def crowd(seed, groups=(40, 25), lone=20):
    """Groups of copies around the threshold, copies of copies, texts that share a passage, and short texts."""
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(4000)}"
    out, passage = [], [word() for _ in range(60)]
    for size in groups:
        base = [word() for _ in range(rng.randint(60, 220))]
        members = [base]
        for _ in range(size):
            members.append(edited(rng, rng.choice(members[-4:]), rng.choice((0.01, 0.02, 0.03, 0.05))))
        out += members
    out += [[word() for _ in range(rng.randint(1, 150))] + passage for _ in range(lone)]
    for n in range(1, 24):
        base = [word() for _ in range(n)]
        out += [base, [*base, word()], base[1:], base[:-1] + [word()]]
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize(("seed", "k", "percent", "rounds", "block"), [(1, 3, 90, 2, 2_000_000), (2, 3, 90, 0, 1500), (3, 4, 80, 1, 900), (4, 2, 60, 2, 5000)])
def test_components_equal_brute_force(spark, seed, k, percent, rounds, block):
    rows = texts() + [(100 + i, t) for i, t in crowd(seed)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(documents(spark, rows), k, percent, rounds, block).collect()}
    assert got == brute(rows, k, percent)


def test_no_documents(spark):
    assert jaccard_join.jaccard_components(documents(spark).where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_similar_sets_share_a_key(percent):
    rng = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        gone = int(rng.integers(0, n * (100 - percent) // 100 + 1))
        b = np.concatenate((a[gone:], rng.integers(0, 2**63, int(rng.integers(0, 1 + n * (100 - percent) // 100)), dtype=np.uint64)))
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        if 100 * common < percent * (len(a) + len(b) - common) or len(a) == len(b) == common:
            continue
        keys, at = jaccard_join.part_keys(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), percent)
        assert np.intersect1d(keys[: at[1]], keys[at[1] :]).size


@pytest.mark.parametrize("two", [False, True])
def test_a_cell_joins_all_that_its_pairs_join(two):
    for seed in range(6):
        rows = [(i, shingles(t, 3)) for i, t in crowd(seed, (30, 12), 8) if shingles(t, 3)]
        names = {s: j for j, s in enumerate(sorted({s for _, x in rows for s in x}))}
        rows.sort(key=lambda r: len(r[1]))
        rng = random.Random(seed)
        side = np.array([rng.randrange(2) if two else 0 for _ in rows])
        label = np.array([rng.randrange(len(rows)) for _ in rows])
        begin = np.concatenate(([0], np.cumsum([len(s) for _, s in rows])))
        links = jaccard_join.Cell(side, label, begin, np.array([names[s] for _, x in rows for s in sorted(x)]), 90).links()

        def classes(pairs, label=label):
            up = {x: x for x in label.tolist()}
            top = lambda i: i if up[i] == i else top(up[i])
            for a, b in pairs:
                a, b = top(label[a]), top(label[b])
                up[a] = b
            groups = {}
            for x in up:
                groups.setdefault(top(x), set()).add(x)
            return sorted(map(sorted, groups.values()))

        similar = []
        for j, (_, b) in enumerate(rows):
            for i, (_, a) in enumerate(rows[:j]):
                if (not two or side[i] != side[j]) and 100 * len(a & b) >= 90 * len(a | b):
                    similar.append((i, j))
        assert {*links} <= {*similar} and classes(links) == classes(similar)


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = rng.integers(0, 2**63, int(rng.integers(2, 400)), dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, int(rng.integers(1, 2 * len(pool))))) for _ in range(2))
        both = np.concatenate((a, b))
        words, at = jaccard_join.sketches(both, np.array([0, len(a), len(both)]))
        n, percent = np.array([len(a), len(b)]), 5
        order = np.argsort(n, kind="stable")
        kept = jaccard_join.possible(n[order], np.arange(2), np.zeros(2, int), np.concatenate([words[at[i] : at[i + 1]] for i in order]), np.concatenate(([0], np.cumsum(np.diff(at)[order]))), percent)
        common = len(np.intersect1d(a, b))
        if 100 * common >= percent * (len(a) + len(b) - common):
            assert kept.all()
