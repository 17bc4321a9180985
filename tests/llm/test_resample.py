import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.fixtures import EXTRA, EXTRA_ROW, documents, texts, words
from treefuse.llm import resample


def features(text, buckets=10_000):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + m]).encode()) % buckets for m in (1, 2, 3) for i in range(len(w) - m + 1)]


def brute(rows, target, percent=5, least=20):
    s, t = Counter(b for _, x in rows for b in features(x)), Counter(b for x in target for b in features(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    out, live = [], []
    for doc_id, text in rows:
        f = features(text)
        weight, score = sum(gain[b] for b in f), None
        if doc_id is not None:
            h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(words(text)) >= least:
                live.append((-score, doc_id, len(f), len(out)))
        out.append([doc_id, len(f), weight, score, None])
    for rank, (*_, i) in enumerate(sorted(live)[: percent * len(live) // 100], 1):
        out[i][4] = rank
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("percent", [0, 5, 50, 100])
def test_draw_equals_brute_force(spark, percent):
    rows = texts() + texts()[5:7] + [(None, texts()[5][1]), (None, None)] + [(200 + i, f"common words {i % 3} " * 9) for i in range(60)]
    docs = spark.createDataFrame([(*r, *EXTRA_ROW) for r in rows], "doc_id long, text string" + EXTRA).repartition(3)
    target = [texts()[5][1], "common words 2 and others", None, ""]
    items = spark.createDataFrame([(1, t, 2) for t in target], "item_id long, text string, n long")
    got = resample.resample(docs, items, percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, target, percent)


def test_no_documents_and_no_target(spark):
    none = documents(spark).where("doc_id < 0")
    assert resample.resample(none, documents(spark)).count() == 0
    rows = texts()
    assert sorted(map(tuple, resample.resample(documents(spark, repeat=False), none).collect()), key=repr) == brute(rows, [])


def test_cutoff_with_many_ties(spark):
    rows = [(v, i, 1) for i in range(4000) for v in [0 if i % 3 else i % 50]]
    df = spark.createDataFrame(rows, "low long, doc_id long, n_features long").repartition(5)
    want = sorted(rows)
    for k in (1, 17, 2000, 2700, 3999, 4000):
        assert resample.cutoff(df, k, accuracy=50) == want[k - 1]


def test_crc_of_runs_equals_the_library():
    rows = ["", "one", "Two words", "é" * 100 + " " + "y" * 5000 + " zz " + "x" * 64 + " " + "q" * 65, "Hello, World! it's 123 foo_bar — déjà", " ".join("abcde"[i % 5] * (i % 130) for i in range(400))]
    raw = [r.encode() for r in rows]
    runs, first = resample.run_buckets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 3, 10_000)
    got = {}
    for begin, bucket in runs:
        for r, b in zip((np.searchsorted(first, begin, "right") - 1).tolist(), bucket.tolist(), strict=True):
            got.setdefault(r, []).append(b)
    assert [got.get(i, []) for i in range(len(rows))] == [features(r) for r in rows]
