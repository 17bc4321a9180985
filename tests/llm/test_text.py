import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import EXTRA, EXTRA_ROW, documents, texts, words
from treefuse.llm import bpe, chat_format, decontaminate, licenses, nearest, quality, url_filter, warc
from treefuse.llm.shared import shared_dir

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    got = bpe.encode(documents(spark), path, ["doc_id"], decoded=True).collect()
    want = dict(texts())
    assert len(got) == len(want) + 2
    for r in got:
        text = want[r["doc_id"]] or ""
        assert r["ids"] == plain.encode(text, add_special_tokens=False).ids
        assert r["decoded"] == text == plain.decode(r["ids"], skip_special_tokens=False)
    back = bpe.decode(bpe.encode(documents(spark), path, ["doc_id"]), path, ["doc_id"]).collect()
    assert all(r["decoded"] == (want[r["doc_id"]] or "") for r in back)
    assert bpe.encode(documents(spark).where("doc_id < 0"), path, ["doc_id"]).count() == 0


def brute_contamination(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[j : j + size]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for j in range(len(w)):
            for n in {len(x) for x in windows}:
                if tuple(w[j : j + n]) in windows and j + n <= len(w):
                    hit |= set(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        out[d] = (len(w), len(hit), sorted(str(i) for i in found if i is not None))
    return out


ITEMS = [(1, None), (2, ""), (3, "two WORDS"), (4, " ".join(texts()[5][1].split()[:14])), (4, " ".join(texts()[5][1].split()[:14])), (5, " ".join(texts()[5][1].split()[20:30])), (60, "absent words that nobody wrote")]


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_contamination_equals_brute_force(spark, broadcast):
    items = spark.createDataFrame([(*r, 1, "z") for r in ITEMS], "item_id long, text string, n long, win string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate.contamination(documents(spark), items, broadcast_bytes=broadcast).collect()}
    assert got == brute_contamination(texts(), ITEMS)


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_items_without_ids_hit_and_rows_of_one_id_stay_apart(spark, broadcast):
    base = texts()[5][1]
    items = [(None, "two words"), (7, " ".join(base.split()[:12]))]
    docs = [(1, base), (1, "two words and no more"), (1, base), (2, None), (None, "Two WORDS")]
    got = decontaminate.contamination(documents(spark, docs, repeat=False), spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=broadcast)
    want = [(d, *brute_contamination([(d, t)], items)[d]) for d, t in (docs[i] for i in (0, 1, 3, 4))]
    assert sorted(map(str, ((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got.collect()))) == sorted(map(str, want))


def test_many_documents_past_the_broadcast_limit(spark):
    """A word that every document has, and a row for every document, whether or not it meets a window."""
    items = [(i, f"the common word {i} and nine more that follow it here") for i in range(40)] + [(99, "the")]
    docs = [(i, f"The common word {i % 80} and nine more that follow it here, the end" if i % 3 else f"the {i}") for i in range(2000)]
    got = decontaminate.contamination(documents(spark, docs, repeat=False), spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in got.collect()} == brute_contamination(docs, items)
    assert "Union" in plan  # marks come beside the join


def test_items_may_have_string_ids(spark):
    items = spark.createDataFrame([(f"it-{i}", t) for i, t in ITEMS], "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate.contamination(documents(spark), items).collect()}
    assert got == brute_contamination(texts(), [(f"it-{i}", t) for i, t in ITEMS])


def test_contamination_without_items_or_documents(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(documents(spark), items.where("item_id < 0")).collect()
    assert len(got) == len(texts()) and not any(r["n_hit"] for r in got)
    assert decontaminate.contamination(documents(spark).where("doc_id < 0"), items).count() == 0


def test_license_places_equal_brute_force(spark):
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark)).collect()}
    assert len(got) == len(texts())
    for i, t in texts():
        w = words(t)
        places = [(j, label) for phrase, label in licenses.PHRASES for j in range(len(w)) if w[j : j + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(p for p, _ in places), max(p for p, _ in places)) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1
    assert licenses.scan(documents(spark).where("doc_id < 0")).count() == 0


def test_license_templates_with_gaps(spark):
    text = "xx Redistribution and use in source and binary forms, with or really without modification, are permitted provided that the following conditions are met yy"
    rows = licenses.scan(documents(spark, [(1, text), (2, "the software is in the forms of source")], repeat=False)).collect()
    assert {r["doc_id"]: r["labels"] for r in rows} == {1: "bsd", 2: ""}


def test_license_votes_of_repeated_rows_count_once(spark):
    rows = [(1, "a general public house"), (1, "a general public house"), (2, "mit license mit license"), (2, "mit license mit license")]
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, rows, repeat=False)).collect()}
    assert (got[1]["n_base"], got[1]["base_labels"], got[1]["labels"], got[1]["score"]) == (0, "", "", 0.0)
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["base_labels"]) == (2, 0, 2, "mit")


WORDINGS = [
    ("the game was released under the title of Sonic", ""),
    ("released under the apache license", "apache"),
    ("this work is licensed under the mit license", "mit"),
    ("this program is licensed under the GNU General Public License v3", "gpl"),
    ("under the terms of the GNU Lesser General Public License", "gpl,lgpl"),
    ("you may use it under the GNU Affero General Public License", "agpl,gpl"),
    ("this work is licensed under a creative commons attribution license", "cc-by"),
    ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("the license of this software was released to the public in general", ""),
    ("Licensed under the License, Version 2.0; you may not use this file except in compliance with the rules of the house", ""),
    ("This Source Code Form is subject to the terms of the Other Public License, v. 2.0. If a copy of it was not distributed with this file, You can obtain one elsewhere", ""),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the General Licence as published by the Free Software Foundation", ""),
]


def test_license_wordings(spark):
    rows = licenses.scan(documents(spark, [(i, f"some words before {t} and some behind") for i, (t, _) in enumerate(WORDINGS)], repeat=False)).collect()
    assert {r["doc_id"]: r["labels"] for r in rows} == {i: want for i, (_, want) in enumerate(WORDINGS)}


def test_whole_licenses_are_found_in_prose(spark):
    prose = " of the software in the and or use to be with all " * 200
    for text, label in licenses.TEMPLATES:
        row = licenses.scan(documents(spark, [(1, prose + "\n# " + text.replace(" ", "\n # ") + "\n" + prose)], repeat=False)).first()
        assert label in row["labels"].split(","), (label, row["labels"])
        assert row["score"] == 1.0
    assert licenses.scan(documents(spark, [(1, prose)], repeat=False)).first()["labels"] == ""


def test_quality_learns_and_scores_everything(spark):
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice(["the", "and", "river", "house", "walks", "to"], int(rng.integers(5, 80)))) + "." for _ in range(150)]
    bad = [" ".join(w + "%%%" if i % 2 else w.upper() + "!!" for i, w in enumerate(g.split())) for g in good]
    model = quality.fit([t.encode() for t in good[:100] + bad[:100]], [1] * 100 + [0] * 100, epochs=10)
    rows = [(i, t) for i, t in enumerate(good[100:] + bad[100:])] + [(1000, None), (1001, ""), (1002, "x" * 200_000)]
    got = {r["doc_id"]: r["score"] for r in quality.score(documents(spark, rows, repeat=False), model, ["doc_id"], out="p").withColumnRenamed("p", "score").collect()}
    right = sum((got[i] >= 0.5) == (i < 50) for i in range(100))
    assert right >= 97 and got[1000] == got[1001] and all(0 <= s <= 1 for s in got.values())


def test_quality_gradients():
    rng = np.random.default_rng(1)
    texts_ = [bytes(rng.integers(97, 110, n).astype(np.uint8)) for n in (3, 200, 700)]
    data, at = np.frombuffer(b"".join(texts_), np.uint8), np.array([0, 3, 203, 903])
    y, weight = np.array([0.0, 1.0, 1.0]), np.array([1.0, 0.5, 2.0])
    m = quality.fit(texts_, [0, 1, 1], filters=4, epochs=1)
    g = quality.gradients(m, data, at, y, weight)

    def loss():
        p = quality.probabilities(m, data, at)
        return float((weight * -(y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / 3)

    for name in ("mean_weight", "max_weight"):
        before = getattr(m, name)[2]
        getattr(m, name)[2] = before + 1e-6
        high = loss()
        getattr(m, name)[2] = before - 1e-6
        low = loss()
        getattr(m, name)[2] = before
        assert abs((high - low) / 2e-6 - g[name][2]) < 1e-5


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(documents(spark), labels)
    assert {r["score"] for r in quality.score(documents(spark).drop("score"), model, ["doc_id"]).collect()} == {0.5}


def test_held_out_accuracy(spark, sf_dir):
    from treefuse.llm.queries import QUERIES

    got = QUERIES["op10_quality"](spark, sf_dir.replace("0.001", "0.01")).join(spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/labels.parquet"), "doc_id")
    rows = got.where("held_out").select("predicted", "quality", "doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.93


def pages(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA_ROW) for r in rows], "page_id long, url string, html string" + EXTRA)


URLS = [None, "", "no scheme", "http://net/", "https://a.b.net/x", "http://example.net/en/1", "http://WWW.Example.net/en/x?q#f", "http://example.net/EN/", "http://notexample.net/en/1", "ftp://example.com/de/", "http://x.org/fr/1", "http://org/fr/", "http://org", "http://a.org?x=/fr/", "http://é.net/é", "http://a..net/", "://net/", "http://x.org/fr", "HTTP://q.example.com/de/a/b"]


def test_url_rules_equal_brute_force(spark):
    rules = url_filter.RULES + [("org", "", "block"), ("x.org", "/fr/1", "block"), ("x.org", "/fr/1", "allow"), ("example.net", "/", "block")]
    rows = [(i, u, None) for i, u in enumerate(URLS * 2)]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.apply_rules(pages(spark, rows), table, rows_per_sweep=3).collect()}
    for i, u, _ in rows:
        rest = (u or "").partition("://")[2] if "://" in (u or "") else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert got[i] == (host, path, best[2] if best else None, best[3] if best else "allow"), u
    assert url_filter.apply_rules(pages(spark, rows).where("page_id < 0"), table).count() == 0
    assert {r["verdict"] for r in url_filter.apply_rules(pages(spark, rows), table.where("false")).collect()} == {"allow"}


def test_archives_round_trip_and_do_not_hang_on_partitions(spark):
    rows = [(i, f"http://h/{i}\nx", t) for i, t in texts()] + [(50, None, texts()[5][1]), (51, "u", None), (51, "u", None)]
    folders, digests = [], []
    for n in (1, 5):
        out = f"{shared_dir(spark)}/archive-{n}-{len(digests)}-{np.random.default_rng().integers(1 << 60)}"
        manifest = warc.write_archives(pages(spark, rows).repartition(n), out, shard_bytes=4000, roll_bytes=2000)
        digests.append(sorted((r["file"], r["sha256"]) for r in manifest.collect()))
        folders.append((out, manifest))
    assert digests[0] == digests[1] and len(digests[0]) > 5
    back = warc.read_archives(folders[1][1], folders[1][0]).collect()
    assert sorted((r["page_id"], r["url"]) for r in back) == sorted((i, warc.plain(u)) for i, u, _ in rows)
    assert sorted((r["record_type"], r["refers_to"] or 0) for r in back if r["page_id"] == 51) == [("response", 0), ("revisit", 51)]  # two rows, two records
    got = {r["page_id"]: r for r in sorted(back, key=lambda r: r["record_type"] == "response")}
    by = {}
    for i, _, t in rows:
        by.setdefault(t or "", set()).add(i)
    assert set(got) == {r[0] for r in rows}
    for i, _, t in rows:
        r, last = got[i], max(by[t or ""])
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == last else ("revisit", last))
        assert r["payload_bytes"] == len((t or "").encode()) and r["payload_digest"] == warc.sha1((t or "").encode())
        assert i != last or bytes(r["payload"]) == (t or "").encode()
    empty = f"{shared_dir(spark)}/archive-empty-{np.random.default_rng().integers(1 << 60)}"
    assert warc.read_archives(warc.write_archives(pages(spark, rows).where("page_id < 0"), empty), empty).count() == 0


def test_small_payloads_stay_responses(spark):
    out = f"{shared_dir(spark)}/archive-small-{np.random.default_rng().integers(1 << 60)}"
    rows = [(1, "a", "same"), (2, "b", "same"), (3, "c", "longer text"), (4, "d", "longer text")]
    got = {r["page_id"]: r["record_type"] for r in warc.read_archives(warc.write_archives(pages(spark, rows), out, min_revisit_bytes=5), out).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


TURNS = [(1, 0, "system", "be\\n nice <|x|> \\<|"), (1, 1, "user", None), (1, 2, "assistant", "ok <|im_end|>"), (1, 2, "assistant", "ok <|im_end|>"), (1, 3, None, "x"), (2, 0, "assistant", "y" * 9000), (2, 1, "role\nwith <|0 lines\\", "z"), (3, None, "user", "q"), (None, 1, "user", "lost"), (4, 5, "assistant", "")]
TURNS += [(5, i, "user" if i % 2 else "assistant", f"turn {i} " * (i % 40)) for i in range(3000)]


def test_chats_round_trip(spark):
    rows = spark.createDataFrame([(*r, "a", 1) for r in TURNS], "conv_id long, turn long, role string, text string, piece string, idx int")
    windows = chat_format.format_windows(rows, budget=300, history=60, block=7)
    got = {}
    for r in sorted(chat_format.read_windows(windows).collect(), key=lambda r: (r["conv_id"], r["window"])):
        turns, targets = got.setdefault(r["conv_id"], ([], []))
        turns += [(t["role"], t["text"]) for t in r["turns"]]
        targets += r["targets"]
    want = {}
    tokens = lambda t: (len(t or "") + 3) // 4 + 4
    for c, _, role, text in sorted((r for r in TURNS if r[0] is not None), key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2] or "", tokens(r[3]), r[3] or "")):
        turns, targets = want.setdefault(c, ([], []))
        turns.append((role or "", text or ""))
        if role == "assistant":
            targets.append(text or "")
    assert got == want
    spread = windows.where("conv_id = 5").collect()
    assert len(spread) > 50 and max(len(r["text"]) for r in spread) < 300 * 8
    assert sum(r["n_repeated"] for r in spread) > 0
    assert chat_format.format_windows(rows.where("conv_id < 0")).count() == 0


def plain_starts(turns, budget, history):
    """At which of a conversation's (role, text) turns windows start: one greedy pass."""
    tokens = lambda t: (len(t) + 3) // 4 + 4
    system = tokens(turns[0][1]) if turns[0][0] == "system" else 0
    body, used, starts = max(budget - history - system, 0), None, []
    for i, (_, text) in enumerate(turns):
        own = 0 if i == 0 and system else tokens(text)
        if used is None or used + own > body:
            starts.append(i)
            used = own
        else:
            used += own
    return starts


@pytest.mark.parametrize("apart", [1, 2000, 10**12])
def test_windows_do_not_depend_on_blocks_or_gaps(spark, apart):
    rng = np.random.default_rng(7)
    said = {c: [("system" if i == 0 and c == 2 else ("user", "assistant")[i % 2], "z" * int(rng.choice([3, 40, 300, 1500, 8000], p=[0.5, 0.3, 0.1, 0.05, 0.05]))) for i in range(n)] for c, n in ((1, 90), (2, 150), (3, 1), (4, 12))}
    rows = [(c, i * apart + (i * i if apart > 1 else 0), *t) for c, turns in said.items() for i, t in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = []
    for block in (4, 16, 1024):
        windows = chat_format.format_windows(table, 300, 60, block).collect()
        got.append(sorted((r["conv_id"], r["window"], r["text"], r["n_own"]) for r in windows))
    assert got[0] == got[1] == got[2]
    for c, turns in said.items():
        starts = plain_starts(turns, 300, 60)
        assert [r[3] for r in got[0] if r[0] == c] == np.diff([*starts, len(turns)]).tolist()


@pytest.mark.parametrize("seed", range(3))
def test_windows_keep_to_their_budget(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(c, i, "system" if i == 0 and c % 2 else ("user", "assistant")[i % 2], "z" * int(rng.choice([3, 40, 300, 700, 2600, 8000], p=[0.3, 0.3, 0.2, 0.1, 0.05, 0.05]))) for c in range(12) for i in range(60)]
    rows += [(100, 0, "user", "z" * 2600), (100, 1, "assistant", "z" * 8000), (101, 0, "system", "z" * 9000), (101, 1, "user", "z"), (101, 2, "assistant", "z")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tokens = lambda n: (n + 3) // 4 + 4
    seen = 0
    for r in chat_format.format_windows(table, budget=1024, history=256, block=32).collect():
        sizes = [tokens(len(x.partition("\n")[2].removesuffix("<|im_end|>\n"))) for x in r["text"].split("<|im_start|>")[1:]]
        if r["n_own"] > 1:
            assert sum(sizes) <= 1024, (r["conv_id"], r["window"], sizes)
        seen += r["n_repeated"] > 0
    assert seen > 20
    assert chat_format.format_windows(table, budget=1024).where("conv_id = 100").count() == 2


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 9)).astype(np.float32)
    x[600:] = x[0]  # many equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 9), (1002, [float("nan")] * 9), (1003, [1.0] * 8), (1004, [None] + [1.0] * 8), (5, x[5].tolist())]
    table = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "vec_id long, embedding array<float>, rep long, score double")
    got = {}
    for r in nearest.nearest(table, F.col("id") % 50 == 0, rerank=60).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 700, 50))
    right = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        want = [i for _, i in sorted((d[i], i) for i in range(700) if i != q)[:10]]
        right += len(set(want) & {v for _, v, _ in found})
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert all(abs(s - d[v]) < 1e-9 for _, v, s in found)
    assert right >= 0.9 * 10 * len(got)
    again = nearest.nearest(table, F.col("id") % 50 == 0, rerank=60, query_block=3, code_block=100, broadcast_bytes=500).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in again) == sorted((q, r, v) for q, x in got.items() for r, v, _ in x)
    mixed = [(i, [float(i), 1.0]) for i in range(4)] + [(i, [float(i), 1.0, 1.0]) for i in range(50, 53)]
    both = nearest.nearest(spark.createDataFrame(mixed, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).collect()
    assert {q: [r["vec_id"] for r in sorted(both, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 50)} == {0: [1, 2, 3], 50: [51, 52]}
    assert [v for _, v, _ in sorted(got[600])] == [0, *range(601, 610)]
    assert nearest.nearest(table.where("vec_id < 0"), F.col("id") % 50 == 0).count() == 0


@pytest.mark.parametrize("kind", ["dense clusters", "far from zero", "many scales", "many ties"])
def test_neighbours_of_odd_rows_equal_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    n, dims = 2400, 16
    if kind == "dense clusters":
        x = rng.normal(size=(4, dims))[np.arange(n) % 4] + 1e-4 * rng.normal(size=(n, dims))
    elif kind == "far from zero":
        x = 1000 + 0.1 * rng.normal(size=(n, dims))
    elif kind == "many scales":
        x = rng.normal(size=(n, dims)) * 10.0 ** rng.uniform(-4, 4, (n, 1))
    else:
        x = rng.integers(0, 2, (n, dims)) + np.eye(dims)[np.arange(n) % dims]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = nearest.nearest(table, F.col("id") % 100 == 0, rerank=50, code_block=500).collect()
    want = []
    for q in range(0, n, 100):
        total = np.zeros(n)
        for c in range(dims):
            total += (x[:, c] - x[q, c]) ** 2
        best = sorted((d, i) for i, d in enumerate(np.sqrt(total).tolist()) if i != q)[:10]
        want += [(q, rank, i, d) for rank, (d, i) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in got) == want


def test_digest_queries_have_the_promised_columns(spark, sf_dir):
    from treefuse.llm.queries import QUERIES

    assert QUERIES["op8_chat_format"](spark, sf_dir).columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    one = QUERIES["op5_bpe"](spark, sf_dir).orderBy("doc_id").first()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").first()["text"]
    assert one["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
