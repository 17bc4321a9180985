"""Each stage and the whole run against plain restatements, on awkward rows."""

import hashlib
import os
import re
import uuid

import pytest

from tests.llm.fixtures import documents, shingles, texts, words
from treefuse.llm import quality
from treefuse.shared import cut_dir, scratch

corpus_pipeline = pytest.importorskip("corpus_pipeline")
ITEMS = [(1, None), (2, ""), (3, " ".join(texts()[20][1].split()[2:16])), (4, "words that stand in no document at all, really")]
SOME = texts()[:30] + [(40, None), (41, ""), (42, "tie"), (43, "tie"), (44, "long " * 40_000)]


def given(spark, rows, labels=None) -> str:
    """A folder with documents, labels and benchmark."""
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/given-{uuid.uuid4().hex}"
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, int(bool(t) and len(t) > 40), 0) for i, t in rows if i is not None and i % 2] if labels is None else labels
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def plain_near(rows, k=5):
    """doc_ids that stay: the smallest of each component of similar shingle sets."""
    sets = {i: shingles(t, k) for i, t in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return {i for i in sets if label[i] == i}


def plain_without_repeats(rows, length=50):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        mine = [b[j : j + length] for j in range(len(b) - length + 1)]
        gone = [False] * len(b)
        for j, s in enumerate(mine):
            if s in seen:
                gone[j : j + length] = [True] * length
        seen.update(mine)
        kept, at = [], 0
        for c in t or "":
            n = len(c.encode())
            kept += [] if all(gone[at : at + n]) else [c]
            at += n
        out[i] = "".join(kept)
    return out


def plain_clean(rows, size=10):
    windows = {tuple(w[j : j + size]) for _, t in ITEMS if (w := words(t)) for j in range(max(1, len(w) - size + 1))}
    lengths = {len(x) for x in windows}
    held = lambda w: any(tuple(w[j : j + n]) in windows for n in lengths for j in range(len(w) - n + 1))
    return {i for i, t in rows if not held(words(t))}


def test_near_duplicates_keep_the_row_that_was_judged(spark):
    rows = [(1, None), (1, "some real text"), (1, "tail"), (2, None), (2, None), (3, "other"), (None, "no id")]
    docs = documents(spark, rows, repeat=False)
    got = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == [(1, "some real text"), (2, None), (3, "other")]


def test_near_duplicates_stage(spark):
    docs = documents(spark, SOME)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(plain_near(SOME))


def test_repeated_strings_stage(spark):
    docs = documents(spark, SOME).withColumnRenamed("n", "n_chars")
    out = corpus_pipeline.repeated_strings(spark, docs.dropDuplicates(["doc_id"]), "")
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == plain_without_repeats(SOME)
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_decontamination_stage(spark):
    folder = given(spark, SOME)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.clean_of_benchmarks(spark, docs, folder)
    assert out.columns == docs.columns
    want = plain_clean(SOME)
    assert {r["doc_id"] for r in out.collect()} == want and len(want) == len(SOME) - 1
    assert out.where("doc_id in (5, 6)").count() == 4  # repeated rows stay


def test_classifier_stage(spark):
    folder = given(spark, SOME)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.classify(spark, docs, folder)
    assert out.columns == docs.columns
    model = quality.train(docs.where(~quality.held_out()), spark.read.parquet(f"{folder}/labels.parquet").where(~quality.held_out()))
    want = sorted(r["doc_id"] for r in quality.score(docs, model, ["doc_id"]).collect() if r["score"] >= corpus_pipeline.LEAST_QUALITY)
    assert sorted(r["doc_id"] for r in out.collect()) == want
    # Without labels nothing is known against a document, and all stay.
    blank = given(spark, SOME, [])
    assert corpus_pipeline.classify(spark, docs, blank).count() == docs.count()


def test_tokens_stage(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    plain = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in corpus_pipeline.tokens(spark, documents(spark, SOME), "").collect()}
    assert set(got) == {i for i, _ in SOME}
    for i, t in SOME:
        ids = plain.encode(t or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256((t or "").encode()).hexdigest())
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_run_equals_the_plain_stages(spark):
    folder = given(spark, SOME, [])  # no labels: the first stage keeps all, so the rest can be restated
    at = cut_dir(spark).removeprefix("file://")
    left_over = lambda: ({f for f in os.listdir(at) if re.match("cut-|stage-|texts-", f)}, len(spark.catalog.listTables()))
    before = left_over()
    with scratch():
        got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, folder).collect()}
    stay = plain_near(SOME)
    left = plain_without_repeats([r for r in SOME if r[0] in stay])
    clean = plain_clean(left.items())
    assert got == {i: hashlib.sha256(left[i].encode()).hexdigest() for i in clean}
    assert left_over() == before


def test_run_on_nothing(spark):
    folder = given(spark, SOME[:1])
    documents(spark, SOME).where("doc_id < 0").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    assert [re.sub(r"\W+", " ", n) for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near dedup", "suffix array dedup", "benchmark decontamination", "BPE encoding and decoding"]
