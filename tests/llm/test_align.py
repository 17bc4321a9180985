import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.fixtures import EXTRA, EXTRA_ROW, documents, texts
from treefuse.llm import token_align

public_tokenizers = pytest.importorskip("public_tokenizers")
AWKWARD = [
    (100, "tabs\tand\n new\r\n\r\nlines  two   three spaces "), (101, " "), (102, "   "), (103, "a ▁ b"), (104, "don ' t x' y 'z"), (105, "日本語 テキスト 🙂🙂 naïve café́ x"),
    (106, "</s> <unk> <s> <|endoftext|> <0x41>"), (107, "　wide　 space    nbsp\u0085 nel"), (108, "y" * 3000 + " " + "ab" * 500), (109, "nul\x00byte \x1c fs"),
    (110, "ﬁne ½ ℌ"), (111, "0123456789 12 345 6789.00 -1e10"), (112, None), (113, ""),
]


def brute(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(i): i for i in own}
    letters |= {chr(256 + n): i for n, i in enumerate(i for i in range(256) if i not in own)}
    piece = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    found, total = [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ta = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
            tb = [piece(b.id_to_piece(i)) for i in ib]
            if b"".join(ta) == b"".join(tb) == (" " + text).encode():
                ea, eb = np.cumsum([len(x) for x in ta]).tolist(), np.cumsum([len(x) for x in tb]).tolist()
                i = j = 0
                for end in sorted({*ea} & {*eb}):
                    m, n = ea.index(end, i) + 1, eb.index(end, j) + 1
                    groups.append((ia[i:m], ib[j:n]))
                    i, j = m, n
        total.update((x[-1], y[-1]) for x, y in groups)
        found.append((doc_id, groups))
    most = Counter()
    for (_, y), n in total.items():
        most[y] = max(most[y], n)
    out = []
    for doc_id, groups in found:
        links = [(x[-1], y[-1]) for x, y in groups]
        spelt = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(total[p] == most[p[1]] for p in links), sum(total[p] for p in links), hashlib.sha256(spelt.encode()).hexdigest() if groups else ""))
    return sorted(out)


@pytest.mark.parametrize("frequent", [1 << 18, 40, 0])
def test_alignment_equals_brute_force(spark, frequent):
    rows = texts() + AWKWARD + texts()[5:7]
    docs = spark.createDataFrame([(*r, *EXTRA_ROW) for r in rows], "doc_id long, text string" + EXTRA).repartition(3)
    got = sorted(tuple(r) for r in token_align.alignment(docs, frequent=frequent).collect())
    want = brute(rows)
    assert sum(w[1] == 0 for w in want) >= 4 and any(w[3] < min(w[1], w[2]) for w in want)
    assert got == want


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = token_align.op12_token_align(spark, sf_dir)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_no_documents(spark):
    assert token_align.alignment(documents(spark).where("doc_id < 0")).count() == 0


def test_shared_cuts_equal_intersection():
    rng = random.Random(3)
    for _ in range(200):
        ends_a, ends_b, begin, base = [], [], [0], 0
        for _ in range(rng.randint(1, 5)):
            n = rng.randint(0, 60)
            if n:
                ends_a += sorted({*(base + rng.randint(1, n) for _ in range(rng.randint(0, n))), base + n})
                ends_b += sorted({*(base + rng.randint(1, n) for _ in range(rng.randint(0, n))), base + n})
            base += n
            begin.append(len(ends_a))
        got = token_align.shared_cuts(np.array(ends_a, np.int64), np.array(ends_b, np.int64), np.array(begin))
        assert got.tolist() == [i for i, e in enumerate(ends_a) if e in {*ends_b}]


@pytest.mark.parametrize("memory", [1 << 20, 0])
def test_fragments_are_cut_into_groups_once(monkeypatch, memory):
    from treefuse.llm.bpe import public_vocabulary

    seen, cuts = [], token_align.shared_cuts
    monkeypatch.setattr(token_align, "shared_cuts", lambda a, b, begin: seen.append(len(a)) or cuts(a, b, begin))
    encoder = token_align.PairEncoder(*token_align.vocabularies(public_vocabulary(), token_align.public_pieces()), memory)
    rows = [(i, t) for i, t in texts() + AWKWARD if i != 30] + [(200 + i, "unhappily misspelt wrods, again and again " * 30) for i in range(40)]
    data = [(" " + (t or "")).encode() for _, t in rows]
    want = {r[0]: (r[1], r[2], r[3], r[7]) for r in brute(rows)}
    for _ in range(3):
        n_a, n_b, shas, pairs, begin = encoder.encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in data]))))
        assert {i: x for (i, _), *x in zip(rows, n_a, n_b, np.diff(begin), shas, strict=True)} == {i: list(x) for i, x in want.items()}
        assert len(pairs) == begin[-1]
    assert len(seen) == (1 if memory else 3) and max(seen) < sum(n_a) / 4
