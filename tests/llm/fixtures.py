"""Small awkward tables, and plain restatements of what the operators must return."""

import random
import re

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = str.maketrans(UP, LOW)
EXTRA = ", n long, h string, rep long, component long, score double, ids string, words string, window long, key string"
EXTRA_ROW = (7, "x", 3, 4, 0.5, "i", "w", 9, "k")


def texts(seed: int = 0) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioubcdfgéüñ") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, base = prose(30), prose(80)
    out: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, "  \n\t "), (3, "one"), (4, "Two words"), (5, base), (6, base), (7, base + " tail")]
    words = base.split()
    for i in range(8, 16):  # near copies
        copy = list(words)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        out.append((i, " ".join(copy)))
    for i in range(16, 30):
        out.append((i, prose(rng.randint(1, 120)) + (f" {shared} " + prose(5) if i % 3 == 0 else "")))
    out.append((30, prose(9000)))
    out.append((31, "Released under the MIT License. " + prose(3) + " mit   LICENSE, apache license; general public license"))
    out.append((32, "🙂🙂 <|endoftext|>  it's\u0085　é\r\n" + shared.upper()))
    out.append((33, "y" * 60))
    out.append((34, "y" * 120))
    return out


def documents(spark, rows=None, repeat: bool = True):
    rows = texts() if rows is None else rows
    rows = rows + (rows[5:7] if repeat else [])
    return spark.createDataFrame([(*r, *EXTRA_ROW) for r in rows], "doc_id long, text string" + EXTRA)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingles(text: str | None, k: int) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
