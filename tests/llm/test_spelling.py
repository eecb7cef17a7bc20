from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesmart.llm import queries, spelling

from .brute import LOWER

SMALL = spelling.SpellingSettings(block=3, slice=4, task_rows=60, pairs=8, held=5)


def brute_counts(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_forms(counts):
    out = {}
    for word, n in counts.items():
        near = [w for w in counts if abs(len(w) - len(word)) < 2 and is_near(w, word)]
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        form = best if best and counts[best] >= 10 * n else None
        out[word] = (form, n, len(near), counts[form] if form else None)

    def root(word):
        return root(out[word][0]) if out[word][0] else word

    return {(w, form, root(w), n, near, form_n) for w, (form, n, near, form_n) in out.items()}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def rows_of(frame):
    found = frame.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(found) == len(set(map(tuple, found)))
    return set(map(tuple, found))


@pytest.fixture(scope="module")
def corpus():
    """Variants of a few stems, a chain of forms, anagrams, accents, and very long words."""
    draw = random.Random(3)
    stems = ["".join(draw.choice("abcdeéüÿ×") for _ in range(draw.randrange(7, 12))) for _ in range(8)]
    words = []
    for stem in stems:
        for _ in range(25):
            at = draw.randrange(len(stem))
            words += [stem[:at] + draw.choice(["", "z", "q", stem[at] + "é"]) + stem[at + 1 :]] * draw.randrange(1, 30)
    words += [w for w in ("".join(draw.sample("abcdefg", 7)) for _ in range(60)) for _ in range(2)]  # one leaf
    words += ["chainaaa"] * 3 + ["chainaab"] * 40 + ["chainabb"] * 450 + ["chainbbb"] * 5000
    words += ["tieaaaa"] * 2 + ["tieaaab"] * 30 + ["tieaaac"] * 30
    long = "longword" * 20
    words += [long] * 30 + [long[:50] + "x" + long[51:]] * 2 + [long[:-1]] * 3 + [long + "y"] * 2 + ["m" * 64] * 2 + ["m" * 65] * 2 + ["m" * 63] * 30
    draw.shuffle(words)
    seps = [" ", "1", ", ", "日", "\n", "-", "Ā", "_"]
    texts, at = [], 0
    while at < len(words):
        size = draw.randrange(1, 60)
        texts.append("".join(w.upper() if w.isascii() and draw.random() < 0.2 else w + draw.choice(seps) for w in [x + " " for x in words[at : at + size]]))
        at += size
    return [(k, t) for k, t in enumerate(texts)] + [(None, "nullkey nullkey nullkey"), (5, None), (6, "")]


@pytest.mark.parametrize("settings", [SMALL, spelling.SpellingSettings()])
def test_words_forms_and_roots_are_those_of_brute_force(spark, corpus, settings):
    found = rows_of(spelling.spelling_forms(table(spark, corpus), settings=settings))
    wanted = brute_forms(brute_counts(corpus))
    assert found == wanted
    assert any(root not in (word, form) for word, form, root, *_ in wanted)
    assert max(near for *_, near, _ in wanted) > 3


def test_awkward_and_empty_tables(spark, monkeypatch, awkward, nothing):
    text = "Straße prologue Prologue prologues prologue\x00élégante élégante elegante elegante " * 3
    more = spark.createDataFrame([(k, text) for k in range(40)] + [(None, text)], "doc_id long, text string")
    documents = awkward.unionByName(more, allowMissingColumns=True)
    for name in ("word", "n", "n_near", "key", "upper", "cell"):
        documents = documents.withColumn(name, F.lit("clash"))
    monkeypatch.setattr(queries, "table", lambda *_: documents)
    found = rows_of(queries.op11_spelling_variants(spark, ""))
    assert found == brute_forms(brute_counts([(r["doc_id"], r["text"]) for r in documents.collect()]))
    monkeypatch.setattr(queries, "table", lambda *_: nothing)
    assert queries.op11_spelling_variants(spark, "").collect() == []


def test_crc32_goes_on_from_any_state():
    draw = random.Random(1)
    words = [bytes(draw.randrange(256) for _ in range(draw.choice([0, 1, 7, 30, 64, 65, 200]))) for _ in range(300)]
    before = [zlib.crc32(f"{k}:".encode()) for k in range(300)]
    sizes = np.array(list(map(len, words)))
    found = spelling.crc32_after(np.array(before, dtype=np.uint32), np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert found.tolist() == [zlib.crc32(w, b) for w, b in zip(words, before)]


def test_a_hot_cell_that_is_cut_into_parts_loses_no_pair(spark):
    """A third of the words are anagrams of each other."""
    draw = random.Random(8)
    words = {"".join(draw.sample("abcdefgh", 8)) for _ in range(400)} | {"".join(draw.choice("etaoinsrhld") for _ in range(9)) for _ in range(800)}
    frame = spark.createDataFrame([(w, 2) for w in sorted(words)], "word string, n long")
    settings = spelling.SpellingSettings(block=40, slice=50, task_rows=200)
    found = {r["word"]: r["n_near"] for r in spelling.near_words(frame, settings).collect()}
    wanted = {w: sum(is_near(w, o) for o in words if o != w) for w in words}
    assert found == {w: n for w, n in wanted.items() if n}
