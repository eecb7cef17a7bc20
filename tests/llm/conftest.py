from __future__ import annotations

import random

import pytest

# Columns that clash with names the operators use for themselves.
CLASHING = ("n_words", "score", "part", "k0", "row", "set", "text_key", "kept", "ids", "label")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def prose(seed, words, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" + draw.choice(["", "", "", ".", ",\n"]) for _ in range(words))


def awkward_rows():
    base = prose(1, 120)
    texts = [
        (1, base, "en"),
        (2, base, "en"),  # an exact copy
        (2, base, "en"),  # a repeated row
        (3, base + " and a few more", None),  # a near copy
        (4, None, "en"),
        (5, "", "de"),
        (6, " \t\n ", "xx"),
        (7, "one", "en"),
        (8, "one two three four", "en"),
        (None, prose(2, 60), "fr"),
        (None, None, None),
        (9, "Ünïcode ß 日本 Straße x y " * 30, "de"),
        (10, prose(3, 20_000, 5000), "en"),  # very long
        (11, "x" * 30_000, "en"),  # one very long word
        (12, "a b c d e " * 40, "en"),
        (13, "### **** $$$ ||| <<< >>> %%% &&&\n" * 20, "en"),
    ]
    return [(i, t, lang, f"s{(i or 0) % 2}", len(t or ""), *(["clash"] * len(CLASHING))) for i, t, lang in texts]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names."""
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer_file():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_50k.json")
