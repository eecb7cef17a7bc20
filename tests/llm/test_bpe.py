from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from salesmart.llm import bpe, queries
from salesmart.llm.texts import pieces


@pytest.fixture(scope="module")
def library(tokenizer_file):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file)


@pytest.fixture(scope="module")
def own(tokenizer_file):
    return bpe.TrieEncoder(tokenizer_file)


def encoded(own, texts):
    out = []
    for piece in pieces(pa.array(texts, pa.string())):
        ids, sizes = own.encode(piece)
        out += [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])]
    return out


def theirs(library, texts):
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


ALPHABETS = {
    "letters": "aaabbbceeeeinnoorrstt   \n\t.,'!-",
    "runs": ["a", "b", "ab", "  ", "\n", "--", "==="],
    "wide": ["é", "ß", "日本", "😀", " ", " ", "́", "x", " ", "٣", "ﬁ"],
    "special": ["<|endoftext|>", "<|endof", "text|>", "a", " ", "\n", "é"],
    "controls": [chr(c) for c in range(33)] + ["\x7f", "\x85", "a", "1"],
}


@pytest.mark.parametrize("name", ALPHABETS)
def test_ids_are_those_of_the_library(own, library, name):
    draw = random.Random(name)
    texts = ["".join(draw.choice(ALPHABETS[name]) for _ in range(draw.randrange(80))) for _ in range(1500)]
    assert encoded(own, texts) == theirs(library, texts)


def test_repeated_letters_and_very_long_words(own, library):
    texts = [c * n for c in "a-= .\nz" for n in (1, 2, 3, 7, 64, 65, 500)] + ["xy" * 60_000, "", "a" * 200_000]
    assert encoded(own, texts) == theirs(library, texts)


def test_a_full_store_begins_anew(tokenizer_file, library):
    own = bpe.TrieEncoder(tokenizer_file, limit=8)
    texts = [f"word{k % 5} and {k} more<|endoftext|>" for k in range(60)]
    for text in texts:
        assert encoded(own, [text]) == theirs(library, [text])
    assert encoded(own, texts) == theirs(library, texts)


def test_special_strings_may_be_ordinary_text(tokenizer_file):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file)
    library.encode_special_tokens = True
    own = bpe.TrieEncoder(tokenizer_file, special=False)
    texts = ["<|endoftext|>", "a <|endoftext|> b"]
    assert encoded(own, texts) == theirs(library, texts)


def test_the_trie_holds_each_word_once_and_shares_beginnings():
    words = ["tea", "ten", "te", "i", "inn", "in", "teapot", "日本", "日"]
    root, found, letters = bpe.build_trie(words), {}, 0
    waiting = [(root, 0)]
    while waiting:
        node, begin = waiting.pop()
        letters += node.end - begin
        if node.number >= 0:
            found[node.number] = node.word[: node.end]
        firsts = [c.word[node.end] for c in node.children]
        assert len(set(firsts)) == len(firsts)
        waiting += [(c, node.end) for c in node.children]
    assert [found[k] for k in range(len(words))] == words
    assert letters == len({w[:k] for w in words for k in range(1, len(w) + 1)})


def test_every_pair_that_stays_is_an_encoding(own, library):
    """Pairs of tokens are neighbours of an encoding exactly if none is crossed."""
    draw, v = random.Random(7), own.vocabulary
    plain = [n for n in v.tokens if n.isascii() and n.isalpha()]
    for _ in range(3000):
        a, b = draw.choice(plain), draw.choice(plain)
        pair = [v.tokens[a], v.tokens[b]]
        assert (theirs(library, [a + b])[0] == pair) == (not v.crossed(*pair))


def test_unknown_and_broken_ids_decode(tokenizer_file, library):
    flat, bounds = bpe.spelling(tokenizer_file)
    lists = [[50256, 64], [], [-1, 99_999_999, 65], theirs(library, ["日"])[0][:1], theirs(library, ["é"])[0]]
    ids = np.array([i for own in lists for i in own], dtype=np.int64)
    texts = bpe.decoded(ids, np.cumsum([0, *map(len, lists)]), flat, bounds).to_pylist()
    assert texts == ["<|endoftext|>a", "", "b", library.decode(lists[3], skip_special_tokens=False), "é"]


def test_query_agrees_with_the_library_on_awkward_tables(spark, monkeypatch, awkward, nothing, library):
    rows = awkward.withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit("clash"))
    more = spark.createDataFrame([(77, "a<|endoftext|>b"), (78, "<|endoftext|>" * 3)], "doc_id long, text string")
    documents = rows.unionByName(more, allowMissingColumns=True)
    monkeypatch.setattr(queries, "table", lambda *_: documents)
    found = queries.op13_bpe_coding(spark, "").collect()
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    wanted = []
    for row in documents.select("doc_id", "text").collect():
        ids = theirs(library, [row["text"] or ""])[0]
        back = library.decode(ids, skip_special_tokens=False)
        wanted.append((row["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(back)))
    order = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(map(tuple, found), key=order) == sorted(wanted, key=order)
    monkeypatch.setattr(queries, "table", lambda *_: nothing)
    assert queries.op13_bpe_coding(spark, "").collect() == []


def test_kept_columns_may_have_any_name(spark, awkward, tokenizer_file):
    own = awkward.select("doc_id", "text", F.col("ids").alias("k0"), F.lit(1).alias("text2"))
    out = bpe.encode(own, tokenizer_file, ["text", "k0", "doc_id"])
    assert out.columns == ["text", "k0", "doc_id", "ids"]
    again = bpe.decode(out, tokenizer_file)
    assert again.where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0
