"""Decontamination, quality rules, packing, token files and scores against plain Python."""

from __future__ import annotations

import collections
import io
import os
import random
import time
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from salesmart.llm import decontamination, lm_scoring, packing, quality_rules, token_files
from salesmart.llm.storage import SHUFFLES_GO, removed, written
from salesmart.llm.succinct import EliasFano
from salesmart.llm.tokens import Encoder
from salesmart.llm.texts import pieces

from . import brute


@pytest.fixture(scope="module")
def overlapping(spark):
    """Texts over few words, so that spans of all lengths are shared."""
    draw = random.Random(4)
    make = lambda n: " ".join(draw.choice("ab cd EF. g, h1".split()) for _ in range(n))
    items = [(k, make(draw.choice([1, 2, 3, 9, 10, 11, 14, 25]) if k < 30 else 12)) for k in range(60)]
    items += [(7, items[8][1]), (100, None), (101, " .. "), (None, make(10))]
    longer = [(k, make(10)) for k in range(200, 240)]
    texts = []
    for _ in range(60):
        parts = [make(draw.randrange(15)) for _ in range(3)]
        parts.insert(draw.randrange(4), draw.choice(longer)[1] if draw.random() < 0.5 else " ".join((draw.choice(items)[1] or "x").split()[:9]))
        texts.append(" zz ".join(parts))
    return texts + [None, "", texts[0], "ab", "AB\ncd"], items + longer


@pytest.mark.parametrize("only_long", [False, True])
def test_every_shared_window_is_found(spark, overlapping, only_long):
    texts, items = overlapping
    if only_long:
        items = [i for i in items if len(brute.plain_words(i[1])) >= 10 and i[0] is not None]
    else:
        items = [i for i in items if i[0] is not None]
    documents = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, n_words string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    got = {r[0]: tuple(r)[1:] for r in decontamination.decontaminate(documents, benchmark, ["doc_id"]).collect()}
    assert got == dict(enumerate(brute.decontaminated(texts, items)))
    kept = {r[0] for r in decontamination.clean_documents(documents, benchmark).select("doc_id").collect()}
    assert kept == {k for k, r in got.items() if not r[4]}


def test_a_full_bit_table_costs_work_only(spark, overlapping):
    texts, items = overlapping
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([i for i in items if i[0] is not None], "item_id long, text string")
    got = decontamination.decontaminate(documents, benchmark, ["doc_id"], table_bits=4).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == dict(enumerate(brute.decontaminated(texts, [i for i in items if i[0] is not None])))


def test_winnowing_keeps_a_gram_of_every_neighbourhood():
    draw = random.Random(8)
    piece = next(pieces(pa.array([" ".join(draw.choices("abcdefg", k=400)), "a b c", ""])))
    from salesmart.llm.texts import PLAIN_WORD

    words = PLAIN_WORD.words(piece)
    first, hashes = words.windows(5)
    kept = set(decontamination.fingerprints(words, 5, 6)[0].tolist())
    for k in range(len(first) - 5):
        assert kept & set(first[k : k + 6].tolist())
    assert len(kept) < 0.5 * len(first)


def test_decontamination_of_awkward_and_empty_tables(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "one two three four"), (2, None)], "item_id long, text string")
    rows = decontamination.decontaminate(awkward, items, ["doc_id"]).collect()
    assert len(rows) == awkward.count()
    assert [r["doc_id"] for r in rows if r["contaminated"]] == [8]
    assert decontamination.decontaminate(nothing, items, ["doc_id"]).collect() == []
    assert not any(r["contaminated"] for r in decontamination.decontaminate(awkward, items.limit(0), ["doc_id"]).collect())
    clean = decontamination.clean_documents(awkward, items)
    assert clean.columns == awkward.columns and clean.count() == awkward.count() - 1


# Quality rules -----------------------------------------------------------------------------


def judged_by_hand(rows, rules):
    """Verdicts from references summed over all rows, in plain Python."""
    common = quality_rules.common_words()

    def histograms(text):
        text = text or ""
        classes = [0] * 8
        names = list(quality_rules.CLASSES.values())
        for c in text:
            known = [k for k, of_class in enumerate(names) if ord(c) < 128 and ord(c) in of_class]
            classes[known[0] if known else 7] += 1
        words = [0] * (len(common) + 1)
        for w in brute.plain_words(text):
            words[common.index(w) if w in common else len(common)] += 1
        return classes, words

    own = [histograms(t) for t, _ in rows]
    totals = defaultdict(lambda: [np.zeros(8), np.zeros(len(common) + 1)])
    for (c, w), (_, lang) in zip(own, rows):
        key = lang if lang in quality_rules.COMMON_WORDS else "other"
        totals[key][0] += c
        totals[key][1] += w

    def distance(p, q):
        if not sum(p):
            return 0.0
        p, q = np.array(p) / sum(p), q / q.sum()
        m = (p + q) / 2
        kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m) if a > 0)
        return np.sqrt(max(0.0, (kl(p) + kl(q)) / 2))

    references = [t for _, t in sorted(totals.items()) if t[0].sum() and t[1].sum()]
    out = []
    for (c, w), (text, _) in zip(own, rows):
        n, *_, repeated = brute.rule_counts(text)
        a, b = min(((distance(c, r[0]), distance(w, r[1])) for r in references), key=sum)
        failed = n < rules.min_words or 100 * repeated > rules.max_repeat_percent * n
        odd = sum(c) >= rules.guard_chars and a > rules.max_class_distance or sum(w) >= rules.guard_words and b > rules.max_word_distance
        out.append((*brute.rule_counts(text), failed, not failed and not odd, round(a, 6), round(b, 6)))
    return out


def test_rules_are_those_said_by_hand(spark, awkward, nothing):
    rules = quality_rules.QualityRules(guard_chars=60, max_class_distance=0.3, guard_words=15, max_word_distance=0.5)
    source = awkward.select("doc_id", "text", "lang").collect()
    got = [
        (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"], round(r["class_distance"], 6), round(r["word_distance"], 6))
        for r in quality_rules.quality_rules(awkward, rules=rules).collect()
    ]
    want = judged_by_hand([(r["text"], r["lang"]) for r in source], rules)
    assert sorted(got) == sorted(want)
    kept = quality_rules.kept_documents(awkward, rules=rules)
    assert kept.columns == awkward.columns
    assert kept.count() == sum(r[6] for r in want)
    assert quality_rules.quality_rules(nothing).collect() == []
    assert quality_rules.kept_documents(nothing).collect() == []


# Packing and token files -------------------------------------------------------------------


def plain_ids(tokenizer_file, text, end):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_file)
    own.encode_special_tokens = True
    return own.encode(text or "", add_special_tokens=False).ids + [end]


def test_stretches_encode_as_the_library_does(tokenizer_file):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_file)
    own.encode_special_tokens = True
    draw = random.Random(1)
    signs = [" ", " ", "  ", "\n", "\t", "a", "b'", "'s", "12", "é", "᠎", "!", "<|endoftext|>", "\r", "\x1c", "日", "I'll", "\x00", "​", "\u0085", "×.", "ß.", "a.", "—", "’", "　"]
    texts = ["".join(draw.choices(signs, k=draw.randrange(14))) for _ in range(4000)]
    made, at = Encoder(tokenizer_file, limit=300), 0
    for piece in pieces(pa.array(texts), limit=2000):
        ids, sizes = made.encode(piece, 7)
        for part in np.split(ids, np.cumsum(sizes)[:-1]):
            assert part.tolist() == own.encode(texts[at], add_special_tokens=False).ids + [7], repr(texts[at])
            at += 1
    assert at == len(texts)


def test_pieces_tile_documents_and_sequences(spark, awkward, nothing, tokenizer_file):
    length = 64
    pieces_ = packing.pack(awkward, tokenizer_file, length=length, with_ids=True).cache()
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, plain_ids(tokenizer_file, r["text"], 1)) for r in awkward.collect())
    by_document, at = defaultdict(list), defaultdict(int)
    for p in sorted(pieces_.collect(), key=lambda p: (p["sequence_id"], p["offset"])):
        ids = np.frombuffer(p["ids"], dtype="<u4").tolist()
        assert len(ids) == p["length"] > 0 and brute.token_crc(ids) == p["ids_crc32"]
        assert p["offset"] == at[p["sequence_id"]]
        at[p["sequence_id"]] += p["length"]
        document = p["sequence_id"] * length + p["offset"] - p["start"]
        by_document[document].append((p["start"], ids, p["doc_id"], p["doc_tokens"]))
    assert set(at) == set(range(len(at)))
    assert all(n == length for s, n in at.items() if s < len(at) - 1)
    got = []
    for parts in by_document.values():
        ids = [i for _, part, _, _ in sorted(parts, key=lambda p: p[0]) for i in part]
        assert len({p[2:] for p in parts}) == 1 and len(ids) == parts[0][3]
        got.append((parts[0][2] is not None, parts[0][2] or 0, ids))
    assert sorted(got) == want
    whole = packing.sequences(pieces_).collect()
    assert {r["sequence_id"]: len(r["ids"]) // 4 for r in whole} == dict(at)
    assert packing.pack(nothing, tokenizer_file).collect() == []


@pytest.mark.parametrize("unit", ["bytes", "bits"])
@pytest.mark.parametrize("block", [1, 7, 1 << 12])
def test_planes_restore_ids(unit, block):
    draw = np.random.default_rng(block)
    sizes = [0, 1, 3, 20, 0, 100]
    texts = [draw.integers(0, 1 << draw.integers(1, 33), n).astype("<u4").tobytes() for n in sizes]
    file = io.BytesIO()
    file.close, done = (lambda: None), file
    writer = token_files.FileWriter(file, token_files.FileFormat(block=block, unit=unit))
    for k, ids in enumerate(texts):
        writer.add(None if k == 2 else k - 1, ids)
    writer.close()
    reader = token_files.FileReader(pa.BufferReader(done.getvalue()))
    assert [(k, i) for k, _, i in reader.documents()] == [(None if k == 2 else k - 1, ids) for k, ids in enumerate(texts)]
    assert [s for _, s, _ in reader.documents()] == np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist()


def test_files_hold_all_documents_in_order(spark, awkward, nothing, tokenizer_file):
    form = token_files.FileFormat(block=256, unit="bits", file_ids=2000)
    rows = token_files.write_and_read(awkward, tokenizer_file, form=form).collect()
    source = [(r["doc_id"], plain_ids(tokenizer_file, r["text"], 0)) for r in awkward.collect()]
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((d or -1, len(i), brute.token_crc(i)) for d, i in source)
    at, last = 0, -1
    for row in sorted(rows, key=lambda r: r["start"]):
        assert row["start"] == at and (row["doc_id"] or -1) >= last
        at, last = at + row["n_tokens"], row["doc_id"] or -1
    assert token_files.write_and_read(nothing, tokenizer_file).collect() == []


# Language model ----------------------------------------------------------------------------


def test_scores_are_those_of_the_model_said_by_hand(spark, nothing):
    draw = random.Random(6)
    word = lambda: f"w{int(draw.paretovariate(0.9))}"
    texts = [" ".join(word() for _ in range(draw.randrange(60))) for _ in range(300)] + [None, "", "A a A", "never seen words here"]
    training = [zlib.crc32(str(k).encode()) % 7 != 2 for k in range(len(texts))]
    documents = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, score string").repartition(5)
    settings = lm_scoring.LmSettings(head_share=8e-4, gram_share=4e-4, part_tokens=500, held=300, shard_grams=40)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    model = lm_scoring.train(documents.where(~held_out), settings=settings)
    total, want = brute.language_model(texts, training, settings.head_share, settings.gram_share, settings.discount)
    assert model.tokens == total and len(model.shards) > 1
    rows = {r["doc_id"]: r for r in lm_scoring.score(documents, model, ["doc_id"]).collect()}
    assert len(rows) == len(texts)
    for k, (n, known, base, score) in enumerate(want):
        assert (rows[k]["n_tokens"], rows[k]["n_known"]) == (n, known)
        assert rows[k]["base_score"] == pytest.approx(base)
        assert abs(rows[k]["score"] - score) <= 0.01 * n
    assert lm_scoring.score(nothing, model, ["doc_id"]).collect() == []


@pytest.mark.parametrize("numbered", [1 << 20, 15])
def test_every_repeated_ngram_is_kept(spark, numbered):
    """Whatever the size of the corpus, and though few tokens have a small number."""
    assert {lm_scoring._lowest_count(lm_scoring.LmSettings().gram_share, 10**k) for k in (3, 9, 12)} == {2}
    assert lm_scoring._lowest_count(lm_scoring.LmSettings().head_share, 10**12) == 2
    draw = random.Random(8)
    word = lambda: f"w{int(draw.paretovariate(0.7))}"
    texts = [" ".join(word() for _ in range(draw.choice([0, 9, 40]))) for _ in range(150)] + [" ".join(word() for _ in range(1500)), None, "never seen"]
    training = [k % 5 != 2 for k in range(len(texts))]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    settings = lm_scoring.LmSettings(numbered=numbered, part_tokens=3000, held=1200, shard_grams=150)
    model = lm_scoring.train(documents.where("doc_id % 5 <> 2"), settings=settings)
    total, want = brute.language_model(texts, training, 0, 0, settings.discount)
    assert model.tokens == total and len(model.shards) > 1
    rows = {r["doc_id"]: r for r in lm_scoring.score(documents, model, ["doc_id"], settings=settings).collect()}
    assert len(rows) == len(texts)
    for k, (n, known, base, score) in enumerate(want):
        assert (rows[k]["n_tokens"], rows[k]["n_known"]) == (n, known)
        assert rows[k]["base_score"] == pytest.approx(base)
        assert abs(rows[k]["score"] - score) <= 0.01 * n


def counted_blocks(runs, pairs_each, vocabulary):
    """Blocks of n-grams of runs, and all of them in a dictionary."""
    draw, packer, blocks, total = np.random.default_rng(4), zstandard.ZstdCompressor(level=1), [], collections.Counter()
    for _ in range(runs):
        words = np.sort(draw.choice(10 * vocabulary, vocabulary, replace=False))
        three = np.unique(lm_scoring._packed([draw.zipf(1.3, pairs_each) % vocabulary, *draw.integers(0, vocabulary, (2, pairs_each))]))
        grams = {1: np.zeros(0, np.uint64), 2: np.unique(three >> np.uint64(lm_scoring.ID_BITS)), 3: three}
        counts = {length: draw.integers(1, 3, len(keys)) for length, keys in grams.items()}
        counts[2] = np.bincount(np.searchsorted(grams[2], three >> np.uint64(lm_scoring.ID_BITS)), counts[3]).astype(np.int64)
        blocks.append(lm_scoring._block(words, grams, packer, counts))
        for length in (2, 3):
            for gram, count in zip(zip(*[words[c].tolist() for c in lm_scoring._split(grams[length], length)]), counts[length].tolist()):
                total[gram] += count
    return blocks, total


def test_blocks_are_merged_to_the_frequent_ngrams(spark):
    blocks, total = counted_blocks(6, 800, 40)
    for lowest in (2, 5):
        merged = lm_scoring._merged(blocks, lowest)
        for length in (2, 3):
            columns, counts = merged[length][:2]
            found = list(zip(*[c.tolist() for c in columns]))
            assert found == sorted(g for g, n in total.items() if len(g) == length and n >= lowest)
            assert counts.tolist() == [total[g] for g in found]
        assert merged[3][2].tolist() == [total[g[:2]] for g in zip(*[c.tolist() for c in merged[3][0]])]


def test_merging_takes_a_few_words_of_memory_an_ngram():
    blocks, total = counted_blocks(20, 15_000, 5000)
    tracemalloc.start()
    lm_scoring._merged(blocks, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 * len(total)


def test_what_shards_are_asked_and_say_takes_few_bytes(spark):
    """Scoring moves n-grams to shards and answers back: that was most of its disk."""
    draw, packer = np.random.default_rng(7), zstandard.ZstdCompressor(level=1)
    texts = [(k, " ".join(f"w{w}" for w in draw.zipf(1.3, 400) % 5000)) for k in range(100)]
    model = lm_scoring.train(spark.createDataFrame(texts, "doc_id long, text string"), settings=lm_scoring.LmSettings(shard_grams=1500))
    own = lm_scoring._Head(lm_scoring._mapped(model.folder, model.head))
    n = np.concatenate([lm_scoring._Stream(p, own).gram for p in pieces(pa.array([t for _, t in texts]))])
    words, at = np.unique(n, return_inverse=True)
    probes = lm_scoring._Probes(words, at, 0, len(model.shards))
    assert [words[c].tolist() for c in lm_scoring._split(probes.keys[3], 3)] == list(map(list, zip(*sorted({g for g in zip(n.tolist(), n[1:].tolist(), n[2:].tolist()) if g[0] >= 0 and g[1] > 0 and g[2] != 0}))))
    asked = said = 0
    for place, number, path in model.shards:
        arrays, grams = lm_scoring._mapped(model.folder, path), probes.of(place)
        block = lm_scoring._block(words, grams, packer)
        held, found = lm_scoring._unblock(block)
        for length in (1, 2, 3):
            assert [held[c].tolist() for c in lm_scoring._split(found[length], length)] == [words[c].tolist() for c in lm_scoring._split(grams[length], length)]
        plain = lm_scoring.Shard(place, number, arrays).answer(held, found)
        raw = lm_scoring.Shard(place, number, arrays).prepared().answer(held, found).to_bytes(packer)
        for one, other in zip(plain.values(), lm_scoring.Answer.of(raw).values()):
            assert one.tolist() == other.tolist()
        assert len(plain.codes[3]) == len(np.unique(found[3] >> np.uint64(lm_scoring.ID_BITS)))  # a context is told once
        asked, said = asked + len(block), said + len(raw)
    total = len(probes.keys[2]) + len(probes.keys[3])
    assert len(model.shards) > 3 and asked < 1.6 * total and said < 0.35 * total, (asked / total, said / total)


@pytest.mark.parametrize("most", [3, 1 << 8, 1 << 40])
@pytest.mark.parametrize("size", [0, 1, 1000])
def test_prepared_sequences_find_alike(most, size):
    draw = np.random.default_rng(size)
    values = np.sort(draw.integers(0, most, size))
    begin, end = np.sort(draw.integers(0, size + 1, (2, 500)), axis=0)
    asked = np.concatenate([draw.choice(values, 250) if size else np.zeros(250, np.int64), draw.integers(0, most, 250)])
    for own in (EliasFano.of(values), EliasFano.of(values).prepared()):
        assert own.get(np.arange(size)).tolist() == values.tolist()
        want = [b + int(np.searchsorted(values[b:e], x)) for x, b, e in zip(asked, begin, end)]
        want = [k if k < e and values[k] == x else -1 for k, e, x in zip(want, end, asked)]
        assert own.find(asked, begin, end).tolist() == want


def test_scoring_keeps_no_shuffle_of_what_it_asked(spark):
    documents = spark.createDataFrame([(k, f"a b c d{k % 7}") for k in range(50)], "doc_id long, text string")
    model = lm_scoring.train(documents)
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = manager.shuffleStatuses().size()
    scored = lm_scoring.score(documents, model, ["doc_id"])
    assert "asked" not in scored._jdf.queryExecution().executedPlan().toString()
    for _ in range(100):  # Spark removes shuffles in the background
        if manager.shuffleStatuses().size() <= before + 1:
            break
        time.sleep(0.1)
    assert manager.shuffleStatuses().size() <= before + 1 and scored.count() == 50


def test_rows_meet_their_shard_in_blocks(spark):
    draw = random.Random(5)
    rows = [(k % 3 + 1, draw.randrange(1 << 32), *[draw.randrange(1 << 62) for _ in range(5)]) for k in range(500)]
    blocks = lm_scoring._dealt(spark.createDataFrame(rows, lm_scoring.ROWS).repartition(3), 4, 60).collect()
    assert {r["shard"] for r in blocks} == set(range(4)) and len(blocks) < 60
    for shard in range(4):
        own = [r for r in blocks if r["shard"] == shard]
        found = lm_scoring._gathered([r["sizes"] for r in own], [pa.scalar(bytes(r["block"])) for r in own])
        for kind, names in lm_scoring.KINDS.items():
            at = [("kind", "spot", "a", "b", "c", "n", "context").index(name) for name in names]
            want = sorted(tuple(r[k] for k in at) for r in rows if r[0] == kind and (r[1] * 4) >> 32 == shard)
            assert sorted(zip(*[c.tolist() for c in found[kind]])) == want


def test_training_leaves_no_shuffle_files(spark):
    documents = spark.createDataFrame([(k, f"a b c d{k % 7}") for k in range(50)], "doc_id long, text string")
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = manager.shuffleStatuses().size()
    kept = spark.conf.get(SHUFFLES_GO, None)
    lm_scoring.train(documents)
    assert spark.conf.get(SHUFFLES_GO, None) == kept
    assert manager.shuffleStatuses().size() <= before + 1


def test_tables_that_nothing_reads_any_more_go(spark, monkeypatch):
    gone = []
    monkeypatch.setattr(lm_scoring, "removed", lambda table: (gone.append((table.inputFiles(), table.columns)), removed(table)))
    plans = []
    monkeypatch.setattr(lm_scoring, "written", lambda frame: (plans.append(frame._jdf.queryExecution().executedPlan().toString()), written(frame))[1])
    lm_scoring.train(spark.createDataFrame([(k, f"a b c d{k % 7} e{k % 9}") for k in range(50)], "doc_id long, text string"), settings=lm_scoring.LmSettings(numbered=5))
    ((files, columns),) = gone
    assert "context" in columns and files and not any(os.path.exists(f.removeprefix("file:")) for f in files)
    # One Python worker a task: no stage has a second one that feeds the first.
    assert len(plans) == 3 and plans[2].count("MapInArrow") == 2 and "Union" in plans[2]


def test_scoring_awkward_documents_and_learning_from_none(spark, awkward, nothing):
    model = lm_scoring.train(nothing)
    assert {(r["base_score"], r["score"], r["n_known"]) for r in lm_scoring.score(awkward, model, ["doc_id"]).collect()} == {(0.0, 0.0, 0)}
    model = lm_scoring.train(awkward)
    rows = lm_scoring.score(awkward, model, ["doc_id", "score"]).toDF("doc_id", "clash", "n_tokens", "n_known", "base", "score").collect()
    assert len(rows) == awkward.count()
    assert all(r["n_known"] == r["n_tokens"] and r["score"] <= 0 for r in rows)


def test_probabilities_of_a_context_add_up(spark):
    documents = spark.createDataFrame([(1, "a b a b a c a b c"), (2, "a b c a b")], "doc_id long, text string")
    model = lm_scoring.train(documents)
    own = lm_scoring._Head(lm_scoring._mapped(model.folder, model.head))
    shards = [lm_scoring.Shard(first, last, lm_scoring._mapped(model.folder, path)) for first, last, path in model.shards]
    total = 0.0
    for word in ("a", "b", "c", ""):
        stream = lm_scoring._Stream(next(pieces(pa.array([f"a b {word}"]))), own)
        a2, m1, a3, m2 = lm_scoring._lookups(shards, stream.gram)
        at = 3
        p = (own.counts[stream.place[at]] + 1) / (model.tokens + model.distinct + 1)
        total += a3[at] + m2[at] * (a2[at] + m1[at] * p)
    unseen = 1 / (model.tokens + model.distinct + 1)
    assert total + m2[at] * m1[at] * unseen == pytest.approx(1, abs=0.02)


def test_files_need_whole_number_ids_and_a_folder_that_arrow_reaches(spark, tokenizer_file, tmp_path):
    texts = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    with pytest.raises(ValueError, match="whole numbers"):
        token_files.write_files(texts, tokenizer_file, str(tmp_path))
    numbers = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    with pytest.raises(ValueError, match="can't be kept"):
        token_files.write_files(numbers, tokenizer_file, "nostore://bucket/folder")


def test_a_cluster_without_a_shared_folder_is_told_so():
    from types import SimpleNamespace

    from salesmart.llm import storage

    unset = SimpleNamespace(get=lambda key, default=None: default)
    cluster = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getConf=lambda: unset, master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(cluster)
