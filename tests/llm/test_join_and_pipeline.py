from __future__ import annotations

import os
import random

import duckdb
import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

import corpus_pipeline
from salesmart.llm import ngram_join, queries
from salesmart.llm.components import components
from salesmart.llm.oracle import oracle

from . import brute

SMALL = ngram_join.JoinSettings(crowd=3, block=8, block_shingles=1500)


def family(draw, size, words, changes):
    base = [f"v{draw.randrange(300)}" for _ in range(words)]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(draw.randrange(changes + 1)):
            own[draw.randrange(words)] = f"x{draw.randrange(10_000)}"
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def texts():
    """A large family, small ones, chains, a passage that many share, copies, and loners."""
    draw = random.Random(12)
    made = family(draw, 60, 120, 3)
    for _ in range(12):
        made += family(draw, draw.randrange(2, 5), draw.randrange(5, 90), 2)
    chain = [f"c{k}" for k in range(80)]
    for k in range(8):
        made.append(" ".join(chain))
        chain[k * 9] = f"n{k}"
    passage = " ".join(f"p{k}" for k in range(55))
    made += [f"{passage} " + " ".join(f"l{draw.randrange(5000)}" for _ in range(90)) for _ in range(25)]
    made += [made[0]] * 15 + [made[61]] * 2 + ["one", "One!", "a b c", "a b", "", None, " ", "..."]
    made += [" ".join(f"z{draw.randrange(5000)}" for _ in range(40)) for _ in range(20)]
    draw.shuffle(made)
    return made


def test_every_link_and_class_is_found(spark, texts):
    table = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, set string").repartition(4)
    rows = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(table, settings=SMALL).collect()}
    links, classes = brute.near_duplicates(texts)
    assert max(map(len, links)) > 40
    assert rows == {k: (classes[k], len(links[k])) for k in range(len(texts))}
    kept = ngram_join.distinct_documents(table, settings=SMALL)
    assert kept.columns == table.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(set(classes))


def test_awkward_and_empty_tables(spark, awkward, nothing):
    rows = ngram_join.near_duplicates(awkward, settings=SMALL).collect()
    assert len(rows) == awkward.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append((r["class_id"], r["n_links"]))
    assert by_id[1] == [(1, 3)] and by_id[2] == [(1, 3)] * 2 and by_id[3] == [(1, 3)]
    assert by_id[4] == [(4, 0)] and by_id[5] == [(5, 0)] and by_id[8] == [(8, 0)]
    assert sorted(map(str, by_id[None])) == ["(None, 0)", "(None, 0)"]
    kept = ngram_join.distinct_documents(awkward, settings=SMALL)
    assert sorted(r[0] or -1 for r in kept.select("doc_id").collect()) == [-1, -1, 1, *range(4, 14)]
    assert ngram_join.near_duplicates(nothing).collect() == []


def test_pruning_keeps_pairs_at_the_threshold():
    settings = ngram_join.JoinSettings()
    least = ngram_join.least_matches(settings)
    assert least == sorted(least) and all(m < 0.8 * n for m, n in zip(least, range(24, 73, 24)))
    # The chance that a pair at the threshold has fewer equal values than that.
    from math import comb

    for m, n in zip(least, range(24, 73, 24)):
        assert sum(comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m)) < 1e-5


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(200), draw.randrange(200)) for _ in range(130)] + [(500 + k, 501 + k) for k in range(40)] + [(900, 900 + k) for k in range(60)] + [(3, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# Queries and pipeline ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def directory():
    path = os.path.join(TESTDATA, "sf0.001")
    if not os.path.isdir(path):
        pytest.skip("test tables not present")
    return path


@pytest.mark.parametrize("name", sorted(oracle()))
def test_query_equals_sql(spark, directory, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {table} AS FROM read_parquet('{directory}/{table}.parquet')")
    df = queries.queries()[name](spark, directory)
    rel = con.sql(oracle()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[k] for k in order) for r in rel.fetchall()), key=repr)


def test_all_queries_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.queries()) == list(range(1, 14))


def test_each_stage_against_plain_python(spark, directory, tmp_path, tokenizer_file):
    """What each stage keeps, held against the brute-force version on that stage's input."""
    documents = spark.read.parquet(f"{directory}/documents.parquet")
    labels = spark.read.parquet(f"{directory}/labels.parquet").where("quality IS NOT NULL")
    items = [tuple(r) for r in spark.read.parquet(f"{directory}/benchmark.parquet").select("item_id", "text").collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    inputs, outputs = {}, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, documents, directory).write.parquet(str(tmp_path / str(k)))
        inputs[name], documents = documents, spark.read.parquet(str(tmp_path / str(k)))
        outputs[name] = documents
        if name != names[-1]:
            assert documents.columns == inputs[name].columns

    first = {r["doc_id"] for r in outputs[names[0]].select("doc_id").collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    right = [(d in first) == bool(q) for d, q in truth.items()]
    assert sum(right) / len(right) > 0.97

    ruled = inputs[names[1]].select("doc_id", "text").collect()
    kept = {r["doc_id"] for r in outputs[names[1]].select("doc_id").collect()}
    for r in ruled:
        n, *_, repeated = brute.rule_counts(r["text"])
        assert not (r["doc_id"] in kept and (n < 10 or 100 * repeated > 20 * n))
    assert len(kept) > 0.8 * len(ruled)

    joined = sorted(tuple(r) for r in inputs[names[2]].select("doc_id", "text").collect())
    _, classes = brute.near_duplicates([t for _, t in joined])
    assert {r["doc_id"] for r in outputs[names[2]].select("doc_id").collect()} == {joined[k][0] for k in set(classes)}

    cleaned = [tuple(r) for r in inputs[names[3]].select("doc_id", "text").collect()]
    found = brute.decontaminated([t for _, t in cleaned], items)
    assert {r["doc_id"] for r in outputs[names[3]].select("doc_id").collect()} == {d for (d, _), f in zip(cleaned, found) if not f[4]}

    packed = outputs[names[4]].groupBy("doc_id").sum("length").collect()
    assert {r[0] for r in packed} == {r["doc_id"] for r in inputs[names[4]].select("doc_id").collect()}


INTERNAL = ("d", "t", "set", "lead", "_lead", "_lead_text", "_text_key", "text_key", "root", "family", "copies", "class_id", "n_links", "place", "part", "ids", "kept")


def test_columns_of_any_name_stay_with_the_documents_kept(spark):
    rows = [(1, "one two three four five six", "x"), (2, "one two three four five six", "y"), (3, "another text altogether with six words", None)]
    own = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in INTERNAL:
        own = own.withColumn(name, F.concat(F.lit(name), F.col("doc_id")))
    kept = ngram_join.distinct_documents(own, settings=SMALL)
    assert kept.columns == own.columns
    assert sorted((r["doc_id"], r["d"], r["t"]) for r in kept.collect()) == [(1, "d1", "t1"), (3, "d3", "t3")]


def test_the_pipeline_takes_awkward_and_empty_tables(spark, awkward, nothing, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (8, 0, 1), (None, 1, None), (12, 0, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([("a", None), (None, "one two three four"), ("c", "")], "item_id string, text string")
    more = awkward
    for name in INTERNAL:
        if name not in more.columns:
            more = more.withColumn(name, F.lit("clash"))
    for folder, documents, own, bench in (("awkward", more, labels, items), ("empty", nothing, labels.limit(0), items.limit(0))):
        documents.write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        own.write.parquet(f"{tmp_path}/{folder}/labels.parquet")
        bench.write.parquet(f"{tmp_path}/{folder}/benchmark.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/awkward").collect()
    for _, length in {(r["doc_id"], r["doc_tokens"]) for r in found}:
        assert length > 0
    assert {r["doc_id"] for r in found} <= {r["doc_id"] for r in awkward.collect()}
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []


def test_tasks_contract_what_they_read_and_lose_no_link(spark, monkeypatch):
    draw = random.Random(6)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(260)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)] * 3
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    wanted = {(x, find(x)) for link in links for x in link if link[0] != link[1]}
    for held in (1 << 19, 8):
        monkeypatch.setattr("salesmart.llm.components.HELD", held)
        table = spark.createDataFrame(links, "x long, y long").repartition(5)
        assert set(map(tuple, components(table).collect())) == {w for w in wanted}
    assert components(table.limit(0)).collect() == []
