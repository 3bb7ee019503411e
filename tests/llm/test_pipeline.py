"""The pipeline's stages, each against plain Python on what it was given, and the registered queries."""

from __future__ import annotations

import collections
import os

import duckdb
import pytest
from pyspark.sql import functions as F
from tests.llm import plain
from tests.llm.test_native_operators import SCHEMA, documents
from tests.llm.test_text_operators import near_texts

import corpus_pipeline
from tidemark.llm import queries
from tidemark.session import settle

SMALL = "/root/testdata/sf0.001"


def fixture():
    texts = near_texts(7)
    secret = "token = 0123456789abcdef0123456789abcdef"
    texts += [" ".join(f"{c}{i}" for i in range(70)) + f" {secret} and {secret}" for c in "pqrs"]
    return texts + ["same words again " * 40, " ".join(f"long{i}" for i in range(3000))]


def test_stages_against_plain_python(spark):
    texts = fixture()
    docs = documents(spark, texts, extra=False).withColumn("kept", F.lit("mine")).withColumn("size", F.lit(None).cast("int"))
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "secret scans", "source mixing", "best-fit packing"]

    good = settle(stages["quality rules"](spark, docs, SMALL), "t1")
    assert good.columns == names
    rows = {r["doc_id"]: r for r in good.collect()}
    assert sorted(rows) == [i for i, t in enumerate(texts) if not plain.base_failed(t)]
    assert all(r["text"] == texts[i] and r["kept"] == "mine" for i, r in rows.items())

    single = settle(stages["near-duplicates"](spark, good, SMALL), "t2")
    assert single.columns == names
    ids = sorted(rows)
    classes = plain.near_classes(ids, [texts[i] for i in ids])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(classes.values()))

    clean = settle(stages["secret scans"](spark, single, SMALL), "t3")
    assert clean.columns == names
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    changed = 0
    for r in clean.collect():
        hit = plain.base_spans(before[r["doc_id"]])
        changed += bool(hit)
        assert (r["text"] != before[r["doc_id"]]) == bool(hit) and not plain.base_spans(r["text"])
        assert not hit or r["n_chars"] == len(r["text"])
    assert changed and clean.count() == single.count()

    mixed = settle(stages["source mixing"](spark, clean, SMALL), "t4")
    assert mixed.columns == names
    size = {r["doc_id"]: (r["source"], plain.counts(r["text"])["n_words"]) for r in clean.collect()}
    copies, total, taken = collections.Counter(r["doc_id"] for r in mixed.collect()), collections.Counter(), collections.Counter()
    for d, (s, n) in size.items():
        total[s] += n
        taken[s] += n * copies[d]
    want = plain.targets(total)
    assert max(copies.values()) <= 2 and all(abs(taken[s] - want[s]) <= max(n for _, n in size.values()) / 2 + 1 for s in total)

    packed = stages["best-fit packing"](spark, mixed, SMALL).collect()
    bins = collections.defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for content in bins.values():
        content.sort()
        assert [o for o, _ in content] == [sum(n for _, n in content[:i]) for i in range(len(content))] and sum(n for _, n in content) <= 2048
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == copies
    assert len(bins) <= -(-sum(r["length"] for r in packed) // 2048) + 1


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_tables(spark, stage):
    """Nothing at all, NULL in every column, and repeated rows."""
    name, run = corpus_pipeline.STAGES[stage]
    words = " ".join(f"w{i}" for i in range(60))
    odd = spark.createDataFrame([(None,) * 5, (None,) * 5, (1, words, None, "a", None), (1, words, None, "a", None), (2, "", "en", None, 0)], SCHEMA)
    assert run(spark, odd.limit(0), SMALL).count() == 0
    rows = run(spark, odd, SMALL)
    count = rows.count()
    if name == "quality rules":
        assert count == 2  # both rows of document 1
    elif name == "near-duplicates":
        assert count == 4  # one row of document 1, and all that have no word
    elif name == "secret scans":
        assert sorted(map(repr, rows.collect())) == sorted(map(repr, odd.collect()))
    elif name == "source mixing":
        assert {r["doc_id"] for r in rows.collect()} <= {1}
    else:
        assert count == 5


def test_whole_pipeline(spark):
    packed = corpus_pipeline.run(spark, SMALL)
    assert packed.count() > 100 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", list(queries.load()))
def test_query(spark, name):
    entry = queries.load()[name]
    df = entry.run(spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    assert got
    if entry.sql is None:
        return
    db = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "benchmark", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(SMALL, table)}.parquet'")
    result = db.sql(f"SELECT {', '.join(df.columns)} FROM ({entry.sql})")
    assert sorted(map(repr, got)) == sorted(map(repr, result.fetchall()))
