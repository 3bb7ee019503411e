"""What the streams keep on disk: texts once and compressed, a batch's own rows over those of the batch before."""

from __future__ import annotations

import os
import re
from urllib.parse import urlparse

from pyspark.sql import functions as F

from tidemark.plans import stream_queries
from tidemark.sources.topics import read_events, write_updates
from tidemark.streaming import state

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def bytes_of(df) -> int:
    return sum(os.path.getsize(urlparse(f).path) for f in df.inputFiles())


def test_messages_are_dealt_before_they_are_text(spark):
    """Rows are a tenth of their text, which is not shuffled any more; each table has its share of the files."""
    files = stream_queries._files_of_tables(spark, FOLDER)
    assert sum(files) >= 2 * stream_queries.BATCHES and files[2] > files[1] >= files[0] == 1
    plan = stream_queries.messages(spark, FOLDER, files)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert len(dealt) >= 3 and not any(re.search("(value|payload|event_id)#", line) for line in dealt)
    plain, some = (df.select("topic", "key", "value").collect() for df in (stream_queries.messages(spark, FOLDER), stream_queries.messages(spark, FOLDER, files)))
    assert sorted(map(tuple, plain)) == sorted(map(tuple, some))


def test_intake_writes_little(spark):
    """A judged message takes little more than the bytes of its id and its two keys."""
    marked = spark.read.parquet(stream_queries._intake(spark, FOLDER).path("marked"))
    assert marked.count() == sum(stream_queries._rows(spark, FOLDER))
    assert bytes_of(marked.select("event_id")) < 90 * marked.count()


def test_kept_rows_are_read_back():
    sha = "sha256:" + "0a" * 32
    held = {"bureau": {"1": [5, sha, "t", '{"a":1}'], "2": [-7, sha.upper(), "t", "\u00e9"], "3": [9, "sha256:0a", "u", ""]},
            "bureau_balance": {"1:-2": [1 << 50, sha[:-2] + "ff", "v", "{}"]}}
    assert state._held(state._kept(held)) == held and state._held(None) == {}
    many = {"bureau": {str(i): [i, "sha256:" + os.urandom(32).hex(), "t", '{"a":1}'] for i in range(100)}}
    assert state._held(state._kept(many)) == many and len(state._kept(many)) < 100 * 38


def touched(spark, pks):
    rows = [("SK_ID_CURR:1", "bureau", str(pk), f"sha256:{pk:064d}", "credit.bureau.v1", pk, '{"SK_ID_CURR":1,"DAYS_CREDIT":-1,"AMT_CREDIT_SUM":%d.0}' % pk,
             "on_time", False, True) for pk in pks]
    return spark.createDataFrame(rows, state.TOUCHED_COLUMNS)


def test_a_batch_writes_over_the_rows_of_the_one_before(spark, tmp_path):
    tables = state.StreamTables(str(tmp_path))
    for batch_id, pks in enumerate(([1, 2, 3], [4, 5])):
        state.process_touched(touched(spark, pks), batch_id, tables)
    assert {r.source_pk for r in spark.read.parquet(tables.path("touched")).collect()} == {"4", "5"}
    updates = state.read_batches(spark, tables, "updates", state.UPDATE_COLUMNS).select("batch").collect()
    assert {r.batch for r in updates} == {0, 1}
    state.process_touched(touched(spark, [4, 5]), 1, tables)  # done again
    assert state.read_batches(spark, tables, "updates", state.UPDATE_COLUMNS).count() == len(updates)
    whole, some = state.latest_values(spark, tables), state.latest_values(spark, tables, ["feature_value"])
    assert some.columns == ["entity_id", "feature_id", "feature_value"]
    key = lambda df: sorted(map(tuple, df.select(*some.columns).collect()), key=repr)
    assert key(whole) == key(some) and some.where(F.col("feature_id") == "bureau.credit_sum_total").first().feature_value == 9.0


def test_outgoing_messages_are_compressed(spark, tmp_path):
    rows = spark.range(5000).select(F.lit("SK_ID_CURR:1").alias("entity_id"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    write_updates(rows.coalesce(1), str(tmp_path / "out"), "t")
    sent = read_events(spark, str(tmp_path / "out"), stream=False)
    assert sent.count() == 5000 and bytes_of(sent) < 50 * 5000
