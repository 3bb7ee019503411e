"""What the jobs cost a row: what the JVM compiles, what is parsed, what a group of the state opens."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.functions.checks import ERRORS
from tidemark.operators import contracts
from tidemark.streaming.flow import parse_messages


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plain_balances_are_their_own_text(spark):
    """The payloads that are not parsed are those which a parser would write the same and which keep all rules."""
    fields = {"MONTHS_BALANCE": -3, "SK_ID_BUREAU": 7, "SK_ID_CURR": 1, "STATUS": "C"}
    plain = json.dumps(fields, separators=(",", ":"))
    others = [None, "", "{}", json.dumps(fields), plain + "\n", plain + " ", "x" + plain, plain.replace("-3", "-0"), plain.replace("-3", "03"),
              plain.replace("-3", "3.0"), plain.replace("-3", "1" * 19), plain.replace('"C"', '"9"'), plain.replace('"C"', "null"), plain[:-1] + ',"X":1}',
              plain.replace("-3", "٣")]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate([plain, plain.replace("-3", "0"), *others])], "i int, payload string")
    found = rows.select("i", "payload", contracts.plain_balance().alias("plain"), contracts.plain_balance(["Sold's", "C"]).alias("other_words")).collect()
    assert [r.i for r in found if r.plain] == [0, 1] and [r.i for r in found if r.other_words] == [0, 1]
    written = F.to_json(F.from_json("payload", contracts.BALANCE_FIELDS))
    judged = contracts.with_payload_fields(rows.where("i < 2"), [contracts.BALANCE_KIND])
    for r in judged.select("payload", written.alias("w"), contracts.payload_errors(contracts.BALANCE_KIND).alias("e")).collect():
        assert r.w == r.payload and r.e == []


def test_a_broken_payload_is_one_with_errors(spark):
    texts = ["{}", "no", "[1]", '{"SK_ID_CURR":1}', '{"SK_ID_CURR":1,"SK_ID_BUREAU":2}', '{"SK_ID_CURR":1,"SK_ID_BUREAU":"2"}', None,
             '{"SK_ID_CURR":1,"FLAG_DOCUMENT_2":true}', '{"SK_ID_CURR":1,"SK_ID_BUREAU":2,"CREDIT_ACTIVE":"Sold"}', '{"SK_ID_CURR":1,"Y":2}']
    rows = spark.createDataFrame([(t,) for t in texts], "payload string")
    for kind in contracts.PAYLOAD_FIELDS:
        judged = contracts.with_payload_fields(rows, [kind])
        for r in judged.select("payload", contracts.payload_errors(kind).alias("e"), contracts.payload_broken(kind).alias("b")).collect():
            assert r.b == (len(r.e) > 0), (kind, r.payload)


def test_a_message_is_parsed_once(spark):
    """A filter on a field does not parse the message again; text that is no message still gives a row."""
    raw = spark.range(3).select(F.lit("t").alias("topic"), F.lit("k").alias("key"), F.expr("element_at(array('{}', 'no', '{\"op\":\"x\"}'), int(id + 1))").alias("value"))
    parsed = parse_messages(raw)
    assert plan_of(parsed.where("coalesce(event_type = 'x', false)")).count("from_json") == 1
    assert {(r.value, r.op) for r in parsed.collect()} == {("{}", None), ("no", None), ('{"op":"x"}', "x")}


def test_rules_are_not_one_method(spark):
    """Rules and lookups stand behind functions that Spark evaluates without generated code."""
    rows = spark.createDataFrame([(None,)], f"errors {ERRORS}")
    many = contracts.checks.errors_of([contracts.rule(F.size("errors") >= i, "f", str(i)) for i in range(3)])
    assert "lambdafunction" in plan_of(rows.select(many.alias("e")))
    assert "lambdafunction" in plan_of(contracts.with_payload_fields(rows.select(F.lit("{}").alias("payload"), "errors").where("rand() >= 0"), ["bureau_upsert"]))
