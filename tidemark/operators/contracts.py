"""Validation jobs. Each takes rows and returns ``(valid, quarantine)``; quarantined rows carry all
their errors. The rules are plain Columns, so the same functions run on a stream."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import checks
from tidemark.functions.canonical import payload_text, value_text
from tidemark.functions.checks import blank, rule
from tidemark.functions.identity import ascii_escaped, ascii_json, event_id, iso_text, plain_json
from tidemark.operators.catalog import FEATURE_IDS
from tidemark.session import settle
from tidemark.settings import (
    BALANCE_STATUSES,
    CREDIT_STATES,
    DOCUMENT_FLAGS,
    ENTITY_TYPES,
    EVENT_TYPES,
    LEAKAGE_RISKS,
    LINKAGES,
    SPLITS,
    STAGES,
    STREAM_SCHEMA_VERSION,
    STREAM_TABLES,
    TRAINING_SPLITS,
)

Routed = tuple[DataFrame, DataFrame]

# An ISO time with a zone. A time without one is not accepted.
ZONED_PATTERN = r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?)?([Zz]|[+-]\d{2}:?\d{2}(:?\d{2})?)\s*\z"


def zoned_time(c: Column) -> Column:
    """Timestamp of ISO text with a zone; NULL for anything else."""
    return F.when(c.rlike(ZONED_PATTERN), F.try_to_timestamp(F.trim(F.upper(c))))


def with_times(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text times become timestamps, timestamps stay. Bad text becomes NULL."""
    text = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    return df.withColumns({c: zoned_time(F.col(c)) for c in text})


def _not_in(column: str, words: list[str]) -> Column:
    return F.col(column).isNull() | ~F.col(column).isin(words)


def _required(columns: list[str]) -> list[Column]:
    return [rule(blank(F.col(c)), c, "must be non-empty") for c in columns]


def _required_times(columns: list[str]) -> list[Column]:
    return [rule(F.col(c).isNull(), c, "must be a time with zone") for c in columns]


def _outside_unit(column: str) -> Column:
    c = F.col(column)
    return c.isNotNull() & (F.isnan(c) | (c < 0) | (c > 1))


def expected_event_id() -> Column:
    c = F.col
    return event_id(
        c("dataset_id"), c("entity_type"), c("entity_id"), c("event_type"), c("event_time"),
        c("source_record_id"), c("source_record_revision"), c("payload_sha256"),
    )


def validate_events(df: DataFrame) -> Routed:
    """Events: identity, words, times, version, and an id that follows from the content.

    ``headers`` is a string map, so only NULL values can be wrong in it. A valid payload hash is
    returned in lower case.
    """
    df = with_times(df, ["event_time", "available_at", "ingested_at"])
    sha = F.col("payload_sha256")
    bad_sha = sha.isNotNull() & ~sha.rlike(checks.SHA_PATTERN)
    rows = df.withColumn("_bad_sha", bad_sha).withColumn("payload_sha256", F.when(~F.col("_bad_sha"), F.lower(sha)))
    rules = [
        *_required(["dataset_id", "event_id", "entity_id", "customer_id", "source_system"]),
        rule(_not_in("entity_type", ENTITY_TYPES), "entity_type", "unknown entity type"),
        rule(_not_in("event_type", EVENT_TYPES), "event_type", "unknown event type"),
        *_required_times(["event_time", "available_at", "ingested_at"]),
        rule(F.col("event_time") > F.col("available_at"), "event_time", "must not be after available_at"),
        rule(F.col("schema_version") < 1, "schema_version", "must be >= 1"),
        rule(F.col("_bad_sha"), "payload_sha256", "must be 64 hexadecimal characters"),
        rule(
            blank(F.col("source_record_id")) & F.col("payload_sha256").isNull(), "source_record_id",
            "record id or payload hash required",
        ),
        rule(F.exists(F.map_values("headers"), lambda v: v.isNull()), "headers", "values must be strings"),
        rule(F.col("event_id") != expected_event_id(), "event_id", "does not follow from the content"),
    ]
    valid, quarantine = checks.route(rows, rules)
    return valid.drop("_bad_sha"), quarantine.drop("_bad_sha")


def validate_points(df: DataFrame) -> Routed:
    """Prediction points: lineage per split, label range, label and label time together."""
    df = with_times(df, ["prediction_time", "label_time"])
    split, label, label_time = F.col("split"), F.col("label"), F.col("label_time")
    training = split.isin(TRAINING_SPLITS)
    rules = [
        *_required(["prediction_id", "entity_id"]),
        *_required_times(["prediction_time"]),
        rule(_not_in("split", SPLITS), "split", "unknown split"),
        rule(training & blank(F.col("snapshot_id")), "snapshot_id", "required for a training split"),
        rule(training & blank(F.col("boundary_version")), "boundary_version", "required for a training split"),
        rule((split == "online") & blank(F.col("boundary_version")), "boundary_version", "required online"),
        rule((split == "online") & (label.isNotNull() | label_time.isNotNull()), "label", "not allowed online"),
        rule(_outside_unit("label"), "label", "must be in [0, 1]"),
        rule(label.isNotNull() & label_time.isNull(), "label_time", "required with a label"),
        rule(label.isNull() & label_time.isNotNull(), "label", "required with a label time"),
        rule(label_time <= F.col("prediction_time"), "label_time", "must be after prediction_time"),
    ]
    return checks.route(df, rules)


def validate_catalog(df: DataFrame) -> Routed:
    """Feature catalog rows."""
    rules = [
        *_required([
            "feature_id", "feature_name", "entity_type", "feature_group", "source_system",
            "event_time_rule", "availability_rule",
        ]),
        rule(_not_in("stage", STAGES), "stage", "unknown stage"),
        rule(_not_in("leakage_risk", LEAKAGE_RISKS), "leakage_risk", "unknown leakage risk"),
        rule(F.col("ttl") <= 0, "ttl", "must be positive"),
        rule(F.col("version") < 1, "version", "must be >= 1"),
        rule((F.col("cost_unit") < 0) | F.isnan("cost_unit"), "cost_unit", "must be non-negative"),
        rule(F.exists("tags", lambda t: t.isNull()), "tags", "must be strings"),
    ]
    return checks.route(df, rules)


def _publishable_rules() -> list[Column]:
    return [
        rule(blank(F.col("owner")), "owner", "must be non-empty"),
        rule(F.coalesce("leakage_risk", F.lit("unknown")) == "unknown", "leakage_risk", "must be known"),
        rule(blank(F.col("lineage_expression")), "lineage_expression", "must be non-empty"),
        rule(blank(F.col("semantic_group_id")), "semantic_group_id", "must be set"),
        rule(F.col("online_available") & F.col("ttl").isNull(), "ttl", "required for an online feature"),
    ]


def publishable(df: DataFrame) -> Routed:
    """Catalog rows that may be published, and the others with the reasons."""
    return checks.route(df, _publishable_rules())


def catalog_closure(catalog: DataFrame, mapping: DataFrame) -> DataFrame:
    """Breaches between a catalog and its feature-to-group mapping; none means closed."""
    named = catalog.where(~blank(F.col("feature_id")))
    clean = mapping.where(~blank(F.col("feature_id")) & ~blank(F.col("group_id")))

    def breach(df: DataFrame, message: str) -> DataFrame:
        return df.select("feature_id", F.lit(message).alias("message"))

    pairs = named.join(clean, "feature_id")
    parts = [
        breach(named.groupBy("feature_id").count().where("count > 1"), "declared more than once"),
        breach(named.join(clean, "feature_id", "left_anti").distinct(), "has no group"),
        breach(clean.join(named, "feature_id", "left_anti").distinct(), "is not in the catalog"),
        breach(
            pairs.where(~blank(F.col("semantic_group_id")) & (F.col("semantic_group_id") != F.col("group_id"))),
            "belongs to another group",
        ),
        publishable(named)[1].select("feature_id", F.explode("errors").alias("e")).select(
            "feature_id", F.concat("e.field", F.lit(" "), "e.message").alias("message")
        ),
        named.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
            F.lit(None).cast("string").alias("feature_id"), F.lit("the catalog is empty").alias("message")
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def label_columns_agree(label: str | None, label_time: str | None) -> bool:
    """A label column needs a label-time column and the other way round."""
    return (label is None) == (label_time is None)


def validate_documents(df: DataFrame) -> Routed:
    """Document parse results."""
    df = with_times(df, ["linked_at", "processed_at"])
    linked = F.col("linkage_status").isin("verified", "synthetic")
    rules = [
        *_required(["document_id", "object_uri", "document_type"]),
        rule(
            F.col("content_sha256").isNull() | ~F.col("content_sha256").rlike(checks.SHA_PATTERN),
            "content_sha256", "must be 64 hexadecimal characters",
        ),
        rule(_not_in("linkage_status", LINKAGES), "linkage_status", "unknown linkage"),
        rule(linked & blank(F.col("entity_id")), "entity_id", "required for a linked document"),
        *_required_times(["processed_at"]),
        *[
            rule(_outside_unit(c), c, "must be in [0, 1]")
            for c in ("ocr_confidence", "field_coverage", "image_quality_score")
        ],
    ]
    valid, quarantine = checks.route(df, rules)
    return valid.withColumn("content_sha256", F.lower("content_sha256")), quarantine


def document_eligible(df: DataFrame, allow_synthetic: bool = False) -> DataFrame:
    """Documents a credit model may use: linked with full evidence, or synthetic where allowed."""
    evidence = ~blank(F.col("linkage_source")) & ~blank(F.col("linkage_version"))
    evidence = evidence & ~blank(F.col("linkage_evidence_uri")) & F.col("linked_at").isNotNull()
    verified = (F.col("linkage_status") == "verified") & evidence
    synthetic = (F.col("linkage_status") == "synthetic") & F.lit(allow_synthetic)
    return df.where(~blank(F.col("entity_id")) & (verified | synthetic))


# Payload fields by event type and kind, fixed values.
PAYLOAD_FIELDS = {
    "application_upsert": {
        "required": ["SK_ID_CURR"],
        "whole": ["DAYS_BIRTH"],
        "number": ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE",
                   "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"],
        "flag": DOCUMENT_FLAGS,
        "text": [],
    },
    "bureau_upsert": {
        "required": ["SK_ID_CURR", "SK_ID_BUREAU"],
        "whole": ["DAYS_CREDIT"],
        "number": ["AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_OVERDUE"],
        "flag": [],
        "text": ["CREDIT_ACTIVE"],
    },
    "bureau_balance_upsert": {
        "required": ["SK_ID_CURR", "SK_ID_BUREAU"],
        "whole": ["MONTHS_BALANCE"],
        "number": [],
        "flag": [],
        "text": ["STATUS"],
    },
}
TEXT_WORDS = {"CREDIT_ACTIVE": CREDIT_STATES, "STATUS": BALANCE_STATUSES}

def _sql_list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _one_of(value: str, words: list[str]) -> str:
    """The same as IN, which costs several times as much where expressions are not turned into code."""
    return "(" + " OR ".join(f"{value} = '{w}'" for w in words) + ")"


def with_payload_fields(df: DataFrame, kinds: list[str], payload: str = "payload", kind: str | None = None) -> DataFrame:
    """Parse a JSON payload once: the JSON type of every known field, the text of judged ones.

    The columns are temporary (``without_payload_fields``); rules then only compare strings. With a
    ``kind`` column only the fields of a row's own kind are looked up.
    """
    owners: dict[str, list[str]] = {}
    for k in kinds:
        for group in PAYLOAD_FIELDS[k].values():
            for field in group:
                owners.setdefault(field, []).append(k)
    judged = {f for k in kinds for f in PAYLOAD_FIELDS[k]["flag"] + PAYLOAD_FIELDS[k]["text"]}

    def lookup(fields: list[str], value: str) -> Column:
        def own(f: str) -> str:
            found = value.format(f"try_variant_get(_doc, '$.{f}'")
            return f"CASE WHEN {_one_of(kind, owners[f])} THEN {found} END" if kind else found

        pairs = ["'_', ''"] + [f"'{f}', {own(f)}" for f in fields]
        # Through an array of one: as generated code the lookups of many fields are one method, too long for the JVM to compile.
        return F.expr(f"transform(array(named_struct({', '.join(pairs)})), x -> x)[0]")

    parsed = df.withColumn("_doc", F.try_parse_json(F.col(payload)))
    return parsed.withColumns({
        "_keys": F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")),
        "_types": lookup(list(owners), "schema_of_variant({}, 'variant'))"),
        "_texts": lookup([f for f in owners if f in judged], "{}, 'string')"),
    })


def without_payload_fields(df: DataFrame) -> DataFrame:
    return df.drop("_doc", "_keys", "_types", "_texts")


def _payload_rules(kind: str, payload: str, words: dict[str, list[str]]) -> list[tuple[str, str, str]]:
    """What breaks a payload parsed by ``with_payload_fields``: SQL text, field, message.

    Values are judged by their JSON type. There are many rules, and they all have the same few forms.
    """
    fields = PAYLOAD_FIELDS[kind]
    known = fields["required"] + fields["whole"] + fields["number"] + fields["flag"] + fields["text"]
    numeric = "(_types.{0} IN ('BIGINT', 'DOUBLE') OR startswith(_types.{0}, 'DECIMAL'))"
    present = "coalesce(_types.{0}, 'VOID') != 'VOID'"
    forms = {
        "is required": ("_doc IS NOT NULL AND NOT " + present, fields["required"]),
        "must be a whole number": (present + " AND _types.{0} != 'BIGINT'", fields["required"] + fields["whole"]),
        "must be a number": (present + " AND NOT " + numeric, fields["number"]),
        "must be 0 or 1": (
            present + " AND NOT (" + numeric + " AND coalesce(_texts.{0}, '') IN ('0', '1', '0.0', '1.0'))", fields["flag"]
        ),
        "unknown word": (
            present + " AND NOT (_types.{0} = 'STRING' AND _texts.{0} IN ({1}))", fields["text"]
        ),
    }
    broken = [("_doc IS NULL", payload, "must be a JSON object")]
    for message, (form, names) in forms.items():
        broken += [(form.format(f, _sql_list(words.get(f, []))), f, message) for f in names]
    broken.append((f"size(array_except(_keys, array({_sql_list(known)}))) > 0", payload, "has unknown fields"))
    return broken


def payload_errors(kind: str, payload: str = "payload", words: dict[str, list[str]] = TEXT_WORDS) -> Column:
    """Errors of a payload parsed by ``with_payload_fields``."""
    rules = [
        f"CASE WHEN {bad} THEN array(named_struct('field', '{field}', 'message', '{message}')) "
        f"ELSE cast(array() AS {checks.ERRORS}) END"
        for bad, field, message in _payload_rules(kind, payload, words)
    ]
    return F.expr(f"flatten(array({', '.join(rules)}))")


def payload_broken(kind: str, payload: str = "payload", words: dict[str, list[str]] = TEXT_WORDS) -> Column:
    """Whether a payload has any of these errors; the first one decides."""
    return F.expr(" OR ".join(f"coalesce({bad}, false)" for bad, _, _ in _payload_rules(kind, payload, words)))


def validate_payloads(df: DataFrame, kind: str, payload: str = "payload", words: dict = TEXT_WORDS) -> Routed:
    valid, quarantine = checks.route(with_payload_fields(df, [kind], payload), [payload_errors(kind, payload, words)])
    return without_payload_fields(valid), without_payload_fields(quarantine)


# A balance payload holds whole numbers and a word only, so its canonical text needs no Python. Its
# fields in the order of their names, fixed values.
BALANCE_FIELDS = "MONTHS_BALANCE bigint, SK_ID_BUREAU bigint, SK_ID_CURR bigint, STATUS string"
BALANCE_KIND = "bureau_balance_upsert"


# A balance payload in its canonical form: fields in order, no spaces, whole numbers of at most 18 digits.
_WHOLE = "(0|-?[1-9][0-9]{0,17})"


def plain_balance(words: list[str] = BALANCE_STATUSES) -> Column:
    """Whether ``payload`` is a balance in canonical form with one of ``words``, as nearly all are.

    Such a payload is its own canonical text and keeps every rule of its kind, so it need not be parsed. Words with other
    characters than letters and digits are left to the rules.
    """
    known = "|".join(w for w in words if re.fullmatch("[0-9A-Za-z]+", w)) or "(?!)"
    form = f'^\\{{"MONTHS_BALANCE":{_WHOLE},"SK_ID_BUREAU":{_WHOLE},"SK_ID_CURR":{_WHOLE},"STATUS":"({known})"\\}}\\z'
    return F.coalesce(F.col("payload").rlike(form), F.lit(False))


def canonical_payload(balance: bool | None = None) -> Column:
    """Canonical text of ``payload``; where all rows are balances, or none is, say so.

    Balances, by far the most rows, then never meet Python.
    """
    written = F.to_json(F.from_json("payload", BALANCE_FIELDS))
    own, other = F.when(plain_balance(), F.col("payload")).otherwise(written), payload_text("event_type", "payload")
    if balance is not None:
        return own if balance else other
    is_balance = F.coalesce(F.col("event_type") == BALANCE_KIND, F.lit(False))
    return F.when(is_balance, own).otherwise(payload_text("event_type", F.when(~is_balance, F.col("payload"))))


def expected_envelope_id(balance: bool | None = None) -> Column:
    """``sha256:`` id of table, key, time, operation and the canonical payload.

    A payload that is its own canonical text is ASCII without escapes, so its array needs no more than its quotes escaped.
    """
    table, pk, time, op = F.col("source_table"), F.col("source_pk"), iso_text(F.col("event_time")), F.col("op")
    parts = ascii_json(table, pk, time, op, ascii_escaped(canonical_payload(balance)))
    if balance is not False:
        plain = plain_balance() & (F.lit(True) if balance else F.col("event_type") == BALANCE_KIND)
        parts = F.coalesce(F.when(plain, plain_json(table, pk, time, op, F.col("payload"))), parts)
    return F.concat(F.lit("sha256:"), F.sha2(parts, 256))


# A record payload as its writer gives it: nulls left out, amounts with a fraction of at most four places and few enough
# digits that Python writes a double of that text as the same text, but for zeros at the end, which are not taken.
_AMOUNT = r"-?(?:0|[1-9][0-9]{0,9})[.](?:0|[0-9]{0,3}[1-9])"
_RECORD = (("SK_ID_CURR", _WHOLE), ("SK_ID_BUREAU", _WHOLE), ("DAYS_CREDIT", _WHOLE), ("CREDIT_ACTIVE", ""), ("AMT_CREDIT_SUM", f"({_AMOUNT})"))
_SECOND = "([12]DDD-DD-DDTDD:DD:DD)".replace("D", "[0-9]")  # a repetition of fixed length costs more than its parts
_UNIT = "\x1f"
_BAD_SHA, _BAD_ID = "must be sha256: and 64 hexadecimal characters", "does not follow from the content"


def _record_form(q: str) -> str:
    record = ",".join(f"{q}{c}{q}:{form or q + '([0-9A-Za-z]+)' + q}" for c, form in _RECORD)
    return record + f"(,{q}AMT_CREDIT_SUM_DEBT{q}:{_AMOUNT})?,{q}AMT_CREDIT_SUM_OVERDUE{q}:({_AMOUNT})"


def with_envelope_ids(df: DataFrame) -> DataFrame:
    """Envelopes with the id that follows from their content. Records in the form above never meet Python."""
    form = f'^\\{{{_record_form(chr(34))}\\}}\\z'
    own = F.coalesce((F.col("event_type") == "bureau_upsert") & F.col("payload").rlike(form), F.lit(False))
    text = F.regexp_replace(
        "payload", form, '{"AMT_CREDIT_SUM":$5$6,"AMT_CREDIT_SUM_OVERDUE":$7,"CREDIT_ACTIVE":"$4","DAYS_CREDIT":$3,"SK_ID_BUREAU":$2,"SK_ID_CURR":$1}')
    parts = ("source_table", "source_pk", iso_text(F.col("event_time")), "op", text)
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    plain = F.concat(F.lit("sha256:"), F.sha2(F.coalesce(plain_json(*columns), ascii_json(*columns[:-1], ascii_escaped(text))), 256))
    return df.where(own).withColumn("event_id", plain).unionByName(df.where(~own).withColumn("event_id", expected_envelope_id()))


def _written_form() -> str:
    """The whole text of a message that holds a balance or a record as their writers give them.

    All rules hold for such a message but those on its times, its id, and the word in its payload, which are still to be judged.
    The empty groups 2 and 4 say which table was named: a reference to the other one fails.
    """
    q = r'\\"'
    whole = _WHOLE.replace("(", "(?:")
    balance = ",".join(f"{q}{c}{q}:{whole}" for c in ("MONTHS_BALANCE", "SK_ID_BUREAU", "SK_ID_CURR")) + f",{q}STATUS{q}:{q}([0-9A-Za-z]+){q}"
    record = _record_form(q)
    return (
        f'^\\{{"schema_version":{STREAM_SCHEMA_VERSION},"event_type":"(?:{BALANCE_KIND}","source_table":"(bureau_balance)()|bureau_upsert","source_table":"(bureau)())"'
        rf',"source_pk":"([0-9A-Za-z:-]+)","entity_id":"(SK_ID_CURR:[0-9]+)","op":"UPSERT","event_time":"{_SECOND}[.]000000Z","produced_at":"{_SECOND}[.]000000Z"'
        rf',"payload":"(\2\{{{balance}\}}|\4\{{{record}\}})","event_id":"(sha256:[0-9a-f]+)"\}}\z'
    )


def mark_written(raw: DataFrame, words: dict[str, list[str]] = TEXT_WORDS) -> tuple[DataFrame, DataFrame]:
    """Messages (topic, value) in the form that their writers give them as envelopes with their ``errors``, and the other messages.

    Nearly all messages have that form. Their fields come from one regular expression, no JSON is parsed and no Python met.
    """
    form = _written_form()
    own = F.coalesce(F.col("value").rlike(form), F.lit(False))
    order = ("1$3", "5", "6", "7", "8", "9", "18", "11", "12", "13", "10$14", "15$16", "17")  # groups of the form
    parts = F.split(F.regexp_replace("value", form, _UNIT.join(f"${n}" for n in order)), _UNIT)
    rows = raw.where(own).select("topic", "value", parts.alias("_m"))
    m = [F.get("_m", F.lit(i)) for i in range(len(order))]
    quoted = F.concat(
        F.lit(r'{\"AMT_CREDIT_SUM\":'), m[11], F.lit(r',\"AMT_CREDIT_SUM_OVERDUE\":'), m[12], F.lit(r',\"CREDIT_ACTIVE\":\"'), m[10],
        F.lit(r'\",\"DAYS_CREDIT\":'), m[9], F.lit(r',\"SK_ID_BUREAU\":'), m[8], F.lit(r',\"SK_ID_CURR\":'), m[7], F.lit("}"))
    timed = rows.select(
        "topic", "value", m[6].alias("event_id"), F.lit(STREAM_SCHEMA_VERSION).alias("schema_version"), F.concat(m[0], F.lit("_upsert")).alias("event_type"),
        m[0].alias("source_table"), m[1].alias("source_pk"), m[2].alias("entity_id"), F.lit("UPSERT").alias("op"),
        F.try_to_timestamp(F.concat(m[3], F.lit("Z"))).alias("event_time"), F.try_to_timestamp(F.concat(m[4], F.lit("Z"))).alias("produced_at"),
        F.replace(m[5], F.lit('\\"'), F.lit('"')).alias("payload"), m[3].alias("_time"), m[10].alias("_word"), F.when(m[0] == "bureau", quoted).otherwise(m[5]).alias("_quoted"),
    )
    time = F.when(F.col("event_time").isNull(), "null").otherwise(F.concat(F.lit('"'), "_time", F.lit('+00:00"')))
    text = F.concat(F.lit('["'), "source_table", F.lit('","'), "source_pk", F.lit('",'), time, F.lit(',"UPSERT","'), "_quoted", F.lit('"]'))
    judged = timed.withColumn("_same", F.col("event_id") == F.concat(F.lit("sha256:"), F.sha2(text, 256))).drop("_time", "_quoted")
    known = F.when(F.col("source_table") == "bureau", F.col("_word").isin(words.get("CREDIT_ACTIVE", []))).otherwise(F.col("_word").isin(words.get("STATUS", [])))
    # In the order of the rules on envelopes. They are few, so as one method they are short enough; see ``checks.with_errors`` on the generator.
    errors = F.concat(
        rule(~F.col("_same") & ~F.col("event_id").rlike(checks.PREFIXED_SHA_PATTERN), "event_id", _BAD_SHA),
        *_required_times(["event_time", "produced_at"]), rule(~known, "payload", "does not fit the event type"), rule(~F.col("_same"), "event_id", _BAD_ID))
    return judged.select("*", F.inline(F.array(F.struct(errors.alias("errors"))))).drop("_same", "_word"), raw.where(~own)


def mark_envelopes(df: DataFrame, words: dict[str, list[str]] = TEXT_WORDS) -> DataFrame:
    """Stream envelopes with their ``errors``. The payload is JSON text and must fit the event type.

    ``words`` widens or narrows the accepted words of text fields. Balances are judged apart from the
    rest, so each side parses its payloads once, for its own fields, and balances never meet Python. A batch is
    written once before it is read by both sides.
    """
    rows = df if df.isStreaming else settle(df, "envelopes")
    is_balance = F.coalesce(F.col("event_type") == BALANCE_KIND, F.lit(False))
    others = [k for k in STREAM_TABLES if k != BALANCE_KIND]
    return _marked(rows.where(is_balance), [BALANCE_KIND], words).unionByName(_marked(rows.where(~is_balance), others, words))


def _marked(df: DataFrame, kinds: list[str], words: dict[str, list[str]]) -> DataFrame:
    df = with_times(df, ["event_time", "produced_at"]).withColumn("_expected_id", expected_envelope_id(None if len(kinds) == len(STREAM_TABLES) else kinds == [BALANCE_KIND]))
    only_balances = kinds == [BALANCE_KIND]
    df = df.withColumn("_plain", plain_balance(words.get("STATUS", [])) if only_balances else F.lit(False))
    df = with_payload_fields(df.withColumn("_judged", F.when(~F.col("_plain"), F.col("payload"))), kinds, "_judged", None if only_balances else "event_type")
    table_of = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(t)) for k, t in STREAM_TABLES.items()])
    bad_payload = F.lit(False)
    for kind in kinds:
        bad_payload = F.when(F.col("event_type") == kind, ~F.col("_plain") & payload_broken(kind, words=words)).otherwise(bad_payload)
    rules = [
        rule(~F.coalesce(F.col("event_id").rlike(checks.PREFIXED_SHA_PATTERN), F.lit(False)), "event_id",
             _BAD_SHA),
        rule(F.coalesce(F.col("schema_version"), F.lit(0)) != STREAM_SCHEMA_VERSION, "schema_version", "unknown version"),
        rule(~F.coalesce(F.col("entity_id").rlike(checks.ENTITY_PATTERN), F.lit(False)), "entity_id",
             "must be SK_ID_CURR: and digits"),
        *_required_times(["event_time", "produced_at"]),
        rule(_not_in("source_table", list(STREAM_TABLES.values())), "source_table", "unknown table"),
        rule(table_of.isNull(), "event_type", "unknown event type"),
        rule(F.coalesce("op", F.lit("")) != "UPSERT", "op", "unknown operation"),
        rule(table_of != F.col("source_table"), "event_type", "does not fit the table"),
        rule(bad_payload, "payload", "does not fit the event type"),
        rule(F.coalesce(F.col("event_id") != F.col("_expected_id"), F.lit(True)), "event_id", _BAD_ID),
    ]
    return without_payload_fields(checks.with_errors(df, rules)).drop("_expected_id", "_plain", "_judged")


def mark_mixed(df: DataFrame, words: dict[str, list[str]] = TEXT_WORDS) -> DataFrame:
    """The same in one pass over ``df``, for few rows out of many: there a second look at all costs more than what it saves."""
    return _marked(df, list(STREAM_TABLES), words)


def validate_envelopes(df: DataFrame, words: dict[str, list[str]] = TEXT_WORDS) -> Routed:
    return checks.split(mark_envelopes(df, words))


def feature_update_id(entity: Column, feature: Column, version: Column, time: Column, value: Column) -> Column:
    texts = (entity, feature, version.cast("string"), iso_text(time), value_text(value))
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(plain_json(*texts), ascii_json(*texts)), 256))


def validate_updates(df: DataFrame, topics: list[str], features: list[str] = FEATURE_IDS) -> Routed:
    """Feature updates. The id is compared only where the feature is known and the value finite."""
    df = with_times(df, ["event_time", "computed_at"])
    c = F.col
    value = c("feature_value")
    finite = value.isNull() | ~(F.isnan(value) | (F.abs(value) == float("inf")))
    df = df.withColumn("_expected_id", feature_update_id(
        c("entity_id"), c("feature_id"), c("feature_version"), c("event_time"), value
    ))
    known = c("feature_id").isin(features)

    def lacks(column: str, pattern: str) -> Column:
        return ~F.coalesce(c(column).rlike(pattern), F.lit(False))

    rules = [
        rule(lacks("entity_id", checks.ENTITY_PATTERN), "entity_id", "must be SK_ID_CURR: and digits"),
        rule(~F.coalesce(known, F.lit(False)), "feature_id", "not in the catalog"),
        rule(F.coalesce(c("feature_version"), F.lit(0)) <= 0, "feature_version", "must be positive"),
        *_required_times(["event_time", "computed_at"]),
        rule(c("computed_at") < c("event_time"), "computed_at", "must not be before event_time"),
        rule(lacks("source_event_id", checks.PREFIXED_SHA_PATTERN), "source_event_id", "malformed"),
        rule(~F.coalesce(c("source_topic").isin(topics), F.lit(False)), "source_topic", "unknown topic"),
        rule(~finite, "feature_value", "must be finite or missing"),
        rule(lacks("feature_update_id", checks.PREFIXED_SHA_PATTERN), "feature_update_id", "malformed"),
        rule(_not_in("computation_mode", ["stream"]), "computation_mode", "unknown mode"),
        rule(_not_in("quality_status", ["VALID", "INVALID"]), "quality_status", "unknown status"),
        rule(known & finite & F.coalesce(c("feature_update_id") != c("_expected_id"), F.lit(True)),
             "feature_update_id", "does not follow from the content"),
    ]
    valid, quarantine = checks.route(df, rules)
    return valid.drop("_expected_id"), quarantine.drop("_expected_id")


def spec_closure(catalog: DataFrame, specs: DataFrame) -> DataFrame:
    """Breaches between catalog and computation specs; none means closed."""
    tables = list(STREAM_TABLES.values())

    def breach(df: DataFrame, message: str) -> DataFrame:
        return df.select("feature_id", F.lit(message).alias("message"))

    parts = [
        breach(catalog.join(specs, "feature_id", "left_anti"), "has no spec"),
        breach(specs.join(catalog, "feature_id", "left_anti"), "is not in the catalog"),
        breach(specs.where(blank(F.col("batch_ref"))), "has no batch implementation"),
        breach(specs.where(blank(F.col("expression_sql"))), "has no stream expression"),
        breach(specs.where(_not_in("source_table", tables)), "has an unknown source"),
        breach(
            specs.where(F.col("source_table").isin(tables[1:]) & blank(F.col("input_filter_sql"))),
            "has no temporal filter",
        ),
    ]
    return reduce(DataFrame.unionByName, parts)
