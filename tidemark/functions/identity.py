"""Ids, hashes and times as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.settings import Boundary

# Control characters whose JSON escape holds a hex letter. Spark writes the letter in upper case,
# the canonical form in lower case. Fixed values.
LETTER_ESCAPES = ["000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F"]


# What is cut from both ends of a text. Fixed value.
WHITESPACE = " \t\n\r\x0b\x0c"


def _lower_escapes(text: Column) -> Column:
    def fix(c: Column, code: str) -> Column:
        # An escape starts at a backslash preceded by an even run of backslashes.
        return F.regexp_replace(c, rf"(?<!\\)((?:\\\\)*)\\u{code}", rf"$1\\u{code.lower()}")

    return F.when(F.contains(text, F.lit("\\u00")), reduce(fix, LETTER_ESCAPES, text)).otherwise(text)


def canonical_json(*parts: Column) -> Column:
    """Compact JSON array of string parts; NULL parts are written as ``null``."""
    return _lower_escapes(F.to_json(F.array(*[p.cast("string") for p in parts])))


def ascii_json(*parts: Column) -> Column:
    """The same in ASCII. The array is written once, where Spark would write it once for each place that reads it."""
    text = F.to_json(F.array(*[p.cast("string") for p in parts]))
    return ascii_escaped(F.transform(F.array(text), _lower_escapes)[0])


def ascii_escaped(text: Column) -> Column:
    """JSON text with every character beyond ASCII as an escape of its UTF-16 units."""
    beyond = r"[^\x00-\x7E]"  # DEL is escaped too

    def plain(c: Column) -> Column:
        return (F.octet_length(c) == F.char_length(c)) & ~F.contains(c, F.lit("\x7f"))

    def escaped(c: Column) -> Column:
        units = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        return F.when(c.rlike(beyond), F.regexp_replace(units, "(.{4})", r"\\u$1")).otherwise(c)

    # Through an array of one, so that the text is made once.
    return F.transform(F.array(text), lambda t: F.when(
        ~plain(t), F.array_join(F.transform(F.split(t, ""), escaped), "")).otherwise(t))[0]


def plain_json(*parts: Column) -> Column:
    """The same where every part but the last one has only letters, digits and ``_:.+-``, and the last one is ASCII without
    backslashes and control characters; NULL elsewhere. Nothing but its quotes is escaped then."""
    head = F.concat_ws('","', *parts[:-1])
    plain = head.rlike('^[0-9A-Za-z_:.+",-]*\\z')
    for part in parts[:-1]:
        plain = plain & part.isNotNull() & ~F.contains(part, F.lit('"')) & ~F.contains(part, F.lit(","))
    text = F.concat(F.lit('["'), head, F.lit('","'), F.replace(parts[-1], F.lit('"'), F.lit('\\"')), F.lit('"]'))
    return F.when(plain, text)


def canonical_id(*parts: Column) -> Column:
    return F.sha2(canonical_json(*parts), 256)


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the row as a compact JSON object in column order, NULLs kept."""
    whole = F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    return F.sha2(_lower_escapes(F.to_json(whole, {"ignoreNullFields": "false"})), 256)


def trimmed(c: Column) -> Column:
    return F.btrim(c.cast("string"), F.lit(WHITESPACE))


def normalize_id(c: Column) -> Column:
    """Decimal digits without leading zeros; NULL where the value is no id."""
    text = trimmed(c)
    digits = F.coalesce(F.nullif(F.ltrim(text, F.lit("0")), F.lit("")), F.lit("0"))
    return F.when(text.rlike(r"^[0-9]+\z"), digits)


def entity_id(c: Column, prefix: str = "SK_ID_CURR") -> Column:
    return F.concat(F.lit(f"{prefix}:"), normalize_id(c))


def entity_number(entity: Column) -> Column:
    """The numeric key back out of a canonical entity id."""
    return F.substring_index(entity, ":", -1).cast("bigint")


def parse_label(c: Column) -> Column:
    """0.0 or 1.0; NULL for anything but 0, 1 and their text forms."""
    text = trimmed(c)
    return F.when(text.isin("0", "1"), F.expr("1D") * text.try_cast("double"))


def hash_bucket(entity: Column, seed: int, modulus: int, dataset: str) -> Column:
    """First 32 bits of the SHA-256 of ``[dataset, entity, seed]``, modulo ``modulus``."""
    texts = F.to_json(F.array(F.lit(dataset), entity))
    document = F.concat(texts.substr(F.lit(1), F.length(texts) - 1), F.lit(f",{seed}]"))
    head = F.substring(F.sha2(document, 256), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % F.lit(modulus)


def assign_split(bucket: Column, boundary: Boundary) -> Column:
    return (
        F.when(bucket < boundary.train_upper, "train")
        .when(bucket < boundary.validation_upper, "validation")
        .otherwise("oot")
    )


def instant(text: str) -> Column:
    """A timestamp literal; the zone is part of the text."""
    return F.expr(f"timestamp'{text}'")


def shift_days(time: Column, days: Column) -> Column:
    return time + F.make_dt_interval(days.cast("int"))


def shift_months(time: Column, months: Column) -> Column:
    """Calendar shift; a day past the end of the target month becomes its last day."""
    return time + F.make_ym_interval(F.lit(0), months.cast("int"))


def utc_text(time: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") -> Column:
    """``time`` as UTC text whatever the session zone is."""
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), pattern)


def iso_text(time: Column) -> Column:
    """ISO text with ``+00:00``; the fraction is written only when there is one."""
    whole = utc_text(time, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.unix_micros(time) % 1_000_000
    return F.when(fraction == 0, F.concat(whole, F.lit("+00:00"))).otherwise(
        F.concat(utc_text(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    )


def event_id(
    dataset: Column, entity_type: Column, entity: Column, event_type: Column, time: Column,
    record: Column, revision: Column, payload_sha: Column,
) -> Column:
    """Source identity when there is a record id, content identity otherwise, NULL with neither."""
    head = [dataset, entity_type, entity, event_type, utc_text(time)]
    record_text = trimmed(record)
    by_record = canonical_id(
        *head, F.lit("source_record"), record_text, F.coalesce(trimmed(revision), F.lit(""))
    )
    by_payload = canonical_id(*head, F.lit("payload_sha256"), F.lower(payload_sha))
    return F.when(F.length(record_text) > 0, by_record).when(payload_sha.isNotNull(), by_payload)
