"""Secrets in whole texts, found with a trigram inverted index, in DataFrame functions only.

A Boolean trigram query is derived from each rule's pattern. The index holds, for each segment of
documents and each trigram that any rule can ask for, the sorted list of documents that contain it in
lower case. Queries are answered by intersecting and uniting these lists; only then are candidates
matched against the pattern itself. Rules without a mandatory trigram are matched against every text.

Documents stand in the index by a hash of their whole row key and text. Rows that share one share
their candidates, which at worst are verified in vain.

Defined results: a NULL text is empty and has no span; positions count code points; repeated rows are
each returned; a NULL id is a value like any other; an empty table gives an empty result; columns that
are not named stay unread.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bind, whole
from tidemark.llm.trigrams import TRUE, trigram_query
from tidemark.session import settle


class Rule(NamedTuple):
    """A kind of secret; a match counts if its ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: The base rules come first, in their fixed order.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}"),
    # With its body and end; where that is missing, with the lines of base64 that follow.
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----|[\r\n]+[A-Za-z0-9+/=\r\n]{64,})?"),
    Rule("forge_token", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z]{2,12}://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/@]{3,}@"),
)
BASE = ("assign", "access", "hex")
#: Documents a segment of the index holds on average; its lists meet in one task.
SEGMENT = 8192
#: Matches are numbered in blocks of so many, so a text full of matches costs no square.
BLOCK = 256


def build_index(keyed: DataFrame, segments: int, trigrams: list[str]) -> DataFrame:
    """key, text -> segment, trigram, keys: the posting lists of the asked trigrams over whole texts."""
    held = bind(
        F.lower("text"), lambda t: F.filter(F.array(*[F.lit(g) for g in trigrams]), lambda g: F.contains(t, g)))
    rows = keyed.select("key", F.explode(held).alias("trigram"))
    return rows.groupBy(F.pmod("key", F.lit(segments)).alias("segment"), "trigram").agg(
        F.array_sort(F.collect_set("key")).alias("keys"))


def candidates(index: DataFrame, queries: dict[str, frozenset[frozenset[str]]]) -> DataFrame:
    """The index and a Boolean query per kind -> key, kinds: the documents that may match each."""
    lists = index.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))
    nothing = F.array().cast("array<bigint>")

    def postings(trigram: str) -> Column:
        return F.coalesce(F.col("lists")[F.lit(trigram)], nothing)

    def named(keys: Column, kind: str) -> Column:
        return F.transform(keys, lambda key: F.struct(key.alias("key"), F.lit(kind).alias("kind")))

    found = []
    for kind, query in queries.items():
        united = nothing
        for conjunction in sorted(map(sorted, query)):
            met = postings(conjunction[0])
            for trigram in conjunction[1:]:
                met = F.array_intersect(met, postings(trigram))
            united = F.array_union(united, met)
        found.append(named(united, kind))
    hits = lists.select(F.explode(F.flatten(F.array(*found))).alias("hit"))
    return hits.groupBy("hit.key").agg(F.collect_set("hit.kind").alias("kinds"))


def _starts(steps: Column) -> Column:
    """[{gap, len}] -> [{start, end}]: running sums in blocks, then over the blocks."""
    size = F.size(steps)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))
    zero = F.lit(0)
    span = "array<struct<start:int,end:int>>"

    def inside(block: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast(span).alias("out"))
        return F.aggregate(block, start, lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["len"]).alias("at"),
            F.concat(a["out"], F.array(F.struct(
                (a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["len"]).alias("end")))).alias("out")))

    def shifted(parts: Column) -> Column:
        first = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))
        offsets = F.aggregate(parts, first, lambda a, x: F.struct(
            (a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return F.flatten(F.zip_with(parts, offsets, lambda p, o: F.transform(
            p["out"], lambda s: F.struct((s["start"] + o).alias("start"), (s["end"] + o).alias("end")))))

    return F.when(size > 0, bind(F.transform(blocks, inside), shifted)).otherwise(F.array().cast(span))


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """[{start, number, end}] of the rule's matches, leftmost and without overlap, those too short left out.

    Splitting at the pattern gives the gaps, extracting it the matches; both run along the text once.
    """
    pattern, empty = F.lit(rule.pattern), F.array().cast("array<struct<start:int,number:int,end:int>>")

    def placed(matches: Column) -> Column:
        gaps = F.split(text, rule.pattern, -1)
        steps = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(
            F.char_length(g).alias("gap"), F.char_length(m).alias("len")))
        counted = matches if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
        both = F.zip_with(bind(steps, _starts), counted, lambda s, v: F.struct(
            s["start"].alias("start"), F.lit(number).alias("number"), s["end"].alias("end"), F.char_length(v).alias("n")))
        good = F.filter(both, lambda s: s["n"] >= rule.least)
        return F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["number"].alias("number"), s["end"].alias("end")))

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return bind(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(empty))


def scan(docs: DataFrame, keep: list[str], text: str = "text", rules: tuple[Rule, ...] = RULES, segment: int = SEGMENT) -> DataFrame:
    """``keep``, ``text`` (never NULL) and ``spans``, sorted by start and rule, for each row of ``docs``."""
    kept = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    rows = docs.select(*kept, whole(text).alias("text"))
    rows = rows.withColumn("key", F.xxhash64(*[f"_keep{i}" for i, c in enumerate(keep) if c != text], "text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = {k: q for k, q in queries.items() if q != TRUE}
    trigrams = sorted({t for q in asked.values() for c in q for t in c})
    segments = max(1, -(-docs.count() // segment))
    index = settle(build_index(rows.select("key", "text"), segments, trigrams), "trigrams")
    hits = candidates(index, asked)
    rows = rows.join(hits.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"), "left")
    empty = F.array().cast("array<struct<start:int,number:int,end:int>>")
    found = [
        spans_of(F.col("text"), r, i) if r.kind not in asked
        else F.when(F.array_contains("kinds", r.kind), spans_of(F.col("text"), r, i)).otherwise(empty)
        for i, r in enumerate(rules)
    ]
    return rows.select(
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep) if c != text], "text",
        F.array_sort(F.flatten(F.array(*found))).alias("spans"),
    )


def written(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` for each span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["number"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, joined where they overlap, replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))
        out = F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(piece)))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    def joined(a: Column) -> Column:
        return F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.char_length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, joined)).otherwise(text)
