"""The corpus pipeline: stages that each take what the one before kept, as Parquet.

All stages but the last return the columns of ``documents``, whatever these are. In every stage a NULL text is
empty, rows without a source are one source, rows without an id are rows like others, texts of any length are read
whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import host_rules, mixing, near_dup, packing, secret_scan
from tidemark.llm.common import WORD, table, whole
from tidemark.session import settle


def _row_key(docs: DataFrame) -> Column:
    """256 bits that name a row by its values in all columns."""
    others = F.to_json(F.struct(*[c for c in docs.columns if c != "text"]), {"ignoreNullFields": "false"})
    return F.concat(*[F.unhex(F.md5(c.cast("binary"))) for c in (F.concat(F.col("text").isNull().cast("string"), whole()), others)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules, or whose host does, go; repeated rows each keep their verdict."""
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), "text", "source")
    return host_rules.judge(rows, ["_doc"]).where("kept").select("_doc.*")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the smallest doc_id stays; wordless documents all stay.

    Rows of that id and text that differ elsewhere: the one with the least key of its values.
    """
    found = settle(near_dup.classes(docs), "near-dup")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_md5"))
    stays = found.where("class IS NOT NULL").groupBy("class").agg(first.alias("first")).select(
        F.col("first.id").alias("_stay_id"), F.col("first.text_md5").alias("_stay_text"))
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.unhex(F.md5(whole().cast("binary"))).alias("_md5"), _row_key(docs).alias("_key"))
    chosen = rows.join(stays, (F.col("_md5") == F.col("_stay_text")) & F.col("_doc.doc_id").eqNullSafe(F.col("_stay_id")), "left_semi")
    wordless = rows.where(~whole("_doc.text").rlike(WORD))
    one = chosen.groupBy("_md5").agg(F.min_by("_doc", "_key").alias("_doc"))
    return one.select("_doc").unionByName(wordless.select("_doc")).select("_doc.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of a secret is replaced in its text; n_chars follows. Texts without one stay as they are."""
    found = secret_scan.scan(docs.select(F.struct(*docs.columns).alias("_doc"), "text"), ["_doc"])
    hit = F.size("spans") > 0
    clean = found.select("_doc", hit.alias("_hit"), secret_scan.redacted(F.col("text"), F.col("spans")).alias("_text"))
    columns = {c: F.col(f"_doc.`{c}`") for c in docs.columns}
    changed = {"text": F.col("_text")}
    if "n_chars" in columns:
        changed["n_chars"] = F.char_length("_text").cast(docs.schema["n_chars"].dataType)
    return clean.select(*[F.when(F.col("_hit"), changed[c]).otherwise(v).alias(c) if c in changed else v.alias(c) for c, v in columns.items()])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; wholly equal rows share their copies."""
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), _row_key(docs).alias("_row"), whole().alias("text"), "source")
    taken = mixing.mix(mixing.sized(rows, ["_row"])).groupBy("doc._row").agg(F.sum("copies").alias("copies"))
    one = rows.select("_doc", "_row").dropDuplicates(["_row"])
    counted = one.join(taken.where("copies > 0").withColumnRenamed("_row", "_taken"), F.col("_row") == F.col("_taken"))
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return counted.select("_doc", times.alias("_copy")).select("_doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies among the packed sequences."""
    return packing.pack(docs, ["doc_id"])


STAGES = [
    ("quality rules", quality), ("near-duplicates", dedup), ("secret scans", secrets), ("source mixing", mix), ("best-fit packing", pack),
]
#: Tokenization, near-duplicate search and seeded rounding have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read back by the next one."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs, f"stage-{i}")
    return docs
