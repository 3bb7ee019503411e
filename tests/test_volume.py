"""What the stages write: a digest of the same value over smaller rows, and tables that compress their hashes."""

from __future__ import annotations

import hashlib
import os
from urllib.parse import urlparse

from pyspark.sql import functions as F

from tidemark.operators.fingerprint import _counted, fingerprint
from tidemark.session import settle
from tidemark.settings import MANIFEST
from tidemark.sources.tables import ensure_table


def plain_digest(hashes: list[str]) -> str:
    """The tree of one leaf: so few rows have no prefix, and each level folds the one line before."""
    counts = {h: hashes.count(h) for h in hashes}
    digest = hashlib.sha256("".join(sorted(f"{h}:{n}\n" for h, n in counts.items())).encode()).hexdigest()
    for _ in range(3):
        digest = hashlib.sha256(f"={digest}\n".encode()).hexdigest()
    return digest


def test_digest_of_texts_and_of_bytes(spark):
    """SHA-256 texts travel as bytes; upper case and other texts keep their own lines and their place in the order."""
    sha = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(50)]
    hashes = sha + sha[:7] + [sha[0].upper(), "zz", "0", sha[1][:63], sha[2] + "\n"]
    df = spark.createDataFrame([(h,) for h in hashes], "h string")
    for rows in (None, len(hashes)):
        got = fingerprint(df, "h", rows).first()
        assert tuple(got) == (plain_digest(hashes), len(hashes), 55, 7)
    sizes = _counted(df, "h").select(F.octet_length("b").alias("b"), "t").collect()
    assert sum(r.b == 32 and r.t is None for r in sizes) == 50 and sum(r.b is None for r in sizes) == 5


def test_digest_is_the_same_with_known_rows(spark):
    df = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    assert fingerprint(df, "h").first() == fingerprint(df, "h", 5000).first()


def test_hashes_are_written_small(spark, tmp_path):
    """Hex text takes little more than its bytes, in settled rows and in tables of a layer."""
    df = spark.range(20000).repartition(1).select(F.sha2(F.col("id").cast("string"), 256).alias("h"), F.lit("m").alias(MANIFEST))
    bytes_of = lambda files: sum(os.path.getsize(urlparse(f).path) for f in files)
    assert bytes_of(settle(df, "hashes").inputFiles()) < 45 * 20000
    ensure_table(spark, "volume_test.hashes", df.schema, location=str(tmp_path / "t"))
    df.write.insertInto("volume_test.hashes")
    assert bytes_of(spark.table("volume_test.hashes").inputFiles()) < 45 * 20000
