"""Quality rules judged per document and per host, in DataFrame functions only.

Each document gets counts of its whole text and the rules it fails. Failures are summed per host, the
rates are shrunk by a beta prior fitted to all hosts, and a host whose shrunk rate is too high takes
its documents with it.

Defined results: a NULL text counts as empty (no word, so it is too short); documents without a host
form one host of their own; repeated rows count as often as they stand there and each is returned;
an empty table gives an empty result; columns that are not named stay unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, bind, whole
from tidemark.session import settle

#: A host goes if its shrunk rate of failures of any rule is above this.
HOST_LIMIT = 0.5
#: The prior weighs at most as much as this many documents of a host.
MOST_PRIOR = 1000.0
RULES = ("short", "repeats", "symbols", "lines")


def _repeated_words(words: Column, count: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the document, each counted once.

    Windows are first compared by hash; only where two hashes agree are the windows themselves sorted.
    """

    def counted(w: Column) -> Column:
        first = F.slice(w, F.lit(1), F.size(w) - 2)
        keyed = F.transform(
            first, lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))
        )

        def again(s: Column) -> Column:
            same = F.transform(s, lambda p, j: F.when(
                F.coalesce(p["g"] == F.get(s, j - 1)["g"], F.lit(False))
                | F.coalesce(p["g"] == F.get(s, j + 1)["g"], F.lit(False)), p["i"]))
            return F.array_sort(F.filter(same, lambda i: i.isNotNull()))

        starts = bind(F.array_sort(keyed), again)
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            starts, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    def hashes(w: Column) -> Column:
        return F.transform(
            F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    some = bind(words, lambda w: F.size(F.array_distinct(hashes(w)))) < count - 2
    return F.when(count < 4, 0).when(some, bind(words, counted)).otherwise(0).cast("long")


def text_counts(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """``keep`` and the counts of every whole text."""
    t = F.col("_text")
    rows = docs.select(*keep, whole(text).alias("_text"))
    rows = rows.select(
        "*", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("_words"),
        F.filter(F.split(t, "\n"), lambda line: line.rlike(WORD)).alias("_lines"),
    )
    words, lines, n = F.col("_words"), F.col("_lines"), F.size("_words")
    return rows.select(
        *[c for c in rows.columns if c not in ("_text", "_words", "_lines")],
        n.cast("long").alias("n_words"), F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeated_words(words, n).alias("n_repeat_words"),
    )


def _failed(rule: str) -> Column:
    return {
        "short": F.col("n_words") < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": F.col("n_symbols") > F.col("n_words"),
        "lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
    }[rule]


def fitted_prior(failures: DataFrame) -> dict[str, tuple[float, float]]:
    """host, n, failures per rule -> each rule's mean rate and the prior's weight (alpha + beta).

    The weight explains how far the hosts' rates lie apart (method of moments), each host counted with
    its documents. One row of sums reaches the driver.
    """
    n = F.sum("n")
    row = failures.agg(
        *[(F.sum(r) / n).alias(f"mean_{r}") for r in RULES], *[(F.sum(F.col(r) ** 2 / F.col("n")) / n).alias(f"square_{r}") for r in RULES]
    ).first()
    prior = {}
    for r in RULES:
        mean = row[f"mean_{r}"] or 0.0
        apart = max((row[f"square_{r}"] or 0.0) - mean * mean, 0.0)
        weight = mean * (1 - mean) / apart - 1 if apart > 1e-12 else MOST_PRIOR
        prior[r] = (mean, min(max(weight, 1.0), MOST_PRIOR))
    return prior


def shrunk_rates(failures: DataFrame) -> list[Column]:
    """Each rule's rate of a host under the beta prior fitted to all hosts."""
    return [
        ((F.col(r) + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))).alias(f"rate_{r}")
        for r, (mean, weight) in fitted_prior(failures).items()
    ]


def judge(docs: DataFrame, keep: list[str], host: str = "source", text: str = "text", name: str = "counts") -> DataFrame:
    """``keep``, the counts, ``base_failed``, ``host_failed`` and ``kept`` for each row of ``docs``.

    Counts are made once and written, since both the hosts' sums and the verdicts need them.
    """
    kept = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    counts = settle(text_counts(docs, [*kept, F.col(host).cast("string").alias("_host")], text), name)
    failures = counts.groupBy(F.col("_host").alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(_failed(r)).alias(r) for r in RULES])
    # Written first, so that its size is known and documents are not dealt out by host where hosts are few.
    hosts = settle(failures.select("host", (F.greatest(*shrunk_rates(failures)) > HOST_LIMIT).alias("host_failed")), "hosts")
    base = _failed("short") | _failed("repeats")
    rows = counts.join(hosts, counts["_host"].eqNullSafe(hosts["host"]))
    return rows.select(
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)],
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "host_failed", (~base & ~F.col("host_failed")).alias("kept"),
    )
