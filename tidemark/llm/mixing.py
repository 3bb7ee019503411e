"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A document of a source is wanted ``target / size of the source`` times. The whole part is taken; the
fractions are rounded in pairs: mass moves at random from one document of the pair to the other until
one of them is taken or left, so that the words of the pair stay as they are and every document keeps
its expected share. What is left of a pair meets the next one. Groups of bounded size are folded in
parallel, their residuals form groups again, up a tree, until one residual per source is left; it is
rounded to the nearer side. A source so misses its target by at most half the words of one document.
Of a pair the longer document tends to stay, so folds go from long to short: long ones are then settled
against many short ones, and a short one is left.

Defined results: a NULL or wordless text has size 0 and takes no words; documents without a source are
one source, ordered last; repeated rows are rounded each on its own, by their number among equal rows; the random
numbers come from a seed and the rows, so reruns agree; an empty table gives an empty result; of a very long
text only its words are counted; columns that are not named stay unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, bind, unit, whole
from tidemark.session import settle

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2.0
#: Documents that one fold takes on average, and so the fan-in of the reduction tree.
GROUP = 64
#: Equal rows that one task deals out.
CHUNK = 1 << 16


def sized(docs: DataFrame, keep: list[str], source: str = "source", text: str = "text") -> DataFrame:
    """``keep`` as a struct ``doc``, ``source``, ``size`` (words of the whole text), ``mark`` (hash of the text)."""
    return docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("doc"), F.col(source).cast("string").alias("source"),
        F.xxhash64(whole(text)).alias("mark"),
        F.regexp_count(whole(text), F.lit(WORD)).cast("long").alias("size"),
    )


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, n -> these and ``target``: water filled by weight up to ``most`` times the size.

    A source is full if the water needed to reach its brim, with all lower brims full, is not more than
    there is. The windows run over one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights))
    rows = sizes.withColumn("w", weight).withColumn("brim", F.lit(float(most)) * F.col("source_size"))
    rows = rows.withColumn("level", F.col("brim") / F.col("w"))
    order = Window.orderBy("level", F.asc_nulls_last("source"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.select(
        "*", (F.lit(share) * F.sum("source_size").over(everything)).alias("water"),
        F.coalesce(F.sum("brim").over(below), F.lit(0.0)).alias("brims"), F.sum("w").over(rest).alias("ws"),
    )
    rows = rows.withColumn("full", F.col("brims") + F.col("level") * F.col("ws") <= F.col("water"))
    free = F.when(~F.col("full"), F.col("w"))
    used = F.coalesce(F.sum(F.when(F.col("full"), F.col("brim"))).over(everything), F.lit(0.0))
    height = (F.col("water") - used) / F.sum(free).over(everything)
    return rows.select(
        "source", "source_size", "n",
        F.when(F.col("full"), F.col("brim")).otherwise(F.least(F.col("brim"), height * F.col("w"))).alias("target"),
    )


def _pair(a: Column, b: Column, seed: Column) -> Column:
    """Move words between two fractional rows: ``{left, done}``, where at least ``done`` is integral.

    Up to ``up`` words can move to ``a``, up to ``down`` to ``b``; the chances are such that neither
    row's expected share changes.
    """
    room_a, room_b = (1 - a["p"]) * a["size"], (1 - b["p"]) * b["size"]
    has_a, has_b = a["p"] * a["size"], b["p"] * b["size"]
    up, down = F.least(room_a, has_b), F.least(has_a, room_b)
    to_a = unit(seed, a["key"], b["key"]) * (up + down) < down

    def row(x: Column, p: Column) -> Column:
        return F.struct(x["key"].alias("key"), x["size"].alias("size"), x["base"].alias("base"), p.alias("p"), x["doc"].alias("doc"))

    def part(done: Column, p_done: Column, left: Column, p_left: Column) -> Column:
        inside = F.least(F.greatest(p_left, F.lit(0.0)), F.lit(1.0))
        return F.struct(row(left, inside).alias("left"), row(done, p_done).alias("done"))

    one, nil = F.lit(1.0), F.lit(0.0)
    return F.when(
        to_a,
        F.when(room_a <= has_b, part(a, one, b, b["p"] - room_a / b["size"])).otherwise(part(b, nil, a, a["p"] + has_b / a["size"])),
    ).otherwise(
        F.when(has_a <= room_b, part(a, nil, b, b["p"] + has_a / b["size"])).otherwise(part(b, one, a, a["p"] - room_b / a["size"])),
    )


def _fold(rows: Column, seed: Column) -> Column:
    """All rows of a group, long ones first -> ``{left, done}``: the residual row and the integral ones."""

    def step(state: Column, x: Column) -> Column:
        moved = bind(state["left"], lambda left: _pair(left, x, seed))
        return bind(moved, lambda m: F.struct(m["left"].alias("left"), F.concat(state["done"], F.array(m["done"])).alias("done")))

    def run(sorted_rows: Column) -> Column:
        start = F.struct(sorted_rows[0].alias("left"), F.slice(sorted_rows, 1, 0).alias("done"))
        return F.aggregate(F.slice(sorted_rows, F.lit(2), F.size(sorted_rows)), start, step)

    ordered = F.transform(rows, lambda x: F.struct((-x["size"]).alias("o"), x["key"].alias("k"), x.alias("x")))
    return bind(F.transform(F.array_sort(ordered), lambda s: s["x"]), run)


def _numbered(sizes: DataFrame) -> DataFrame:
    """Each row with its ``number`` among wholly equal rows.

    Equal rows are counted first, which partial counts keep cheap, and dealt out again in chunks, so rows that
    are a third of all never meet in one task.
    """
    counted = sizes.groupBy(*sizes.columns).agg(F.count(F.lit(1)).alias("_n"))
    chunks = counted.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / CHUNK))))
    chunks = settle(chunks, "sized")
    many = chunks.where(F.col("_n") > CHUNK).repartition("mark", "_chunk")
    spread = chunks.where(F.col("_n") <= CHUNK).unionByName(many)
    first = F.col("_chunk") * CHUNK
    numbers = F.sequence(first, F.least(F.col("_n"), first + CHUNK) - 1)
    return spread.select(*sizes.columns, F.explode(numbers).alias("number"))


def mix(
    sizes: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES,
    group: int = GROUP,
) -> DataFrame:
    """doc, source, size, mark (of ``sized``) -> doc, source, size, ``source_size``, ``target`` and ``copies`` for each row."""
    rows = settle(_numbered(sizes), "numbered")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    plan = settle(targets(per_source, weights, share, most), "targets")
    named = plan.withColumnRenamed("source", "_source")
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    wanted = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("_wanted", wanted).withColumn("_base", F.floor("_wanted"))
    rows = rows.withColumn("_p", F.col("_wanted") - F.col("_base"))
    whole_part = rows.where(F.col("_p") <= 0).select("doc", "source", "size", "source_size", "target", F.col("_base").alias("copies"))
    key = F.xxhash64(F.lit(seed), "doc", "size", "mark", "number")
    level = rows.where(F.col("_p") > 0).select(
        "source", F.ceil(F.col("n") / group).alias("groups"),
        F.struct(key.alias("key"), "size", F.col("_base").alias("base"), F.col("_p").alias("p"), "doc").alias("row"),
    )
    # The tree is as deep as the largest source asks for; one number reaches the driver.
    groups = plan.agg(F.max(F.ceil(F.col("n") / group))).first()[0] or 0
    finished, depth = [], 0
    while groups:
        place = F.pmod(F.xxhash64(F.lit(seed + 1 + depth), F.col("row.key"), F.col("row.doc")), F.col("groups"))
        folded = level.groupBy("source", "groups", place.alias("_place")).agg(F.collect_list("row").alias("rows"))
        folded = settle(folded.select("source", "groups", _fold(F.col("rows"), F.lit(seed + depth)).alias("out")), f"level-{depth}")
        finished.append(folded.select("source", F.explode("out.done").alias("row")))
        fractional = (F.col("out.left.p") > 0) & (F.col("out.left.p") < 1)
        last = folded.where((F.col("groups") == 1) | ~fractional)
        finished.append(
            last.select("source", F.col("out.left").alias("row"))
            .withColumn("row", F.col("row").withField("p", F.when(F.col("row.p") >= 0.5, 1.0).otherwise(0.0))))
        level = folded.where((F.col("groups") > 1) & fractional).select(
            "source", F.ceil(F.col("groups") / group).alias("groups"), F.col("out.left").alias("row"))
        groups, depth = (0 if groups == 1 else -(-groups // group)), depth + 1
    rounded = None
    for part in finished:
        rounded = part if rounded is None else rounded.unionByName(part)
    if rounded is None:
        return whole_part
    rounded = rounded.join(named, F.col("source").eqNullSafe(F.col("_source"))).select(
        "row.doc", "source", "row.size", "source_size", "target",
        (F.col("row.base") + F.col("row.p").cast("long")).alias("copies"))
    return whole_part.unionByName(rounded)
