"""Relational patterns that several operators share, on any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.text import encode_sequence, sha256_hex
from folioscan.plans.staging import staged


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast. Sizes are estimated from files, and a staged table of millions of short
    rows is some MB of Parquet, but over a hundred MB as a broadcast, which the driver holds."""
    return df.hint("merge")


def uniform(value: Column) -> Column:
    """Aggregate: the one distinct known value, else null."""
    return F.when(F.count_distinct(value) == 1, F.min(value))


def modal(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, the commonest value (ties to the smallest, null first), its count, and whether another is as common."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc_nulls_first(value))
    ranked = counts.withColumn("rank", F.row_number().over(order)).withColumn("next_n", F.lead("n").over(order))
    return ranked.filter("rank = 1").select(*keys, value, "n", F.coalesce(F.col("next_n") == F.col("n"), F.lit(False)).alias("tie"))


def modal_sample(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """For each key the first row, by order, among those with the modal value; with tie and n_modal."""
    best = modal(df, keys, value).withColumnRenamed(value, "_modal").withColumnRenamed("n", "n_modal")
    rows = df.join(best, keys).filter(F.col(value).eqNullSafe(F.col("_modal"))).drop("_modal")
    first = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def consensus(df: DataFrame, keys: list[str], member: str, value: str) -> DataFrame:
    """keys and the value that all members agree on, each having exactly one; null without such."""
    per = df.groupBy(*keys, member).agg(F.count_distinct(value).alias("n"), F.min(value).alias("v"))
    return per.groupBy(*keys).agg(F.when((F.max("n") == 1) & (F.min("n") == 1) & (F.count_distinct("v") == 1), F.min("v")).alias("consensus"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def sequence_digest(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, n and the digest of the values in order, coded so that no two sequences collide."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda s: s["v"])
    return df.groupBy(*keys).agg(F.count("*").alias("n"), sha256_hex(encode_sequence(listed)).alias("digest"))


def multiset_surplus(after: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of after beyond those of before, counting repetition."""
    return after.exceptAll(before)


def multiset_contained(after: DataFrame, before: DataFrame) -> bool:
    """Whether after has no row beyond before's."""
    return multiset_surplus(after, before).isEmpty()


def not_subset(df: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """Keys of df that are not in of: empty when df is a subset."""
    return df.select(key).distinct().join(of.select(key).distinct(), key, "left_anti")


def longest_run(df: DataFrame, keys: list[str], order: str, condition: Column) -> DataFrame:
    """keys and the length of the longest run of rows, by order, that meet the condition (0 without any)."""
    rows = df.withColumn("_hit", F.coalesce(condition, F.lit(False)))
    by = Window.partitionBy(*keys).orderBy(order)
    islands = rows.withColumn("_island", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy(*keys, "_island").agg(F.count_if("_hit").alias("run"))
    return runs.groupBy(*keys).agg(F.max("run").alias("longest"))


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, most: int = 2**63 - 1) -> DataFrame:
    """df with the total up to each row, which stops at most."""
    by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("total", F.least(F.sum(F.col(value).cast("decimal(38,0)")).over(by), F.lit(most).cast("decimal(38,0)")).cast("bigint"))


def sections(df: DataFrame, keys: list[str], order: str, closes: Column) -> DataFrame:
    """df with section_ix and the row's place in its section; a row that closes a section is its last."""
    by = Window.partitionBy(*keys).orderBy(order)
    cut = F.when(F.coalesce(closes, F.lit(False)), 1).otherwise(0)
    rows = df.withColumn("section_ix", F.coalesce(F.sum(cut).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    inside = Window.partitionBy(*keys, "section_ix").orderBy(order)
    return rows.withColumn("place", (F.row_number().over(inside) - 1).cast("int"))


def numbered(df: DataFrame, keys: list[str], order: str, name: str = "position") -> DataFrame:
    """df with the 0-based place of each row."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("int"))


def sequence_breaks(df: DataFrame, keys: list[str], order: list[str], number: str) -> DataFrame:
    """df with the number expected by place (from 1) and whether the row carries it."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("expected", F.row_number().over(by)).withColumn("in_sequence", F.coalesce(F.col(number) == F.col("expected"), F.lit(False)))


def top(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def next_after(df: DataFrame, keys: list[str], order: str, mark: Column) -> DataFrame:
    """For each key the first row behind the first marked one."""
    by = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_before", F.lag(F.coalesce(mark, F.lit(False))).over(by)).filter("_before").drop("_before")
    return rows.withColumn("_rank", F.row_number().over(by)).filter("_rank = 1").drop("_rank")


def pair_by_order(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both sides with equal places, and those beyond the shorter side alone; place is 1-based."""
    sides = []
    for df, side in ((left, "l"), (right, "r")):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
        sides.append(df.select(*keys, place.alias("place"), F.struct(*[c for c in df.columns if c not in keys]).alias(side)))
    return sides[0].join(sides[1], [*keys, "place"], "full_outer")


def closure(edges: DataFrame, node: str, parent: str, most: int = 10_000) -> DataFrame:
    """(node, ancestor, depth) over all chains of parents, each node its own ancestor at depth 0. Joins double the reach of
    every round, so a chain of depth d takes log2(d) joins; a cycle's members reach each once. most: the depth beyond which
    a chain must be a cycle."""
    before = None
    links = edges.select(F.col(node).alias("node"), F.col(parent).alias("ancestor")).filter("ancestor is not null")
    jump, reach, step = links.select("node", "ancestor", F.lit(1).alias("depth")), None, 1
    nodes = edges.select(F.col(node).alias("node")).distinct()
    reach = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
    while step <= most:
        further = reach.alias("r").join(jump.alias("j"), F.col("r.ancestor") == F.col("j.node")).select("r.node", "j.ancestor", (F.col("r.depth") + F.col("j.depth")).alias("depth"))
        reach = staged(reach.union(further).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")), "reach")
        jump = staged(jump.alias("a").join(jump.alias("b"), F.col("a.ancestor") == F.col("b.node")).select("a.node", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth")), "jump")
        step *= 2
        size = reach.count()
        if jump.isEmpty() or size == before:  # on a cycle chains go on, but reach nothing new
            break
        before = size
    return reach


def topological_levels(nodes: DataFrame, edges: DataFrame, node: str, needs: str) -> DataFrame:
    """nodes with the round in which all that they need is done; null for nodes on a cycle, behind one, or with an unknown
    dependency. A round is a join; there are as many as the longest chain."""
    left = nodes.select(node).distinct()
    open_ = edges.select(node, needs).distinct()
    done, level = None, 0
    while True:
        ready = staged(left.join(open_.select(node).distinct(), node, "left_anti").withColumn("round", F.lit(level)), "ready")
        if ready.isEmpty():
            break
        done = ready if done is None else done.union(ready)
        # only what waits goes on: nodes that wait, and the edges to what is not done
        open_ = staged(open_.join(ready.select(F.col(node).alias(needs)), needs, "left_anti"), "open")
        left = left.join(ready, node, "left_anti")
        level += 1
    return nodes.join(done, node, "left") if done is not None else nodes.withColumn("round", F.lit(None).cast("int"))


def execution_order(levels: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """levels (with a round) with the 1-based place in the order of execution."""
    return levels.withColumn("execution_order", F.row_number().over(Window.partitionBy(*keys).orderBy("round", *ties)))


def layered(layers: list[Column], fields: list[str]) -> Column:
    """Field by field the value of the strongest layer that has one; layers are structs, the strongest last, and a null
    struct has none. One flat coalesce a field, however many layers."""
    return F.struct(*[F.coalesce(*[x[f] for x in reversed(layers)]).alias(f) for f in fields])


def overlay(inherited: Column, direct: Column, fields: list[str]) -> Column:
    """layered() of two."""
    return layered([inherited, direct], fields)
