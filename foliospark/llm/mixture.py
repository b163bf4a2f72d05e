"""Operator 8: mixing sources to target weights by hierarchical budgeting.

The leaves are the (domain, language, source) triples of the documents.  A
budget of tokens goes down the tree: at each node it is shared among the
children in proportion to their weights, a child that can't take its share
(its tokens times ``max_epochs``) takes what it can, and the rest goes to its
siblings; only what a whole node can't take goes to the node's own siblings.
With the capacities sorted by capacity / weight, the level up to which children
are filled has a closed form, so each level of the tree is one window.  All of
it is whole numbers: what rounding down leaves goes, a token each, to the
largest remainders (ties by name), so quotas add up to the budget.

A leaf takes whole epochs of its documents and then a prefix of the next epoch:
the documents in the order of a seeded hash, while their tokens fit in.  To
find the prefix no leaf is sorted: one pass sums the tokens by leaf, epoch and
the first digits of the hash, which also gives the leaves; only the bin in
which a prefix ends is ordered, for the hash at which it stops.  The last pass
compares each document's hash with that of its leaf.

A token is a run of characters other than blank, tab, line feed, carriage
return.

Defined results: a null text has no tokens; null names (domain, language,
source) are the leaf name 'unknown'; a null doc_id is an id like any other;
repeated rows are documents of their own; other columns stay (one called
``epoch`` is replaced); children that no weight names have weight 1; a weight
of 0 or less excludes a subtree; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, quoted

LEVELS = ("domain", "language", "leaf_source")
#: Up to this number of leaves what is known of each (a hundred bytes) is broadcast; beyond, documents are joined with it.
BROADCAST_LEAVES = 100_000


def tokens_of(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def _weight(weights: Mapping[tuple[str, ...], int], depth: int) -> F.Column:
    """Weight of a node among its siblings; weights are integers by path."""
    column = F.lit(1)
    path = F.concat_ws("\x1f", *[F.col(c) for c in LEVELS[:depth]])
    for node, weight in weights.items():
        if len(node) == depth:
            column = F.when(path == "\x1f".join(node), F.lit(int(weight))).otherwise(column)
    return column.cast("long")


def _fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """nodes (parents, name, capacity, weight, amount of the parent) with ``given``, their part of it in whole tokens."""
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    before = by.orderBy("ratio", name).rowsBetween(Window.unboundedPreceding, -1)
    up_to = by.orderBy("ratio", name).rowsBetween(0, Window.unboundedFollowing)
    whole = lambda c: F.expr(c).cast("decimal(19,0)")
    nodes = nodes.where("weight > 0").withColumn("ratio", F.expr("cast(capacity as decimal(19,0)) / cast(weight as decimal(10,0))"))
    nodes = nodes.withColumns({"rest": F.col("amount") - F.coalesce(F.sum("capacity").over(before), F.lit(0)), "weights": F.sum("weight").over(up_to)})
    # the first child that takes less than its capacity sets the level of all that follow
    nodes = nodes.withColumn("open", whole("rest") * whole("weight") < whole("capacity") * whole("weights"))
    level = F.min(F.when(F.col("open"), F.struct("ratio", name, "rest", "weights"))).over(by)
    nodes = nodes.withColumn("level", level).withColumn("open", F.col("level").isNotNull() & (F.struct("ratio", name) >= F.struct("level.ratio", f"level.{name}")))
    nodes = nodes.withColumns({"share": F.expr("(cast(level.rest as decimal(19,0)) * cast(weight as decimal(19,0))) div level.weights"), "over": F.expr("(cast(level.rest as decimal(19,0)) * cast(weight as decimal(19,0))) % level.weights")})
    left = F.col("level.rest") - F.sum(F.when(F.col("open"), F.col("share"))).over(by)
    rank = F.row_number().over(by.orderBy(F.desc("open"), F.desc("over"), name))
    nodes = nodes.withColumns({"left": left, "rank": rank})
    given = F.when(F.col("open"), F.col("share") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)).otherwise(F.col("capacity"))
    return nodes.withColumn("given", given.cast("long"))


def quotas(leaves: DataFrame, weights: Mapping[tuple[str, ...], int], numerator: int, denominator: int, max_epochs: int) -> DataFrame:
    """domain, language, leaf_source, supply, quota of leaves (the three names, supply): tokens for numerator/denominator of all."""
    leaves = leaves.where("supply > 0").withColumn("capacity", F.col("supply") * max_epochs)
    # subtrees of weight 0 have no capacity
    for depth in (1, 2, 3):
        leaves = leaves.where(_weight(weights, depth) > 0)
    total = leaves.agg(F.expr(f"cast((cast(sum(supply) as decimal(19,0)) * {int(numerator)}) div {int(denominator)} as bigint)").alias("amount"))
    amounts, result = None, None
    for depth in (1, 2, 3):
        names = list(LEVELS[:depth])
        nodes = leaves.groupBy(*names).agg(F.sum("capacity").alias("capacity"), F.sum("supply").alias("supply")).withColumn("weight", _weight(weights, depth))
        nodes = nodes.crossJoin(total) if amounts is None else nodes.join(amounts, names[:-1])
        result = _fill(nodes, names[:-1], names[-1])
        amounts = result.select(*names, F.col("given").alias("amount"))
    return result.select(*LEVELS, "supply", F.col("given").alias("quota"))


def mix(
    docs: DataFrame,
    domain: F.Column,
    weights: Mapping[tuple[str, ...], int],
    numerator: int = 1,
    denominator: int = 1,
    max_epochs: int = 1,
    seed: int = 0,
    language_col: str = "lang",
    source_col: str = "source",
    epoch_col: str = "epoch",
) -> DataFrame:
    """The rows of docs that the mixture takes, with ``epoch_col`` (0, 1, ...): a row once for each epoch that takes it."""
    names = [c for c in docs.columns if c != epoch_col]
    row = F.struct(*[F.col(quoted(c)) for c in names]).alias("row")
    base = docs.select(
        row, F.coalesce(domain, F.lit("unknown")).alias("domain"),
        *[F.coalesce(F.col(quoted(c)).cast("string"), F.lit("unknown")).alias(n) for c, n in ((language_col, "language"), (source_col, "leaf_source"))],
    )
    tokens = tokens_of(F.col("row")["text"])
    place = lambda epoch: F.md5(F.concat_ws(":", F.lit(seed), epoch, F.coalesce(F.col("row")["doc_id"].cast("string"), F.lit("null"))))
    # sums of 4096 bins a leaf and epoch, however many documents there are
    counted = base.select(*LEVELS, tokens.alias("tokens"), "row").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    bins = cut(counted.groupBy(*LEVELS, "epoch", F.substring(place(F.col("epoch")), 1, 3).alias("bin")).agg(F.sum("tokens").alias("tokens")))
    leaves = bins.where("epoch = 0").groupBy(*LEVELS).agg(F.sum("tokens").alias("supply"))
    plan = quotas(leaves, weights, numerator, denominator, max_epochs)
    plan = plan.withColumn("full", F.expr("cast(quota div supply as int)")).withColumn("rest", F.col("quota") - F.col("full") * F.col("supply"))
    running = bins.join(plan.select(*LEVELS, F.col("full").alias("epoch"), "rest"), [*LEVELS, "epoch"])
    running = running.withColumn("upto", F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("bin")))
    ends = running.where("upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("bin", (F.col("upto") - F.col("tokens")).alias("before"))).alias("end"))
    plan = cut(plan.join(ends, list(LEVELS), "left").select(*LEVELS, "full", "rest", F.col("end.bin").alias("end_bin"), F.col("end.before").alias("before")))
    small = F.broadcast if plan.count() <= BROADCAST_LEAVES else lambda df: df
    # the order has ties only where ids repeat
    order = [F.col("hash"), F.col("tokens"), F.col("mark")]
    edge = base.join(small(plan.where("end_bin is not null")), list(LEVELS)).withColumn("hash", place(F.col("full"))).where("substring(hash, 1, 3) = end_bin")
    edge = edge.select(*LEVELS, "hash", tokens.alias("tokens"), F.xxhash64("row").alias("mark"), "before", "rest")
    edge = edge.withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    last = edge.where("upto <= rest").groupBy(*LEVELS).agg(F.max(F.struct(*order)).alias("last"))
    plan = cut(plan.join(last, list(LEVELS), "left").select(*LEVELS, "full", "end_bin", "last"))
    placed = base.join(small(plan), list(LEVELS)).withColumn("hash", place(F.col("full")))
    inside = F.substring("hash", 1, 3) < F.col("end_bin")
    in_edge = (F.substring("hash", 1, 3) == F.col("end_bin")) & ((F.col("hash") < F.col("last.hash")) | ((F.col("hash") == F.col("last.hash")) & (F.struct(tokens.alias("tokens"), F.xxhash64("row").alias("mark")) <= F.struct("last.tokens", "last.mark"))))
    partly = F.coalesce(inside | in_edge, F.lit(False)) & (F.col("full") < max_epochs)
    epochs = F.col("full") + F.when(partly, 1).otherwise(0)
    return placed.select("row", epochs.alias("epochs")).where("epochs > 0").select("row", F.explode(F.expr("sequence(0, epochs - 1)")).alias("epoch")).select(*[F.col("row")[c].alias(c) for c in names], F.col("epoch").alias(epoch_col))


def sql(domain: str, weights: Mapping[tuple[str, ...], int], numerator: int, denominator: int, max_epochs: int, seed: int) -> str:
    """DuckDB SQL for doc_id, lang, source, epoch of mix(documents); ids don't repeat in it."""
    short = ("dom", "lng", "src")

    def weight(depth: int) -> str:
        cases = " ".join("WHEN " + " AND ".join(f"{c} = '{v}'" for c, v in zip(short, node, strict=False)) + f" THEN {w}" for node, w in weights.items() if len(node) == depth)
        return f"CASE {cases} ELSE 1 END" if cases else "1"

    parts, amount = [], "SELECT CAST(sum(supply) AS HUGEINT) * {} // {} AS amount FROM leaves".format(numerator, denominator)
    for depth in (1, 2, 3):
        names, own = ", ".join(short[:depth]), short[depth - 1]
        parents = ", ".join(short[: depth - 1])
        by = f"PARTITION BY {parents}" if parents else ""
        join = f"JOIN g{depth - 1} USING ({parents})" if parents else f"CROSS JOIN ({amount})"
        parts.append(f"""
n{depth} AS (SELECT *, {weight(depth)} AS weight FROM (SELECT {names}, CAST(sum(supply) * {max_epochs} AS HUGEINT) AS capacity, CAST(sum(supply) AS HUGEINT) AS supply FROM leaves GROUP BY ALL) {join}),
r{depth} AS (SELECT *, amount - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM n{depth} WINDOW w AS ({by} ORDER BY CAST(capacity AS DOUBLE) / weight, {own})),
o{depth} AS (SELECT *, row_number() OVER ({by} ORDER BY CAST(capacity AS DOUBLE) / weight, {own}) AS place, rest * weight < capacity * weights AS starts FROM r{depth}),
l{depth} AS (SELECT *, min(CASE WHEN starts THEN place END) OVER ({by}) AS opening FROM o{depth}),
s{depth} AS (SELECT *, place >= opening AS free, max(CASE WHEN place = opening THEN rest END) OVER ({by}) AS lrest, max(CASE WHEN place = opening THEN weights END) OVER ({by}) AS lweights FROM l{depth}),
q{depth} AS (SELECT *, CASE WHEN free THEN CAST(lrest AS HUGEINT) * weight // CAST(lweights AS HUGEINT) ELSE capacity END AS share, CASE WHEN free THEN CAST(lrest AS HUGEINT) * weight % CAST(lweights AS HUGEINT) END AS over FROM s{depth}),
t{depth} AS (SELECT *, lrest - sum(CASE WHEN free THEN share END) OVER ({by}) AS spare, row_number() OVER ({by} ORDER BY coalesce(free, false) DESC, over DESC NULLS LAST, {own}) AS rank FROM q{depth}),
g{depth} AS (SELECT {names}, supply, share + CASE WHEN free AND rank <= spare THEN 1 ELSE 0 END AS amount FROM t{depth})""")
    return f"""
WITH d AS (
  SELECT doc_id, lang, source, {domain} AS dom, coalesce(lang, 'unknown') AS lng, coalesce(source, 'unknown') AS src, coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0) AS tokens FROM documents),
leaves AS (SELECT dom, lng, src, sum(tokens) AS supply FROM d GROUP BY ALL HAVING sum(tokens) > 0),{",".join(parts).replace("g1 USING", "(SELECT dom, amount FROM g1) USING").replace("g2 USING", "(SELECT dom, lng, amount FROM g2) USING")},
p AS (SELECT dom, lng, src, CAST(amount // supply AS BIGINT) AS whole, CAST(amount % supply AS BIGINT) AS rest FROM g3),
h AS (SELECT doc_id, lang, source, whole, rest, sum(tokens) OVER (PARTITION BY dom, lng, src ORDER BY md5('{seed}:' || whole || ':' || doc_id) ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN p USING (dom, lng, src)),
e AS (SELECT doc_id, lang, source, whole + CASE WHEN upto <= rest AND whole < {max_epochs} THEN 1 ELSE 0 END AS epochs FROM h)
SELECT doc_id, lang, source, CAST(unnest(range(epochs)) AS INTEGER) AS epoch FROM e
"""
