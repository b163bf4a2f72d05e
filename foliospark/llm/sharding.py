"""Operator 10: a uniform shuffle into shards of exact sizes.

How many rows of input partition p go to shard s is drawn from the multivariate
hypergeometric distribution: exactly the counts of a uniformly random
permutation of all rows.  The matrix of counts is never built: a task walks
down a binary tree of the partitions, splitting the vector of shard sizes at
each node with a generator seeded by the node, and so finds its own row.
Each partition then deals its rows to the shards by a random permutation, the
rows are exchanged, and each shard puts its rows in the order of their random
keys.  A shard is ordered in sections, ranges of the keys of about SECTION
bytes, so that the work of a task doesn't grow with the shard; where a section
begins is known from a rehearsal of the dealing, which reads no rows.

Only the row counts of the partitions come to the driver.  Tasks that are run
again deal the same cards, as long as a partition has the same rows in the same
order; a scan does, and any other input is first written to the checkpoint
folder.  A task that finds another number of rows than was counted fails.

Defined results: rows are dealt whatever they hold, so nulls, empty texts and
repeated rows stay as they are; with fewer rows than shards, some shards are
empty; an empty table gives an empty result; columns called ``shard`` or
``position`` are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from ._spark import cut, map_rows, quoted, unused
from ._text import released

_NUMPY_LIMIT = 10**9
SECTION = 256 << 10


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Good items in a sample without replacement, for any size (numpy stops at 10**9)."""
    if good == 0 or sample == 0:
        return 0
    if bad == 0:
        return sample
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample))
    total = good + bad
    if sample > total // 2:
        return good - hypergeometric(rng, good, bad, total - sample)
    if min(good, bad, sample) < 50:  # few draws: one by one
        if good < sample:
            return hypergeometric(rng, sample, total - sample, good)
        found = 0
        for i in range(sample):
            found += int(rng.integers(total - i) < good - found)
        return found

    # ratio of uniforms around the mode
    def log_weight(k: int) -> float:
        return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(sample - k + 1) + math.lgamma(bad - sample + k + 1))

    mode = (sample + 1) * (good + 1) // (total + 2)
    p = good / total
    deviation = math.sqrt((total - sample) * sample * p * (1 - p) / (total - 1) + 0.5)
    centre, width, top = sample * p + 0.5, 1.7155277699214135 * deviation + 0.8989161620588988, log_weight(mode)
    least, most = max(0, sample - bad), min(good, sample)
    while True:
        u, v = rng.random(), rng.random()
        x = centre + width * (v - 0.5) / max(u, 1e-300)
        k = math.floor(x)
        if least <= k <= most and 2 * math.log(max(u, 1e-300)) <= log_weight(k) - top:
            return k


def split(rng: np.random.Generator, sizes: list[int], sample: int) -> list[int]:
    """How many of a sample without replacement are of each kind, of which there are ``sizes``."""
    left, taken = sum(sizes), []
    for size in sizes:
        n = hypergeometric(rng, size, left - size, sample)
        taken.append(n)
        left, sample = left - size, sample - n
    return taken


def matrix_row(counts: list[int], sizes: list[int], partition: int, seed: int) -> list[int]:
    """Row ``partition`` of the matrix of counts: rows sum to ``counts``, columns to ``sizes``."""
    before = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64))])
    low, high = 0, len(counts)
    while high - low > 1:
        middle = (low + high) // 2
        left = split(np.random.default_rng([seed, low, high]), sizes, int(before[middle] - before[low]))
        if partition < middle:
            high, sizes = middle, left
        else:
            low, sizes = middle, [a - b for a, b in zip(sizes, left, strict=True)]
    return sizes


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _is_scan(df: DataFrame) -> bool:
    """Whether df is files, projected and filtered: the same rows in the same order at each reading."""
    plan = df._jdf.queryExecution().optimizedPlan()
    todo, kinds = [plan], set()
    while todo:
        node = todo.pop()
        kinds.add(node.nodeName().split(" ")[0])
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return kinds <= {"Project", "Filter", "Relation", "LogicalRelation", "LocalRelation"}


def _cards(counts: list[int], sizes: list[int], partition: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, random key) of each row of a partition."""
    rng = np.random.default_rng([seed, 1, partition])
    mine = counts[partition] if partition < len(counts) else 0
    row = matrix_row(counts, sizes, partition, seed) if mine else []
    cards = rng.permutation(np.repeat(np.arange(len(row), dtype=np.int32), row)) if mine else np.zeros(0, np.int32)
    return cards, rng.integers(0, 1 << 62, mine)


def _section(key: np.ndarray, sections: int) -> np.ndarray:
    return ((key >> 31) * sections >> 31).astype(np.int32)


def shard(docs: DataFrame, shards: int, seed: int = 0, section: int = SECTION) -> DataFrame:
    """docs with ``shard`` and ``position``, a row's place from 0 in its shard; sizes differ by one at most."""
    if not _is_scan(docs):
        docs = cut(docs)
    spark = docs.sparkSession
    kept = [x for x in docs.schema if x.name not in ("shard", "position")]
    names = [x.name for x in kept]
    found = {p: n for p, n in docs.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()}
    counts = [found.get(p, 0) for p in range(max(found, default=0) + 1)]
    sizes = shard_sizes(sum(counts), shards)
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # where the plan has no estimate of its size, a section has 64 rows at least
    sections = max(1, min(-(-size // (shards * section)), sum(counts) // shards // 64))
    shared = spark.sparkContext.broadcast(counts)
    at = [unused(x, docs) for x in ("section", "key", "shard", "position")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        cards, keys = _cards(shared.value, sizes, partition, seed)
        here = 0
        for batch in batches:
            end = here + batch.num_rows
            if end > len(cards):
                break
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(_section(keys[here:end], sections)), pa.array(keys[here:end]), pa.array(cards[here:end])], [*names, *at[:3]])
            here = end
        else:
            if here == len(cards):
                return
        raise RuntimeError(f"partition {partition} doesn't have the {len(cards)} rows that were counted")

    def rehearse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for partition in batch.column("id").to_pylist():
                cards, keys = _cards(shared.value, sizes, partition, seed)
                place, n = np.unique(cards.astype(np.int64) * sections + _section(keys, sections), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((place // sections).astype(np.int32)), pa.array((place % sections).astype(np.int32)), pa.array(n)], [at[2], at[0], "n"])

    by = Window.partitionBy(at[2]).orderBy(at[0]).rowsBetween(Window.unboundedPreceding, -1)
    dealt = map_rows(docs, deal, StructType(list(kept)).add(at[0], IntegerType()).add(at[1], LongType()).add(at[2], IntegerType()))
    begin = F.lit(0)
    if sections > 1:
        told = spark.range(0, len(counts), 1, len(counts)).mapInArrow(released(rehearse), f"{at[2]} int, {at[0]} int, n bigint").groupBy(at[2], at[0]).agg(F.sum("n").alias("n"))
        begin = unused("begin", docs)
        told = told.select(at[2], at[0], F.coalesce(F.sum("n").over(by), F.lit(0)).alias(begin))
        dealt, begin = dealt.join(told, [at[2], at[0]]), F.col(begin)
    place = F.row_number().over(Window.partitionBy(at[2], at[0]).orderBy(at[1])) - 1 + begin
    dealt = dealt.withColumn(at[3], place.cast("long"))
    return dealt.select(*map(quoted, names), F.col(at[2]).alias("shard"), F.col(at[3]).alias("position"))
