"""Links within groups of fingerprints, and connected components over links.

A group of n mutually close items has about n*n/2 links. What later steps need is only who
is connected with whom, so each group gives a spanning forest of its links: at most n-1 rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from courtside.workspace import staged

# Up to this size a group is compared as one matrix (at most 256 K cells).
MATRIX = 512
# Rows of one key that one task compares, unless its key is cut into blocks; and counters for finding such keys.
GROUP_ROWS, SLOTS = 50_000, 1 << 16

Verify = Callable[[int, np.ndarray], np.ndarray]


def distances(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ many)


class _Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))
        self.left: list[int] = []
        self.right: list[int] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.left.append(i)
        self.right.append(j)
        return True


def spanning_links(prints: np.ndarray, reach: int, verify: Verify | None = None) -> tuple[list[int], list[int]]:
    """A spanning forest of the links of one group: pairs within ``reach`` bits that ``verify``.

    ``verify(i, others)`` gives a mask over the indexes ``others``. Small or loosely filled
    groups are compared as a matrix. Otherwise items gather around centres: the first item
    left becomes a centre and is compared with every item, so the items it links need no
    comparison among themselves. Two gatherings that stay apart are compared member by
    member, unless their centres are over three reaches away, when no pair can link.
    """
    n = len(prints)
    forest = _Forest(n)
    if n <= MATRIX:
        close = np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= reach, 1)
        if close.sum() <= 8 * n:
            for i in np.flatnonzero(close.any(axis=1)).tolist():
                others = np.flatnonzero(close[i])
                if verify is not None:
                    others = np.array([j for j in others.tolist() if forest.root(i) != forest.root(j)], dtype=np.int64)
                    if len(others):
                        others = others[verify(i, others)]
                for j in others.tolist():
                    forest.join(i, j)
            return forest.left, forest.right
    everyone = np.arange(n)
    waiting = np.ones(n, dtype=bool)
    gatherings: list[np.ndarray] = []
    gathering_of = np.full(n, -1)
    while True:
        first = int(np.argmax(waiting))
        if not waiting[first]:
            break
        near = np.flatnonzero(distances(prints[first], prints) <= reach)
        near = near[near != first]
        if verify is not None and len(near):
            near = near[verify(first, near)]
        waiting[first] = False
        fresh = near[waiting[near]]
        gathering_of[first] = gathering_of[fresh] = len(gatherings)
        waiting[fresh] = False
        gatherings.append(np.concatenate(([first], fresh)))
        # One link to each gathering that is reached, and one to each new member.
        for j in fresh.tolist():
            forest.join(first, j)
        _, one_each = np.unique(gathering_of[near], return_index=True)
        for j in near[one_each].tolist():
            forest.join(first, j)
    wide = [g for g in gatherings if len(g) > 1]
    if len(wide) > 1:
        centres = np.array([prints[g[0]] for g in wide])
        for k, members in enumerate(wide):
            for m in range(k + 1, len(wide)):
                if distances(centres[k], centres[m]) > 3 * reach or forest.root(members[0]) == forest.root(wide[m][0]):
                    continue
                for i in members[1:].tolist():
                    others = wide[m][1:]
                    others = others[distances(prints[i], prints[others]) <= reach]
                    if verify is not None and len(others):
                        others = others[verify(i, others)]
                    if len(others):
                        forest.join(i, int(others[0]))
                        break
    return forest.left, forest.right


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal neighbours."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return starts, np.diff(np.concatenate((starts, [len(keys)])))


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by ``key`` again, cut so that no group of equal keys is torn apart."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        if held and held[-1].column(key)[-1] == keys[batch.num_rows - 1]:
            held.append(batch)  # still inside the group that was open
            continue
        starts, _ = runs(keys.to_numpy(zero_copy_only=False))
        cut = int(starts[-1])
        if cut or held:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def spread_groups(rows: DataFrame, key: str, by: str, limit: int = GROUP_ROWS) -> DataFrame:
    """``rows`` with ``group``, a number that stands for ``key``, where every group fits a task.

    Rows are counted by key, hashed into SLOTS counters, so counting combines before its shuffle and
    the list of large slots is bounded. A key in a slot of more than ``limit`` rows (or four times the
    mean) is cut into blocks by a hash of ``by``, and each pair of blocks becomes a group: every two rows
    of the key still meet, in groups of about twice the limit, in as many tasks as there are pairs.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")
    counted = rows.groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("n"))
    slots = staged(counted, "group-sizes")
    mean = slots.agg(F.avg("n")).first()[0] or 0
    most = max(limit, int(4 * mean))
    large = slots.where(F.col("n") > most).select("_slot", F.ceil(F.col("n") / F.lit(most)).cast("int").alias("_blocks"))
    plain = F.col(key).cast("bigint")
    if large.isEmpty():
        return rows.withColumn("group", plain)
    # At most SLOTS / 4 pairs of numbers, so the broadcast is bounded.
    marked = rows.withColumn("_slot", slot).join(F.broadcast(large), "_slot", "left").fillna({"_blocks": 1})
    block = F.pmod(F.xxhash64(by), F.col("_blocks")).cast("int")
    met = marked.withColumn("_block", block).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    pair = F.least("_block", "_other").cast("bigint") * F.col("_blocks") + F.greatest("_block", "_other")
    group = plain + F.shiftleft(pair, 32)
    return met.withColumn("group", group).drop("_slot", "_blocks", "_block", "_other")


def group_links(keys: np.ndarray, prints: np.ndarray, reach: int, small: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Linked index pairs of many sorted groups; small groups all at once, larger ones one by one."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    starts, sizes = runs(keys)
    size_of = np.repeat(sizes, sizes)
    for step in range(1, min(small, len(keys))):
        at = np.flatnonzero((keys[step:] == keys[:-step]) & (size_of[step:] <= small))
        at = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= reach]
        left.append(at)
        right.append(at + step)
    for start, size in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist()):
        a, b = spanning_links(prints[start : start + size], reach)
        left.append(np.array(a, dtype=np.int64) + start)
        right.append(np.array(b, dtype=np.int64) + start)
    return np.concatenate(left), np.concatenate(right)


def components(links: DataFrame, label: str) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is its component's smallest node.

    Alternates two steps until nothing changes: each node's larger neighbours move to its
    smallest neighbour, then each node and its smaller neighbours do. Every round is written
    to the shared folder, so a lost executor costs one round at most. Counts and minima
    combine before their shuffle, and the joins are plain ones that Spark may split.
    """
    ends = links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    ends = ends.where("a <> b and a is not null and b is not null")
    current = staged(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-links")
    seen = None
    while True:
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        starred = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Every row of ``starred`` points from a larger node to a smaller one.
        lowest = starred.groupBy("a").agg(F.min("b").alias("m"))
        joined = starred.join(lowest, "a")
        moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        kept = lowest.select("a", F.col("m").alias("b"))
        current = staged(moved.unionByName(kept).distinct(), f"{label}-links")
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
