"""Connected components of a table of links: union-find inside partitions, then rounds between them.

Each partition first replaces its links by a spanning star of every set it can join (union by smallest id), which
shrinks repeated and redundant links.  What remains is solved by alternating large-star and small-star rounds until
a round gives back exactly the links it was given; every round is a written table, so executors may be lost at any
time, and the table before it is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.llm.common import delete_path, materialize_at

HELD = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning stars of the partition's links; after ``HELD`` nodes what is known is sent and forgotten."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars() -> pa.RecordBatch:
        nodes = [x for x in parent if find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array([find(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > HELD:
            yield stars()
            parent.clear()
    yield stars()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node that is in a link; label is the smallest node reachable.  links: (a, b) longs."""
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    spark = links.sparkSession
    now, path = materialize_at(links.mapInArrow(_forest, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    size = now.count()
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node links to the node's smallest neighbour (itself included)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").distinct()
        # small star: a node and its smaller neighbours link to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select("m", "a", "b")
        made = small.select(F.col("m").alias("a"), "b").unionByName(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        new, to = materialize_at(made, "links")
        count = new.count()
        same = count == size and new.join(now, ["a", "b"], "left_anti").isEmpty()  # both are sets
        delete_path(spark, path)
        now, path, size = new, to, count
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
