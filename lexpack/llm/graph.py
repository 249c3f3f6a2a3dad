"""Connected components of a link table, with rows of links only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexpack.session import cut

#: Links that one task may join up: 8 MB.
ONE_TASK = 1 << 19

def local_labels(n: int, rows) -> np.ndarray:
    """Labels (smallest index) of the components among n nodes; rows: pairs of a node and the array of nodes linked with it."""
    labels = np.arange(n)
    for i, linked in rows:
        found = np.unique(np.append(labels[linked], labels[i]))
        if len(found) > 1:
            labels[np.isin(labels, found)] = found[0]
    return labels


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of every node in the links (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        # Hook the larger root of every link to the smallest root it meets, then let every node point to its root.
        p, q = root[x], root[y]
        high, low = np.maximum(p, q), np.minimum(p, q)
        if (high == low).all():
            return nodes, nodes[root]
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) of every node in ``edges`` (columns a, b of one type, long where one task does it); component: the smallest node reachable.

    Up to ``one_task`` links (counted first; 16 bytes each) are joined up by one task. More are worked on by the large-star and
    small-star operations in turn until neither changes the link table; no neighbourhood is ever gathered, only its minimum,
    which is combined before the shuffle. Rounds grow with the logarithm of the longest chain. Loops and repeated links don't
    matter. Every round is cut into the shared folder.
    """
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = cut(edges.where("a <> b").select(high, low).distinct())
    n, seen = edges.count(), None
    if n <= one_task and dict(edges.dtypes)["a"] == "bigint":

        def join(batches):
            table = pa.Table.from_batches(batches, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
            node, component = forest(table.column("a").to_numpy(), table.column("b").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], names=["node", "component"])

        return edges.repartition(1).mapInArrow(join, "node long, component long")
    while n:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if row == seen:
            break
        seen = row
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
