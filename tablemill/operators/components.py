"""Which nodes of a graph hang together."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed

#: Links that a task looks at together; its memory is a few numbers for each.
CHUNK = 1 << 20


def contracted(links: DataFrame) -> DataFrame:
    """(u, v): fewer links between whole numbers, which connect the same nodes.

    Each task replaces what it holds, CHUNK links at a time, by one link from every node to the smallest node it reaches.
    Where links of one part of a graph lie together, chains of any length become stars at once.
    """

    def contract(batches):
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= CHUNK:
                yield _stars(held)
                held, size = [], 0
        if held:
            yield _stars(held)

    return links.select(F.col(links.columns[0]).cast("long").alias("u"), F.col(links.columns[1]).cast("long").alias("v")).mapInArrow(
        contract, "u long, v long"
    )


def _stars(held: list) -> pa.RecordBatch:
    u, v = (np.concatenate(x) for x in zip(*held))
    nodes, place = np.unique(np.r_[u, v], return_inverse=True)
    a, b, up = place[: len(u)], place[len(u) :], np.arange(len(nodes))
    while True:
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        if (low == high).all():
            break
        np.minimum.at(up, high, low)
        while (up[up] != up).any():
            up = up[up]
    far = up != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[up[far]])], names=["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; a component is named by its smallest node.

    Nodes that hang on one smaller node only leave first, and take that one's component in the end; so pairs and stars are
    done before any round. What is left goes through large-star and small-star steps in turn (Kiveris et al. 2014), each an
    aggregate for the smallest neighbour and a join, so no task holds the neighbours of a node together. After each round the
    nodes that hang on one leave again. The number of rounds grows with the logarithm of the longest chain. Each round is checkpointed.
    """
    links = checkpointed(edges.select(F.col(edges.columns[0]).alias("u"), F.col(edges.columns[1]).alias("v")).where("u <> v"))
    if links.isEmpty():
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    leaves, links = _leaves(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    layers = [leaves]
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        wide = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = wide.groupBy("u").agg(F.min("v").alias("m"))
        narrow = wide.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        round_ = checkpointed(
            narrow.unionByName(smallest.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        leaves, links = _leaves(round_)
        layers.append(leaves)
    named = layers[-1].select(F.col("u").alias("node"), F.col("v").alias("component"))
    for leaves in reversed(layers[:-1]):
        above = leaves.join(named, F.col("v") == F.col("node"), "left")
        # Written, as each layer looks at the one before twice.
        named = checkpointed(named.unionByName(above.select(F.col("u").alias("node"), F.coalesce("component", "v").alias("component"))))
    heads = named.select("component").distinct()
    return named.unionByName(heads.select(F.col("component").alias("node"), "component"))


def _leaves(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links (u > v, each once) whose u has no other link, and the rest."""
    ends = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node")))
    degrees = ends.groupBy("node").agg((F.count("*") == 1).alias("leaf"))
    marked = checkpointed(links.join(degrees, F.col("u") == F.col("node")).select("u", "v", "leaf"))
    return marked.where("leaf").drop("leaf"), marked.where("not leaf").drop("leaf")
