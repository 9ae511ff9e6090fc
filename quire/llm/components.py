"""Connected components of a link table by alternating large-star and small-star rounds.

Every round is two joins over (node, node) rows with map-side minima; nothing is collected
and a node of very many links never meets them in one task beyond its minimum. Rounds are
written to the shared folder, so a lost executor costs a re-read, not the whole lineage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes, given links a[i] - b[i]."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        ra, rb = ra[open_], rb[open_]
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:  # pointer jumping
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for every node that has a link; root is the smallest node of its component.

    ``links`` has columns a, b (any orderable type; order and repeats do not matter). Self
    links and null ends are ignored. No links: no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()
    edges = materialise(edges, "links")
    before = None
    for _ in range(max_rounds):
        # large star: neighbours above u hang under u's smallest neighbour (or u)
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = both.groupBy("node").agg(F.min("root").alias("m"))
        large = both.join(low, "node").where("root > node").select(
            F.col("root").alias("node"), F.least("m", "node").alias("root")
        ).where("node <> root").distinct()
        # small star: u and its neighbours below hang under the smallest of them
        low = large.groupBy("node").agg(F.min("root").alias("m"))
        j = large.join(low, "node")
        small = j.where("root <> m").select(F.col("root").alias("node"), F.col("m").alias("root")).unionByName(
            low.select("node", F.col("m").alias("root"))
        ).distinct()
        edges = materialise(small, "links")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return edges
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
