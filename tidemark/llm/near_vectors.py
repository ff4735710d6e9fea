"""Near-duplicate embeddings: a subspace pigeonhole join under a cosine threshold.

Unit vectors at cosine c are sqrt(2 - 2c) apart. A fixed rotation spreads that distance over all
coordinates, then they are cut into blocks; if every block's squared distance exceeded its share of
the budget (its part of the dimensions), the whole would exceed the budget. So each link is
within the share in at least one block, and each block is range-joined on its own:

* along the block's first coordinate vectors fall into slabs as wide as the block's radius; a
  vector is at home in its slab and a guest in the one below, so partners meet in one slab;
* a slab of more than ``TILE`` rows is dealt by an id hash into parts, and every two parts meet in
  a task of their own, so memory is bounded however full a slab is;
* in a task, pairs within the block's share that no earlier block admits (each pair counts
  once) are verified exactly by the cosine in double precision. Pairs stay in the task: it returns
  links per vector and the local component of each linked vector.

Equal vectors of one label are merged first and counted by weight. Defined results: vectors that
are null, empty, zero or hold null or non-finite components, and those with a null label or
null vec_id, link with nothing. Vectors of different length never link. Rows that share a vec_id
are one vector, the largest by (label, embedding).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, ship, stored

ship(__name__)

COSINE = 0.93
BLOCK_DIMS = 16
TILE = 4096
STEP = 512
SLACK = 1e-9


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int, cosine: float) -> list[tuple[int, int, float]]:
    """(begin, end, squared distance allowed) of every block."""
    cuts = [*range(0, dims, BLOCK_DIMS), dims]
    budget = 2 - 2 * cosine
    return [(a, b, budget * (b - a) / dims + SLACK) for a, b in zip(cuts, cuts[1:], strict=False)]


def units(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Rows as double unit vectors, and the same rotated."""
    x = np.asarray(vectors, dtype=np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x, x @ rotation(x.shape[1])


def _slabs(cosine: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, same in batch.groupby(batch["embedding"].map(len)):
                same = same.reset_index(drop=True)
                x = units(list(same["embedding"]))[1]
                slabs = np.stack([
                    np.floor(x[:, a] / (np.sqrt(share) * (1 + SLACK)))
                    for a, _, share in blocks_of(x.shape[1], cosine)], axis=1).astype(np.int64)
                same["slabs"] = list(slabs)
                yield same

    return run


def components(joined: np.ndarray) -> np.ndarray:
    """Smallest index of each row's component in a symmetric link matrix, -1 without links."""
    label = np.full(len(joined), -1)
    for i in np.flatnonzero(joined.any(1)):
        if label[i] >= 0:
            continue
        label[i] = i
        front = np.array([i])
        while len(front):
            near = joined[front].any(0) & (label < 0)
            front = np.flatnonzero(near)
            label[front] = i
    return label


def _links(cosine: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block, one, two = key[2], key[4], key[5]
        rows = rows.sort_values("node", ignore_index=True)
        x, y = units(list(rows["embedding"]))
        home = rows["home"].to_numpy()
        part = rows["part"].to_numpy()
        shares = blocks_of(x.shape[1], cosine)[:block + 1]
        n = len(rows)
        joined = np.zeros((n, n), bool)
        weight, counts = rows["weight"].to_numpy(), np.zeros(n, np.int64)
        for i in range(0, n, STEP):
            for j in range(i, n, STEP):
                a, b = slice(i, i + STEP), slice(j, j + STEP)
                ok = home[a, None] | home[None, b]
                if one != two:
                    ok &= part[a, None] != part[None, b]
                for k, (lo, hi, share) in reversed(list(enumerate(shares))):
                    u, v = y[a, lo:hi], y[b, lo:hi]
                    gap = (u * u).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * u @ v.T
                    ok &= (gap <= share) == (k == block)
                    if not ok.any():
                        break
                else:
                    ok &= x[a] @ x[b].T >= cosine
                    if i == j:
                        np.fill_diagonal(ok, False)
                    joined[a, b] |= ok
                    joined[b, a] |= ok.T
                    counts[a] += ok @ weight[b]
                    if i != j:
                        counts[b] += ok.T @ weight[a]
        label = components(joined)
        has = label >= 0
        node = rows["node"].to_numpy()
        return pd.DataFrame({"node": node[has], "n": counts[has], "least": node[label[has]]})

    return run


def near_groups(vectors: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """Per vector: vec_id, n_links, component_id (smallest vec_id reachable), kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    rows = rows.groupBy("vec_id").agg(F.max(F.struct("label", "embedding")).alias("r"))
    rows = stored(rows.select("vec_id", "r.label", "r.embedding"), "vectors")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    good = rows.where(good)
    merged = good.groupBy("label", "embedding").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"))
    slabbed = stored(merged.mapInPandas(_slabs(cosine), "label {}, embedding {}, node long, weight long, slabs array<long>".format(
        rows.schema["label"].dataType.simpleString(), rows.schema["embedding"].dataType.simpleString())), "slabs")
    group = ["dims", "label", "block", "slab"]
    places = slabbed.select("node", F.size("embedding").alias("dims"), "label", F.posexplode("slabs").alias("block", "at"))
    places = places.select("node", "dims", "label", "block", F.explode(F.array(
        F.struct(F.col("at").alias("slab"), F.lit(True).alias("home")),
        F.struct((F.col("at") - 1).alias("slab"), F.lit(False).alias("home")))).alias("p"))
    places = places.select("node", "dims", "label", "block", "p.slab", "p.home")
    full = places.groupBy(*group).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    full = full.withColumn("parts", F.ceil(F.col("rows") / tile).cast("long"))
    placed = places.join(full, group).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    tiles = placed.withColumn("with", each).select(
        "node", *group, "home", "part", F.least("part", "with").alias("one"), F.greatest("part", "with").alias("two"))
    tiles = tiles.join(slabbed.select("node", "embedding", "weight"), "node")
    found = stored(tiles.groupBy(*group, "one", "two").applyInPandas(
        _links(cosine), "node long, n long, least long"), "links")
    linked = found.groupBy("node").agg(F.sum("n").alias("n"))
    nodes = connected_components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    of_node = slabbed.select("label", "embedding", "node", "weight").join(linked, "node", "left").join(nodes, "node", "left")
    of_node = of_node.select("label", "embedding", F.coalesce("component", "node").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    known = good.select("vec_id", "label", "embedding").join(of_node, ["label", "embedding"]).select(
        "vec_id", "n_links", "component_id")
    out = rows.select("vec_id").join(known, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
