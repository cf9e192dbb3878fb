"""Near-duplicate embeddings, by tiled comparison along principal components.

Vectors of length 1 are turned into the axes of the corpus' principal components, so that leading dimensions hold most
of what tells vectors apart. Vectors of one label are dealt into cells of a grid over the two leading components: two
vectors with cosine ``t`` or more are at most sqrt(2 - 2 t) apart, so a cell of that width needs its neighbours only.
Cells are cut into tiles of bounded size, and pairs of tiles are compared: the inner product of the leading dimensions
comes first, the rest of a pair is bounded by the product of its suffix norms, and a pair whose bound can't reach the
threshold is dropped. Survivors are decided by their cosine over the vectors as given, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelineage.llm.common import checkpoint, components

TILE = 1024  # vectors
BLOCK = 16  # dimensions that are accumulated before a bound is taken
SLACK = 1e-9  # of the bound, for rounding


def usable(rows: DataFrame) -> DataFrame:
    """Vectors that can have links, as doubles. Null, zero and non-finite ones and those without a label can't."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(v, lambda x: x != 0)
    return rows.where(ok).select("vec_id", "label", v.alias("v"))


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def stack(column: pd.Series, dim: int) -> np.ndarray:
    """Rows as one matrix; shorter vectors end in zeros, which changes no inner product."""
    out = np.zeros((len(column), dim))
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def principal_axes(classes: DataFrame, dim: int) -> np.ndarray:
    """Axes by falling variance, from sums over all vectors; what reaches the driver is dim x dim for each partition, added up there."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, first, n = np.zeros((dim, dim)), np.zeros(dim), 0
        for b in batches:
            if len(b):
                x = unit(stack(b["v"], dim))
                total += x.T @ x
                first += x.sum(0)
                n += len(x)
        yield pd.DataFrame({"k": np.arange(dim + 1), "row": [*map(list, total), list(first)], "n": n})

    rows = classes.select("v").mapInPandas(sums, "k int, row array<double>, n long")
    flat = rows.select("k", "n", F.posexplode("row").alias("j", "x")).groupBy("k", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    m, n = np.zeros((dim + 1, dim)), 1
    for r in flat:
        m[r.k, r.j], n = r.x, max(1, r.n)
    mean = m[dim] / n
    return np.linalg.eigh(m[:dim] / n - np.outer(mean, mean))[1][:, ::-1].copy()


def links_between(a: np.ndarray, b: np.ndarray, ua: np.ndarray, ub: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two tiles with cosine >= threshold. ``a``, ``b``: along the axes; ``ua``, ``ub``: as given, length 1."""
    dim = a.shape[1]
    dots = np.zeros((len(a), len(b)))
    for at in range(0, dim, BLOCK):
        dots += a[:, at : at + BLOCK] @ b[:, at : at + BLOCK].T
        rest_a, rest_b = (np.sqrt(np.maximum(0, (x[:, at + BLOCK :] ** 2).sum(1))) for x in (a, b))
        alive = dots + rest_a[:, None] * rest_b[None] >= threshold - SLACK
        i, j = np.nonzero(alive)
        if len(i) * dim < alive.size or at + BLOCK >= dim:  # few are left: compute those alone
            break
    out_i, out_j = [], []
    for at in range(0, len(i), 1 << 16):
        x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        ok = (ua[x] * ub[y]).sum(1) >= threshold
        out_i.append(x[ok])
        out_j.append(y[ok])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (i, j)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest node that each of ``n`` nodes reaches over the edges."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(rows: DataFrame, threshold: float = 0.93) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of each row of ``rows`` (``vec_id``, ``embedding``, ``label``).

    Vectors with equal labels and cosine >= ``threshold`` are linked.

    Defined cases: vectors that are null, empty, zero or hold a null or non-finite component, those without a label or
    id, and vectors of different lengths link with nothing; rows with equal vectors, label and length are linked with
    each other (equal vectors form one class, which is compared once, whatever its size); an empty table gives an empty
    result; other columns are not used.
    """
    ok = checkpoint(usable(rows))
    classes = checkpoint(ok.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))
    dim = classes.agg(F.coalesce(F.max(F.size("v")), F.lit(1))).first()[0]
    axes = principal_axes(classes, dim)
    width = math.sqrt(2 - 2 * threshold) + 1e-6

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = unit(stack(b["v"], dim)) @ axes if len(b) else np.zeros((0, dim))
            cell = np.floor(x[:, : min(2, dim)] / width).astype(int)
            y = cell[:, 1] if dim > 1 else 0 * cell[:, 0]
            yield pd.DataFrame({"label": b["label"], "size": [len(v) for v in b["v"]], "x": cell[:, 0], "y": y, "id": b["id"], "n": b["n"], "v": b["v"]})

    kind = rows.schema["label"].dataType.simpleString()
    cells = classes.mapInPandas(turn, f"label {kind}, size int, x int, y int, id long, n long, v array<double>")
    # Cells of over TILE vectors are cut by a hash of the id; sizes come from a count, so a hot cell never meets whole.
    key = ["label", "size", "x", "y"]
    counts = cells.groupBy(*key).agg(F.ceil(F.count("*") / TILE).cast("int").alias("cuts"))
    cut = cells.join(counts, key).withColumn("part", F.pmod(F.xxhash64("id"), "cuts").cast("int"))
    tiles = checkpoint(cut.groupBy(*key, "cuts", "part").agg(F.collect_list(F.struct("id", "n", "v")).alias("rows")))
    # Every tile meets the tiles of its own cell and of the eight around it, each pair once.
    names = checkpoint(tiles.select(*key, "cuts", "part"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    left = names.select("label", "size", F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("part").alias("pa"), F.explode(around).alias("to"))
    left = left.select("*", (F.col("xa") + F.col("to.i")).alias("xb"), (F.col("ya") + F.col("to.j")).alias("yb")).drop("to")
    right = names.select("label", "size", F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("part").alias("pb"))
    pairs = left.join(right, ["label", "size", "xb", "yb"]).where((F.col("xa") != F.col("xb")) | (F.col("ya") != F.col("yb")) | (F.col("pa") <= F.col("pb")))
    side = lambda s: tiles.select("label", "size", F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}"), F.col("part").alias(f"p{s}"), F.col("rows").alias(f"rows_{s}"))
    both = pairs.join(side("a"), ["label", "size", "xa", "ya", "pa"]).join(side("b"), ["label", "size", "xb", "yb", "pb"])
    both = both.withColumn("same", (F.col("xa") == F.col("xb")) & (F.col("ya") == F.col("yb")) & (F.col("pa") == F.col("pb")))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ra, rb, same in zip(b["rows_a"], b["rows_b"], b["same"], strict=True):
                ida, idb = (np.array([r["id"] for r in x]) for x in (ra, rb))
                na, nb = (np.array([r["n"] for r in x]) for x in (ra, rb))
                ua, ub = (unit(stack([r["v"] for r in x], dim)) for x in (ra, rb))
                i, j = links_between(ua @ axes, ub @ axes, ua, ub, threshold)
                if same:
                    i, j = i[i < j], j[i < j]
                m = len(ida)
                links = np.zeros(m + len(idb), np.int64)
                np.add.at(links, i, nb[j])
                np.add.at(links, m + j, na[i])
                # A spanning set of the links serves for components: each vector and the smallest that it reaches here.
                ids = np.concatenate([ida, idb])
                order = np.argsort(ids, kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(len(ids))
                root = ids[order][forest(place[i], place[m + j], len(ids))][place]
                some = links > 0
                yield pd.DataFrame({"id": ids[some], "links": links[some], "root": root[some]})

    found = checkpoint(both.select("rows_a", "rows_b", "same").mapInPandas(compare, "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    members = ok.join(classes.select("label", "v", "id", "n"), ["label", "v"]).select("vec_id", "id", "n")
    edges = found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(members.select(F.col("id").alias("a"), F.col("vec_id").alias("b")))
    reached = components(edges)
    n_links = members.join(links, "id", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_links"))
    n_links = n_links.groupBy("vec_id").agg(F.max("_links").alias("_links"))  # rows with one id and different vectors
    out = rows.select("vec_id").join(n_links, "vec_id", "left").join(reached.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id")))
