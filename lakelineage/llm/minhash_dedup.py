"""Near-duplicate documents, by an LSH forest over MinHash signatures and exact checks on full shingle sets.

1. Documents with equal shingle sets are one class; only its smallest id goes on.
2. A class's signature is cut into TREES runs of DEPTH hashes. Each run is the key of a sorted order (a tree).
3. Neighbours in a sorted order share a longest common prefix. A region is a stretch that shares a prefix; it starts at
   FLOOR hashes and is cut deeper while it has more than REGION members. A region of at most REGION members gives all
   its pairs, a larger one pairs of neighbours along its order, and its deeper parts theirs.
4. Candidates are checked on full sets, those of the first trees first; later ones only where the components found so
   far don't already join them. What counts is which documents are joined, so no link between components is lost.
5. A region that is too large at full depth is a crowd. Where the links found leave a crowd in several components, all
   its members are compared on full sets, TILE by TILE, but for pairs that are joined already. The cost grows with the
   square of such a crowd; a crowd that is one component costs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelineage.llm.common import checkpoint, components

TREES, DEPTH, FLOOR = 20, 8, 3
REGION = 16
TILE = 256  # members of a crowd on either side of a comparison
COLUMNS = 4096  # shingles that a comparison multiplies at a time
FIRST_TREES = 4
CACHE = 300_000  # words whose hashes a task keeps

_rng = np.random.default_rng(20)
XOR = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
TIMES = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
PLACE = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingler:
    """Sorted arrays of the 64-bit hashes of a text's distinct shingles of ``size`` words."""

    def __init__(self, size: int) -> None:
        self.size, self.words = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint64)
        words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and space and \x09-\x0D alone
        if not words:
            return np.zeros(0, np.uint64)
        known, digest = self.words, xxhash.xxh3_64_intdigest
        if len(known) > CACHE:
            known.clear()
        try:
            h = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = digest(w)
            h = np.array([known[w] for w in words], np.uint64)
        k = min(self.size, len(h))
        n = len(h) - k + 1
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out = (out ^ h[j : j + n]) * PLACE[j % len(PLACE)]
            out ^= out >> np.uint64(31)
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(XOR), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024, None] ^ XOR
        part *= TIMES
        np.minimum(best, part.min(0), out=best)
    return best


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``digest`` of the set and ``sig`` of each document with words; others have null digests."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(size)
        for b in batches:
            n, digest, sig = [], [], []
            for t in b["text"]:
                s = shingle(t)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s).astype(">u4").tobytes() if len(s) else None)
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_shingles": n, "digest": digest, "sig": sig})

    return docs.select("doc_id", "text").mapInPandas(apply, "doc_id long, n_shingles long, digest binary, sig binary")


def region_pairs(tree: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (positions) of a sorted order. ``key``: rows of DEPTH hashes, sorted within ``tree``."""
    n = len(key)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.cumprod(np.concatenate([(tree[1:] == tree[:-1])[:, None], key[1:] == key[:-1]], 1), 1)
    lcp = same[:, 1:].sum(1)  # of each entry and the next
    left, right = [], []
    open_ = np.ones(n - 1, bool)  # neighbours whose region isn't done
    for depth in range(FLOOR, DEPTH + 1):
        joined = (lcp >= depth) & open_
        run = np.concatenate(([0], np.cumsum(~joined)))
        size = np.bincount(run)
        small = size[run] <= REGION
        i = np.flatnonzero(small)
        for step in range(1, REGION):
            i = i[i + step < n]
            i = i[run[i] == run[i + step]]
            if not len(i):
                break
            left.append(i)
            right.append(i + step)
        i = np.flatnonzero(joined & ~small[:-1])  # neighbours along a region that is too large for all its pairs
        left.append(i)
        right.append(i + 1)
        i = i[i + 2 < n]
        i = i[run[i] == run[i + 2]]
        left.append(i)
        right.append(i + 2)
        if depth == DEPTH:
            big = np.flatnonzero(~small)  # and with the head of a stretch of equal keys
            head = np.searchsorted(run, run[big])
            left.append(head[head < big])
            right.append(big[head < big])
        open_ = joined & ~small[:-1]
        if not open_.any():
            break
    # Neighbours stay neighbours at greater depths: each pair once.
    at = np.unique(np.concatenate(left) * n + np.concatenate(right))
    return at // n, at % n


def crowds(tree: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heads and members (positions) of stretches of over REGION equal keys."""
    n = len(key)
    if n <= REGION:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    run = np.concatenate(([0], np.cumsum((tree[1:] != tree[:-1]) | (key[1:] != key[:-1]).any(1))))
    member = np.flatnonzero(np.bincount(run)[run] > REGION)
    head = np.searchsorted(run, run[member])
    return head[head < member], member[head < member]


def unpack(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["key"]), ">u4").reshape(-1, DEPTH).astype(np.uint32)


def pair_rows(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Candidate pairs with their tree, and heads and members of crowds with TREES in its place."""
    tree, ids, size, key = rows["tree"].to_numpy(), rows["id"].to_numpy(), rows["n"].to_numpy(), unpack(rows)
    i, j = region_pairs(tree, key)
    fits = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])  # else the sets can't be similar enough
    i, j = i[fits], j[fits]
    head, member = crowds(tree, key)
    of = np.concatenate([tree[i], np.full(len(head), TREES, tree.dtype)])
    i, j = np.concatenate([i, head]), np.concatenate([j, member])
    return pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j]), "tree": of, "key": None, "n": 0})


def walk(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Pairs of a partition of the sorted orders, and the entries at its ends whose region may go on in another partition."""
    rows = [b for b in batches if len(b)]
    if not rows:
        return
    part = pd.concat(rows, ignore_index=True)
    yield pair_rows(part, percent)
    key, tree = unpack(part)[:, :FLOOR], part["tree"].to_numpy()
    ends = np.unique(np.concatenate([np.arange(min(REGION, len(part))), np.arange(max(0, len(part) - REGION), len(part))]))
    like = lambda k: (tree[ends] == tree[k]) & (key[ends] == key[k]).all(1)
    yield part.iloc[ends[like(0) | like(-1)]].rename(columns={"id": "a"}).assign(b=-1)[["a", "b", "tree", "key", "n"]]


def candidates(reps: DataFrame, percent: int) -> DataFrame:
    """``a``, ``b`` and the first ``tree`` that brings them together. ``reps``: ``id``, ``n``, ``sig``.

    Rows whose ``tree`` is TREES are two members of a crowd and no candidates.
    """

    def plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [s[t * DEPTH * 4 : (t + 1) * DEPTH * 4] for t in range(TREES) for s in b["sig"]]
            yield pd.DataFrame({"tree": np.repeat(np.arange(TREES, dtype=np.int32), len(b)), "key": keys, "id": np.tile(b["id"], TREES), "n": np.tile(b["n"], TREES)})

    spark = reps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = reps.mapInPandas(plant, "tree int, key binary, id long, n long")
    order = entries.repartitionByRange(parts, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    found = checkpoint(order.mapInPandas(lambda rows: walk(rows, percent), "a long, b long, tree int, key binary, n long"))
    ends = found.where("key IS NOT NULL").selectExpr("tree", "key", "a AS id", "n", f"substring(key, 1, {4 * FLOOR}) AS region")

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        return pair_rows(rows.sort_values(["key", "id"], ignore_index=True), percent)[["a", "b", "tree"]]

    across = ends.groupBy("tree", "region").applyInPandas(meet, "a long, b long, tree int")
    pairs = found.where("key IS NULL").select("a", "b", "tree").unionByName(across).where("a <> b")
    return pairs.groupBy("a", "b", (F.col("tree") == TREES).alias("_crowd")).agg(F.min("tree").alias("tree")).drop("_crowd")


def verify(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of the full shingle sets."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(need, "doc_id", "left_semi")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b"
    )

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, last = Shingler(size), (None, None)
        for rows in batches:
            ok = np.zeros(len(rows), bool)
            for i, (b, ta, tb) in enumerate(zip(rows["b"], rows["text_a"], rows["text_b"], strict=True)):
                if last[0] != b:
                    last = (b, shingle(tb))
                x, y = shingle(ta), last[1]
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = len(x) > 0 and 100 * common >= percent * (len(x) + len(y) - common)
            yield rows.loc[ok, ["a", "b"]]

    return both.select("a", "b", "text_a", "text_b").mapInPandas(apply, "a long, b long")


def compare(rows: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between components of sets (``id``, ``component``, ``shingles``), as few as join what belongs together."""
    sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
    ids, n = rows["id"].to_numpy(), np.array([len(s) for s in sets])
    start = np.unique(rows["component"].to_numpy(), return_inverse=True)[1]
    owner, all_ = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
    order = np.argsort(all_, kind="stable")
    all_, owner = all_[order], owner[order]
    column = np.concatenate(([0], np.cumsum(all_[1:] != all_[:-1])))
    often = np.bincount(column)[column] > 1  # the others are in no intersection
    owner, column = owner[often], np.unique(column[often], return_inverse=True)[1]
    common = np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        common += (part @ part.T).astype(np.int64)
    linked = (100 * common >= percent * (n[:, None] + n - common)) & (start[:, None] != start)
    above, links = list(range(int(start.max()) + 1)), []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        x, y = start[i], start[j]
        while above[x] != x:
            above[x] = x = above[above[x]]
        while above[y] != y:
            above[y] = y = above[above[y]]
        if x != y:
            above[x] = y
            links.append((int(ids[i]), int(ids[j])))
    return links


def crowd_links(crowds_: DataFrame, links: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Links between the components that ``links`` leave in crowds (``a``, ``b``); None where it leaves one in each.

    Members are dealt into blocks of about TILE. A component of over TILE members has blocks of its own, which aren't
    compared with each other.
    """
    joined = checkpoint(components(links))
    member = crowds_.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(joined, "id", "left")
    member = checkpoint(member.withColumn("component_id", F.coalesce("component_id", "id")))
    across = crowds_.select("a", "b")
    for side in ("a", "b"):
        across = across.join(member.select(F.col("id").alias(side), F.col("component_id").alias(f"c{side}")), side)
    across = checkpoint(across.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    if across.isEmpty():
        return None
    crowd = checkpoint(components(across)).select(F.col("id").alias("component_id"), F.col("component_id").alias("crowd"))
    crowd = crowd.unionByName(crowd.select(F.col("crowd").alias("component_id"), "crowd").distinct())
    member = member.join(crowd, "component_id")
    counts = member.groupBy("crowd", "component_id").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("lot", F.when(F.col("_n") > TILE, F.col("component_id")))
    lots = counts.groupBy("crowd", "lot").agg(F.ceil(F.sum("_n") / TILE).alias("blocks"))
    own = counts.join(lots.withColumnsRenamed({"crowd": "_crowd", "lot": "_lot"}), (F.col("crowd") == F.col("_crowd")) & F.col("lot").eqNullSafe(F.col("_lot")))
    own = own.select("component_id", "lot", "blocks")
    place = F.struct(F.col("lot").isNull().alias("mixed"), "lot", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("blocks")).alias("nth"))
    dealt = checkpoint(member.join(own, "component_id").select("id", F.col("component_id").alias("component"), "crowd", place.alias("block")))
    blocks = dealt.select("crowd", "block").distinct()
    one, two = blocks.select("crowd", F.col("block").alias("x")), blocks.select("crowd", F.col("block").alias("y"))
    tiles = one.join(two, "crowd").where("x <= y AND (x.lot IS NULL OR y.lot IS NULL OR x.lot <> y.lot)")
    sides = tiles.select("crowd", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(size)
        for b in batches:
            yield pd.DataFrame({"id": b["doc_id"], "shingles": [shingle(t).tobytes() for t in b["text"]]})

    texts = docs.select("doc_id", "text").join(dealt.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    sets = texts.mapInPandas(shingles, "id long, shingles binary").where("length(shingles) > 0").distinct()
    rows = dealt.join(checkpoint(sets), "id").join(sides, ["crowd", "block"])

    def meet(tile: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(compare(tile, percent), columns=["a", "b"])

    return rows.groupBy("crowd", "x", "y").applyInPandas(meet, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of each row of ``docs`` (``doc_id``, ``text``).

    Documents with 100 * intersection >= ``percent`` * union of their sets of ``size``-word shingles are linked; a
    component is what links reach, its id the smallest ``doc_id`` in it, and that document is kept.

    Defined cases: null, empty and wordless texts have no shingles and are linked with nothing; texts of fewer than
    ``size`` words have one shingle; rows with one id are one document; rows without an id are linked with nothing,
    have a null component and are kept; an empty table gives an empty result; other columns are not used. Texts are
    shingled whole.
    """
    all_ = checkpoint(sketches(docs, size))
    sets = all_.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = sets.groupBy("digest").agg(F.min("doc_id").alias("id"), F.any_value("n_shingles").alias("n"), F.any_value("sig").alias("sig"))
    found = checkpoint(candidates(classes.select("id", "n", "sig"), percent))
    pairs, crowded = found.where(F.col("tree") < TREES), found.where(F.col("tree") == TREES)
    known = docs.where(F.col("doc_id").isNotNull())
    links = checkpoint(verify(pairs.where(F.col("tree") < FIRST_TREES), known, size, percent))
    joined = components(links)
    later = pairs.where(F.col("tree") >= FIRST_TREES)
    for side in ("a", "b"):
        of = joined.select(F.col("id").alias(side), F.col("component_id").alias(f"c{side}"))
        later = later.join(of, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    links = links.unionByName(verify(later.where("ca <> cb").select("a", "b"), known, size, percent))
    if not crowded.isEmpty():
        links = checkpoint(links)
        more = crowd_links(crowded, links, known, size, percent)
        links = links if more is None else links.unionByName(more)
    ids = classes.select(F.col("digest").alias("_digest"), F.col("id").alias("_class"))
    members = sets.join(ids, F.col("digest") == F.col("_digest")).where(F.col("doc_id") != F.col("_class")).select(F.col("_class").alias("a"), F.col("doc_id").alias("b"))
    final = components(links.unionByName(members.distinct()))
    out = all_.select("doc_id", "n_shingles").join(final.select(F.col("id").alias("doc_id"), "component_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows of documents that another document of their component stands for."""
    gone = near_duplicates(docs, size, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")
