"""Lineage graph operators over two relations.

``assets``: ``id``, ``name``, ``asset_type``, ``system``, ``source_rank``, ``seq`` and any more. ``edges``: ``source``,
``target``, ``relationship``, ``source_rank``, ``edge_seq``. Edges of every relationship are followed alike. Ends of
edges need not be assets. Iterative operators go a hop (or a doubling) at a time over all roots at once, keep only what
is new, and cut their lineage at each step; they stop when a step adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakelineage import schemas
from lakelineage.functions.lineage import beside, cut, cut_counted

# Fixed value: roots from which on those that lead into few ids are followed as these ids.
MANY_ROOTS = 1000

# --- building ---


def first_wins(rows: DataFrame, *keys: str, order: tuple[str, ...] = ("source_rank", "seq")) -> DataFrame:
    """The first row of each key, by source and place in it."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def dedup_assets(assets: DataFrame) -> DataFrame:
    return first_wins(assets, "id")


def dedup_edges(edges: DataFrame) -> DataFrame:
    return first_wins(edges, "source", "target", "relationship", order=("source_rank", "edge_seq"))


def bridge_edges(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """FEEDS edges from Delta tables to the model tables of the same bare name, where there is none yet."""
    delta = assets.where("asset_type = 'delta_table'").select(F.col("id").alias("source"), F.lower(F.substring_index(F.substring_index("id", "::", -1), ".", -1)).alias("bare"))
    last = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy(F.desc("source_rank"), F.desc("seq")))
    tables = assets.where("asset_type = 'table'").withColumn("_nth", last).where("_nth = 1")
    made = delta.join(tables.select(F.lower("name").alias("bare"), F.col("id").alias("target")), "bare").select("source", "target", F.lit("FEEDS").alias("relationship"))
    return made.join(edges.select("source", "target", "relationship"), ["source", "target", "relationship"], "left_anti").distinct()


def reverse_feeds(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """FEEDS edges against the direction of dependencies, between assets of reversible types, where there is none yet."""
    ok = assets.where(F.col("asset_type").isin(*schemas.REVERSIBLE_TYPES)).select("id").distinct()
    turned = edges.where(F.col("relationship").isin(*schemas.REVERSIBLE_EDGES)).select(F.col("target").alias("source"), F.col("source").alias("target"))
    for end in ("source", "target"):
        turned = turned.join(ok.withColumnRenamed("id", end), end, "left_semi")
    known = edges.where("relationship = 'FEEDS'").select("source", "target")
    return turned.join(known, ["source", "target"], "left_anti").distinct().withColumn("relationship", F.lit("FEEDS"))


# --- reading ---


def neighbors(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``id``, ``direction``, ``neighbor``, ``relationship``: every edge at the ids, parallel edges each."""
    down = edges.join(ids.select(F.col("id").alias("source")), "source").select(F.col("source").alias("id"), F.lit("downstream").alias("direction"), F.col("target").alias("neighbor"), "relationship")
    up = edges.join(ids.select(F.col("id").alias("target")), "target").select(F.col("target").alias("id"), F.lit("upstream").alias("direction"), F.col("source").alias("neighbor"), "relationship")
    return down.unionByName(up)


def turn(edges: DataFrame) -> DataFrame:
    """Edges against their direction, for everything upstream."""
    swap = {"source": "target", "target": "source"}
    return edges.select(*[F.col(c).alias(swap.get(c, c)) for c in edges.columns])


def reach(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, ordered: bool = False) -> DataFrame:
    """``root``, ``id`` and ``depth`` (the least number of hops) of all ids that each root (``id``) reaches, but itself.

    ``ordered`` adds ``pos``, which orders the ids of a depth as a breadth-first search that follows edges in their order
    would find them; a root's ids of one depth are then sorted together. Roots with one way out reach what lies at its end,
    a hop later: where many of them share few such ends, the ends are followed and the roots joined to what they reach.
    """
    hops = edges.groupBy("source", "target").agg(F.min("edge_seq").alias("edge_seq"))
    start = roots.select(F.col("id").alias("root"), "id").distinct()
    front, number = cut_counted(start.select("root", "id", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("pos")))
    if number >= MANY_ROOTS and not ordered and (max_depth is None or max_depth > 1):
        out = hops.groupBy("source").agg(F.count("*").alias("_n"), F.min("target").alias("_to")).where("_n = 1 AND source <> _to")
        one, n = cut_counted(front.select("root").join(out.hint("merge"), F.col("root") == F.col("source")).select("root", "_to"))
        ends, m = cut_counted(one.select(F.col("_to").alias("id")).distinct())
        if n and 2 * m <= n:
            beyond, k = cut_counted(reach(edges, ends, None if max_depth is None else max_depth - 1).select(F.col("root").alias("_to"), "id", "depth"))
            far = one.join(beside(beyond, k), "_to").where("id <> root").select("root", "id", (F.col("depth") + 1).alias("depth"))
            others = front.join(one.select("root").hint("merge"), "root", "left_anti").select("id")
            return far.unionByName(one.select("root", F.col("_to").alias("id"), F.lit(1).alias("depth"))).unionByName(reach(edges, others, max_depth))
    seen, depth = front, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(hops, F.col("id") == F.col("source"))
        if ordered:
            step = step.groupBy("root", "target").agg(F.min(F.struct("pos", "edge_seq")).alias("_by"))
        else:
            step = step.select("root", "target").distinct()
        new = step.withColumnRenamed("target", "id").join(seen.select("root", "id"), ["root", "id"], "left_anti")
        place = F.row_number().over(Window.partitionBy("root").orderBy("_by")).cast("long") if ordered else F.lit(0).cast("long")
        front, n = cut_counted(new.select("root", "id", F.lit(depth).alias("depth"), place.alias("pos")))
        if not n:
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0") if ordered else seen.where("depth > 0").drop("pos")


def known_only(found: DataFrame, assets: DataFrame) -> DataFrame:
    return found.join(assets.select("id", "name", "asset_type", "system"), "id")


def full_impact(found: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets reached, counted by root and system; every system has a row for every root that reaches something."""
    counts = known_only(found, assets).groupBy("root", "system").agg(F.count("*").alias("n"))
    every = found.select("root").distinct().select("root", F.explode(F.array(*map(F.lit, schemas.SYSTEMS))).alias("system"))
    return every.join(counts, ["root", "system"], "left").select("root", "system", F.coalesce("n", F.lit(0)).alias("n"))


def bidirectional(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``root``, ``id``, ``direction``, ``depth``: downstream, and upstream for what isn't downstream as well."""
    down = reach(edges, roots).select("root", "id", F.lit("downstream").alias("direction"), "depth")
    up = reach(turn(edges), roots).select("root", "id", F.lit("upstream").alias("direction"), "depth")
    return down.unionByName(up.join(down.select("root", "id"), ["root", "id"], "left_anti"))


def simple_paths(edges: DataFrame, roots: DataFrame, max_length: int) -> DataFrame:
    """``root``, ``path``: every path without repeated ids from a root, of up to ``max_length`` hops, that can't go on."""
    hops = edges.select("source", "target").distinct()
    front = roots.select(F.col("id").alias("root"), F.array("id").alias("path")).distinct()
    done = None
    for _ in range(max_length):
        longer = front.join(hops, F.element_at("path", -1) == F.col("source"), "left")
        on = F.col("target").isNotNull() & ~F.array_contains("path", F.coalesce("target", F.lit("")))
        grown = cut(longer.select("root", "path", F.when(on, F.concat("path", F.array("target"))).alias("next")))
        ended = grown.groupBy("root", "path").agg(F.count("next").alias("_n")).where("_n = 0").select("root", "path")
        done = ended if done is None else done.unionByName(ended)
        front = grown.where("next IS NOT NULL").select("root", F.col("next").alias("path"))  # distinct, as hops are
        if front.isEmpty():
            return done
    return front if done is None else done.unionByName(front)


# --- metrics ---


def count_by(assets: DataFrame, column: str) -> DataFrame:
    return assets.groupBy(column).agg(F.count("*").alias("n"))


def degree(edges: DataFrame) -> DataFrame:
    """Ends of edges at each id: parallel edges count each, a self-loop twice."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def top_connected(assets: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    return assets.join(degree(edges), "id").orderBy(F.desc("degree"), "seq").limit(n).select("id", "degree")


def leaves(assets: DataFrame, edges: DataFrame) -> DataFrame:
    return assets.join(edges.select(F.col("source").alias("id")), "id", "left_anti")


def orphans(assets: DataFrame, edges: DataFrame) -> DataFrame:
    return assets.join(edges.select(F.explode(F.array("source", "target")).alias("id")), "id", "left_anti")


def distinct_edges(edges: DataFrame) -> tuple[DataFrame, int]:
    return cut_counted(edges.select("source", "target").distinct())


def peel(rest: DataFrame, left: int) -> tuple[DataFrame, DataFrame, int]:
    """Take off ids without edges out of them, again and again. ``rest``: distinct edges, ``left`` of them.

    Returns ``id`` and ``depth`` of what came off after the first round (``depth``: the round, which is the number of hops
    of the longest path from there; ids without edges out of them have 0 and no row, as they are most of many a graph),
    and the edges that are left with their number: those of ids from which a cycle can be reached.
    """
    on, n_on = cut_counted(rest.select(F.col("source").alias("id")).distinct())
    found, depth = on.where("false").select("id", F.lit(0).alias("depth")), 0
    while left:
        depth += 1
        kept, n = cut_counted(rest.join(beside(on.select(F.col("id").alias("target")), n_on), "target", "left_semi").select("source", "target"))
        if n == left:
            break
        still, n_still = cut_counted(kept.select(F.col("source").alias("id")).distinct())
        found = found.unionByName(on.join(beside(still, n_still), "id", "left_anti").withColumn("depth", F.lit(depth)))
        on, n_on, rest, left = still, n_still, kept, n
    return found, rest, left


def spread(links: DataFrame, ids: DataFrame) -> DataFrame:
    """``id``, ``least``: the smallest id from which ``links`` (``source``, ``target``) lead to an id, itself included.

    Labels go along links, and each takes over its own label's label, so that rounds grow with the logarithm of the
    longest path.
    """
    labels = cut(ids.select("id", F.col("id").alias("least")))
    while True:
        near = links.join(labels, F.col("source") == F.col("id")).groupBy("target").agg(F.min("least").alias("_near"))
        low = labels.join(near, F.col("target") == F.col("id"), "left").select("id", "least", F.least("least", "_near").alias("_low"))
        jump = low.select(F.col("id").alias("_id"), F.col("_low").alias("_over"))
        low = low.join(jump, F.col("_low") == F.col("_id")).select("id", F.least("_low", "_over").alias("_new"), "least")
        low, moved = cut_counted(low, F.col("_new") != F.col("least"))
        labels = low.select("id", F.col("_new").alias("least"))
        if not moved:
            return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """``id``, ``component`` of every id on a cycle: the smallest id of those that it reaches and that reach it.

    Forward-backward colouring, for all components at once: what can't be on a cycle is peeled off from both sides; each
    id takes the colour of the smallest id that reaches it, then, within its colour, the smallest id that it reaches.
    Where both agree, the ids are the component of their colour. Those come off, and the rest is coloured again. Ids are
    compared by a hash before their names: along a chain of components, the number of rounds then grows with the
    logarithm of its length, whatever the names are.
    """
    key = lambda c: F.concat_ws("|", F.hex(F.xxhash64(c)), F.col(c))
    loops = edges.where("source = target").select(F.col("source").alias("id")).distinct()
    links, left = distinct_edges(edges.where("source <> target"))
    found = None
    while True:
        _, links, left = peel(links, left)
        _, turned, left = peel(turn(links), left)
        if not left:
            break
        links = turn(turned)
        if found is None:
            links = cut(links.select(key("source").alias("source"), key("target").alias("target")))
        ids = cut(links.select(F.explode(F.array("source", "target")).alias("id")).distinct())
        colour = spread(links, ids)
        ends = links
        for end in ("source", "target"):
            ends = ends.join(colour.select(F.col("id").alias(end), F.col("least").alias(f"_{end}")), end)
        back = spread(cut(turn(ends.where("_source = _target").select("source", "target"))), ids)
        whole = cut(colour.join(back.withColumnRenamed("least", "_back"), "id").where("least = _back").select("id", "least"))
        found = whole if found is None else found.unionByName(whole)
        for end in ("source", "target"):
            links = links.join(whole.select(F.col("id").alias(end)), end, "left_anti")
        links, left = cut_counted(links.select("source", "target"))
    name = lambda c: F.expr(f"substr({c}, instr({c}, '|') + 1)")
    if found is None:
        return cut(loops.select("id", F.col("id").alias("component")))
    named = found.select(name("id").alias("id"), "least")
    firsts = named.groupBy("least").agg(F.min("id").alias("component"), F.count("*").alias("_n"))
    many = named.join(firsts.where("_n > 1"), "least").select("id", "component")
    alone = loops.join(many.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
    return cut(many.unionByName(alone))


def condensed(edges: DataFrame, strong: DataFrame) -> DataFrame:
    """``edges`` with each end on a cycle replaced by its component; edges within a component are left out."""
    n = strong.count()
    for end in ("source", "target"):
        names = strong.select(F.col("id").alias(end), F.col("component").alias("_c"))
        edges = edges.join(beside(names, n), end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    return edges.where("source <> target")


def cycle_edges(edges: DataFrame) -> DataFrame:
    """``source``, ``target``: the distinct edges that lie on a cycle, which are those within a strong component."""
    links = edges.select("source", "target").distinct()
    strong = strong_components(edges)
    for end in ("source", "target"):
        links = links.join(strong.select(F.col("id").alias(end), F.col("component").alias(f"_{end}")), end)
    return links.where("_source = _target").select("source", "target")


def depths(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``id``, ``depth`` of ends of edges, but those of depth 0; the edges that depths go by, distinct; and strong components, if any.

    ``depth``: hops of the longest path downstream in the graph in which each strong component is one node, so ids of a
    cycle share a depth, and it is 0 for leaves and for cycles that lead nowhere.
    """
    links, number = distinct_edges(edges)
    found, rest, left = peel(links, number)
    if not left:
        return found, links, None
    strong = strong_components(rest)
    links, number = distinct_edges(condensed(links, strong))
    found, _, _ = peel(links, number)
    found = found.join(strong.withColumnRenamed("id", "_id"), F.col("component") == F.col("id"), "left").select(F.coalesce("_id", "id").alias("id"), "depth")
    return cut(found), links, strong


def dependency_depth(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``, ``seq``, ``dependency_depth`` of each asset, as :func:`depths` has it; 0 for assets without edges."""
    return assets.select("id", "seq").join(depths(edges)[0], "id", "left").select("id", "seq", F.coalesce("depth", F.lit(0)).alias("dependency_depth"))


def critical_path(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """``step``, ``id``: from the first asset of the greatest depth, always to the first neighbour that is one less deep.

    From an asset on a cycle the path may go on from any id of its cycle. Each id's next one is found at once by an
    aggregate; the path is then put together in rounds that double its length.
    """
    found, links, strong = depths(edges)
    deep = assets.select("id", "seq").join(found, "id").withColumn("node", F.col("id"))
    if strong is not None:
        deep = deep.join(strong, "id", "left").withColumn("node", F.coalesce("component", "id"))
    # Per node: the asset that stands for it (its first one) and the node that follows it, down to depth 1.
    first, n = cut_counted(deep.groupBy("node", "depth").agg(F.min(F.struct("seq", "id")).alias("_first")))
    if not n:
        return assets.orderBy("seq", "id").limit(1).select(F.lit(0).alias("step"), "id")
    onto = links.join(beside(first.select(F.col("node").alias("target"), F.col("depth").alias("_depth"), "_first"), n), "target")
    onto = onto.join(beside(first.select(F.col("node").alias("source"), "depth"), n), "source").where("_depth = depth - 1")
    jump = cut(onto.groupBy("source").agg(F.min(F.struct(F.col("_first.seq").alias("seq"), F.col("target"))).alias("_n")).select("source", F.col("_n.target").alias("target")))
    path = cut(first.orderBy(F.desc("depth"), "_first").limit(1).select(F.lit(0).alias("step"), "node"))
    length = 1
    while True:
        path, n = cut_counted(path.unionByName(path.join(jump, F.col("node") == F.col("source")).select((F.col("step") + length).alias("step"), F.col("target").alias("node"))))
        if n < 2 * length:
            break
        length *= 2
        jump = cut(jump.join(jump.select(F.col("source").alias("_s"), F.col("target").alias("_t")), F.col("target") == F.col("_s")).select("source", F.col("_t").alias("target")))
    path = cut(path.join(first, "node").select("step", "node", "depth", F.col("_first.id").alias("id")))
    # The last hop, to depth 0: what the path's end leads to, with the ids of cycles that lead nowhere.
    last = links.join(F.broadcast(path.where("depth = 1").select("step", F.col("node").alias("source"))), "source").select("step", "target")  # one row
    last = last.withColumn("id", F.col("target"))
    if strong is not None:
        last = last.join(strong.withColumnsRenamed({"id": "_id", "component": "target"}), "target", "left").select("step", "target", F.coalesce("_id", "id").alias("id"))
    last, n = cut_counted(last)
    last = assets.select("id", "seq").join(beside(last, n), "id").groupBy("step").agg(F.min(F.struct("seq", "target", "id")).alias("_first"))
    return path.select("step", "id").unionByName(last.select((F.col("step") + 1).alias("step"), F.col("_first.id").alias("id")))


def blast_radius(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``, ``blast_radius``: number of ids that each asset reaches but itself, whether they are assets or not.

    What a node reaches is kept as words of 64 bits, a bit per id; ids that share a source have neighbouring numbers, so a
    word stands for up to 64 of them, and no row per pair of ids is made. Nodes (strong components count as one) get
    their words level by level, from the deepest up: the ``bit_or`` of the words of what they lead to, combined before the
    shuffle. Leaves, mostly the largest part of a graph, reach nothing; they enter the words of what leads to them once.
    """
    found, links, strong = depths(edges)
    inner = found.withColumn("node", F.col("id"))
    if strong is not None:
        inner = found.join(strong, "id", "full").select("id", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("component", "id").alias("node"))
    inner = cut(inner)
    nodes, n = cut_counted(inner.select("node", "depth").distinct())
    ids = links.groupBy(F.col("target").alias("id")).agg(F.min("source").alias("_near"), F.count("*").alias("_in")).join(inner.hint("merge"), "id", "full")
    # Numbers are unique, and dense within a task's range; a range starts at a multiple of 64.
    parts = ids.sparkSession.sparkContext.defaultParallelism
    sorted_ = ids.repartitionByRange(parts, "_near", "id").sortWithinPartitions("_near", "id").withColumn("_no", F.monotonically_increasing_id())
    word, bit = F.shiftright("_no", 6).alias("word"), F.expr("shiftleft(1L, CAST(_no % 64 AS INT))").alias("bits")
    numbered, many = cut_counted(sorted_.select("id", "node", "_near", "_in", word, bit), F.col("node").isNull() & (F.col("_in") > 1))
    leaf = numbered.where("node IS NULL")
    led = links.join(beside(leaf.where("_in > 1").select(F.col("id").alias("target"), "word", "bits"), many), "target").select(F.col("source").alias("node"), "word", "bits")
    own = numbered.where("node IS NOT NULL").select("node", "word", "bits").unionByName(leaf.where("_in = 1").select(F.col("_near").alias("node"), "word", "bits")).unionByName(led)
    own = cut(own.groupBy("node", "word").agg(F.bit_or("bits").alias("bits")).join(beside(nodes, n), "node"))  # of a node and the leaves that it leads to
    onto = cut(links.join(beside(nodes.select(F.col("node").alias("target")), n), "target", "left_semi").select("source", "target").join(beside(nodes.select(F.col("node").alias("source"), "depth"), n), "source"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    done = own.where("depth = 0").select("node", "word", "bits")  # of a node itself and all that it reaches
    for level in range(1, deepest + 1):
        gained = onto.where(F.col("depth") == level).join(done.withColumnRenamed("node", "target"), "target").select(F.col("source").alias("node"), "word", "bits")
        mine = own.where(F.col("depth") == level).select("node", "word", "bits")
        done = done.unionByName(cut(gained.unionByName(mine).groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))))
    sizes = done.groupBy("node").agg((F.sum(F.bit_count("bits")) - 1).alias("n"))
    counts = inner.select("id", "node").join(sizes, "node").select("id", "n")
    return assets.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("blast_radius"))


# --- validation ---


def broken_references(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """``end``, ``id``, ``source``, ``target``: ends that are no assets, but of edges marked unresolved."""
    ids = assets.select("id")
    marked = F.coalesce(F.col("unresolved"), F.lit(False)) if "unresolved" in edges.columns else F.lit(False)
    open_ = edges.where(~marked)
    at = lambda end: open_.withColumn("id", F.col(end)).join(ids, "id", "left_anti").select(F.lit(end).alias("end"), "id", "source", "target")
    return at("source").unionByName(at("target"))


def duplicate_ids(assets: DataFrame) -> DataFrame:
    return assets.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def components(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``, ``component``: the smallest id that an id is connected with, in either direction.

    An id with one neighbour belongs to its neighbour's component, so labels spread among the others only; what was left
    out can still be the smallest id. Of two ids that have only each other, the smaller one stays.
    """
    ids = assets.select("id").unionByName(edges.select(F.explode(F.array("source", "target")).alias("id"))).distinct()
    links = edges.where("source <> target").select("source", "target")
    links = cut(links.unionByName(turn(links).select("source", "target")).distinct())
    degrees = links.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("_n"), F.min("target").alias("_near"))
    ends = degrees.where("_n = 1").select("id", "_near")
    pairs = ends.select(F.col("id").alias("_id"), F.col("_near").alias("_back")).hint("merge")  # of neighbours, those that are ends as well
    ends = cut(ends.join(pairs, F.col("_near") == F.col("_id"), "left").where("_id IS NULL OR _id < id").select("id", "_near"))
    core = links
    for end in ("source", "target"):
        core = core.join(ends.select(F.col("id").alias(end)).hint("merge"), end, "left_anti")
    inner = spread(cut(core), ids.join(ends.select("id").hint("merge"), "id", "left_anti"))
    outer = ends.join(inner.select(F.col("id").alias("_near"), "least").hint("merge"), "_near").select("id", "least")
    lower = outer.groupBy("least").agg(F.min("id").alias("_low")).where("_low < least").hint("merge")
    return inner.unionByName(outer).join(lower, "least", "left").select("id", F.coalesce("_low", "least").alias("component"))


def disconnected(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """``component``, ``size`` and ``sample`` (its first three ids): all components but the largest.

    Of components of one size, that with the smallest id counts as the largest. The window of the sample runs within a
    component, and Spark keeps three rows of each before it shuffles.
    """
    labels = components(assets, edges)
    sized = labels.groupBy("component").agg(F.count("*").alias("size"))
    largest = sized.orderBy(F.desc("size"), "component").limit(1).select("component")
    rest = sized.join(F.broadcast(largest), "component", "left_anti")  # one row
    nth = F.row_number().over(Window.partitionBy("component").orderBy("id"))
    first = labels.withColumn("_nth", nth).where("_nth <= 3").groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("sample"))
    return rest.join(first, "component")


def findings(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """``check``, ``message``: all warnings about a graph; a row each."""
    quoted = lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))
    said = lambda rows, check, *parts: rows.select(F.lit(check).alias("check"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("message"))
    broken = broken_references(assets, edges)
    there = F.when(F.col("end") == "source", F.concat(F.lit("→ "), quoted("target"))).otherwise(F.concat(quoted("source"), F.lit(" →")))
    apart = disconnected(assets, edges)
    return (
        said(cycle_edges(edges), "cycles", "Cycle detected: ", quoted("source"), " → ", quoted("target"))
        .unionByName(said(broken, "broken_references", "Broken reference: ", F.col("end"), " ", quoted("id"), " does not exist (in relationship ", there, ")"))
        .unionByName(said(duplicate_ids(assets), "duplicate_ids", "Duplicate asset id: ", quoted("id")))
        .unionByName(said(orphans(assets, edges), "dangling_assets", "Dangling asset: ", quoted("id"), " (", F.col("asset_type"), ", ", F.col("system"), ") has no edges"))
        .unionByName(said(apart, "disconnected_subgraphs", "Disconnected subgraph: ", F.col("size").cast("string"), " assets, such as ", F.array_join("sample", ", ")))
    )


CHECKS = {"cycles": "cycles", "broken_references": "broken_refs", "duplicate_ids": "duplicates", "dangling_assets": "dangling", "disconnected_subgraphs": "disconnected_subgraphs"}


def findings_summary(found: DataFrame) -> DataFrame:
    """One row: ``has_warnings`` and ``summary``, the number of warnings of each check. ``found``: of :func:`findings`."""
    parts = [F.concat(F.lit(f"{label}="), F.count_if(F.col("check") == check).cast("string")) for check, label in CHECKS.items()]
    return found.agg((F.count("*") > 0).alias("has_warnings"), F.concat_ws(", ", *parts).alias("summary"))


def metrics(assets: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Every metric of a graph by name; totals as one row."""
    return {
        "totals": assets.agg(F.count("*").alias("total_assets")).withColumn("total_relationships", edges.agg(F.count("*")).scalar()),
        "assets_by_system": count_by(assets, "system"),
        "assets_by_type": count_by(assets, "asset_type"),
        "dependency_depth": dependency_depth(assets, edges),
        "critical_path": critical_path(assets, edges),
        "blast_radius": blast_radius(assets, edges),
        "top_connected_assets": top_connected(assets, edges),
        "leaf_assets": leaves(assets, edges),
        "orphan_assets": orphans(assets, edges),
    }


# --- impact ---


def by_bucket(found: DataFrame, assets: DataFrame, buckets: dict[str, tuple[str, ...]], default: str | None = None) -> DataFrame:
    """``root``, ``bucket``, ``n``: assets reached, by bucket; every bucket has a row for every root."""
    counted = known_only(found, assets).withColumn("bucket", schemas.bucket(F.col("asset_type"), buckets, default)).where("bucket IS NOT NULL").groupBy("root", "bucket").agg(F.count("*").alias("n"))
    every = found.select("root").distinct().select("root", F.explode(F.array(*map(F.lit, buckets))).alias("bucket"))
    return every.join(counted, ["root", "bucket"], "left").select("root", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def impact_metrics(found: DataFrame, assets: DataFrame, edges: DataFrame) -> DataFrame:
    """Per root: assets, critical ones, greatest depth, systems, buckets, leaves, by direction. ``found``: of :func:`bidirectional`."""
    fine = schemas.bucket(F.col("asset_type"), schemas.ESTATE_BUCKETS, "external_consumers")
    goes_on = edges.select(F.col("source").alias("id")).distinct().withColumn("_on", F.lit(True))
    rows = known_only(found, assets).join(goes_on, "id", "left")
    return rows.groupBy("root").agg(
        F.count("*").alias("total_assets"), F.count_if(F.col("asset_type").isin(*schemas.CRITICAL_TYPES)).alias("critical_assets"), F.max("depth").alias("max_depth"), F.countDistinct("system").alias("systems_impacted"),
        F.countDistinct(fine).alias("buckets_impacted"), F.count_if(F.col("_on").isNull()).alias("leaf_assets"), F.count_if(F.col("direction") == "upstream").alias("upstream_assets"),
        F.count_if(F.col("direction") == "downstream").alias("downstream_assets"),
    )


def mean_confidence(found: DataFrame) -> DataFrame:
    """``confidence``: mean of the column of that name in whole percent, halves up; null counts as 1, and no rows give 100."""
    mean = F.avg(F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)))
    return found.agg(F.coalesce(F.floor(mean * 100 + 0.5), F.lit(100)).cast("long").alias("confidence"))


def artifact_counts(assets: DataFrame, reports: DataFrame) -> DataFrame:
    """``artifact``, ``n``: assets by type, reports, their pages (one each) and their visuals. ``reports``: ``visuals``, an array."""
    by_type = assets.groupBy(F.col("asset_type").alias("artifact")).agg(F.count("*").alias("n"))
    totals = reports.agg(F.count("*").alias("reports"), F.count("*").alias("pages"), F.coalesce(F.sum(F.greatest(F.size("visuals"), F.lit(0)).cast("long")), F.lit(0)).alias("visuals"))
    stacked = totals.selectExpr("stack(3, 'reports', reports, 'pages', pages, 'visuals', visuals) AS (artifact, n)")
    return by_type.unionByName(stacked)


def path_edges(paths: DataFrame) -> DataFrame:
    """``source``, ``target``: neighbours on any path. ``paths``: ``path``."""
    steps = paths.select(F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("s"), F.slice("path", 2, F.size("path")).alias("t"))).alias("e"))
    return steps.where("e.t IS NOT NULL").select(F.col("e.s").alias("source"), F.col("e.t").alias("target")).distinct()


# Fixed value: ids of tables that the modelling tool makes for itself, which are left out of what is shown.
INTERNAL_ID = r"(^|::)(LocalDateTable_|DateTableTemplate_)"


def path_graph(paths: DataFrame, impacted: DataFrame, source_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id``, ``depth``, ``name``, ``asset_type``, ``system``, ``bucket``) and edges (``source``, ``target``) of what is shown of an impact.

    ``paths``: ``path``; ``impacted``: the other columns of nodes but ``depth``. Internal tables are taken out of paths, so
    that their neighbours join. A node's depth is its least place in a path; impacted assets in no path have depth 1 and no
    edge; the source has depth 0. Ids that are no impacted asset are named by their last part.
    """
    clean = paths.select(F.filter("path", lambda x: ~x.rlike(INTERNAL_ID)).alias("path"))
    on_path = clean.select(F.posexplode("path").alias("depth", "id")).groupBy("id").agg(F.min("depth").alias("depth"))
    shown = impacted.where(~F.col("id").rlike(INTERNAL_ID))
    others = shown.select("id").join(on_path.select("id"), "id", "left_anti").distinct().withColumn("depth", F.lit(1))
    nodes = on_path.unionByName(others)
    if source_id is not None:
        source = nodes.sparkSession.createDataFrame([(source_id, 0)], "id string, depth int")
        nodes = nodes.where(F.col("id") != source_id).unionByName(source)
    named = nodes.join(shown.select("id", "name", "asset_type", "system", "bucket").dropDuplicates(["id"]), "id", "left")
    last = F.element_at(F.split("id", "::"), -1)
    shown = named.select(
        "id", "depth", F.coalesce("name", F.coalesce(F.nullif(last, F.lit("")), "id")).alias("name"), F.coalesce("asset_type", F.lit("unknown")).alias("asset_type"), F.coalesce("system", F.lit("unknown")).alias("system"),
        F.coalesce("bucket", F.lit("")).alias("bucket"),
    )
    return cut(shown), path_edges(clean)  # nodes are counted and joined


def downstream_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``, ``downstream``: how many nodes each node of a path graph leads to."""
    return blast_radius(nodes, edges).withColumnRenamed("blast_radius", "downstream")


# Stage that each estate bucket is shown in. What is shown before the first is the source of the change.
STAGES = {
    "database": ("database_tables", "views", "materialized_views", "stored_procedures", "functions"),
    "etl": ("databricks_notebooks", "spark_jobs", "delta_live_tables", "unity_catalog", "pipelines", "data_factory", "airflow", "fabric_pipelines", "adls_files", "apis", "external_consumers"),
    "semantic": ("semantic_models",),
    "reports": ("powerbi_reports",),
    "dash": ("dashboards",),
}


def stages(assets: DataFrame, source_id: str | None = None) -> DataFrame:
    """``stage``, ``asset_type``, ``n``. Database buckets of the BI system are semantic; what isn't typed is unclassified."""
    fine = schemas.bucket(F.col("asset_type"), schemas.ESTATE_BUCKETS, "external_consumers")
    shown = schemas.bucket(fine, STAGES, "unclassified")
    stage = F.when(F.col("id") == F.lit(source_id), "source").when(F.col("asset_type").isNull(), "unclassified").when((F.col("system") == "powerbi") & (shown == "database"), "semantic").otherwise(shown)
    return assets.groupBy(stage.alias("stage"), "asset_type").agg(F.count("*").alias("n"))
