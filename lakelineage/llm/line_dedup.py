"""Repeated lines, exact or within a few edits, by a segment-partition edit join; DataFrame functions only.

Distinct lines are cut into EDITS + 1 segments. Two lines within EDITS edits share at least one segment unchanged, near
its place. Every line puts its own segments, by its length, into an index, and probes the index, for each length that
it can be compared with, with the substrings that could be such a segment: those whose shift fits both the edits that
can lie before the segment and those that can lie after it.

A segment that over HOT lines have says too little, so the lines that meet at one are told apart by what remains of them.
They are cut into PARTS parts. Two of them within two edits either differ in one part alone, or in two parts by one edit
each. In the first case they meet by all that lies outside the part, and the part itself is cut again; in the second they
meet by all that lies outside the two parts, and each of these is narrowed down to the place of its edit. A group of few
lines gives its pairs. In a larger one the parts end up as short as SHORT, where lines meet by what is left when the
edited places are taken out: whoever meets there is within two edits, so a group gives one link for each of its lines,
whatever its size.

Pairs that meet are verified: first by how many of CHECKED segments the longer line has near their places, then by
a banded bit-parallel edit distance: one integer of 2 * EDITS + 1 bits holds the differences along a column of the band.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelineage.llm.common import components, stored

EDITS = 2
LEAST = 20  # code points of a line that counts; shorter ones stay
HOT = 4  # lines that share a segment, at most, for it to be an index key; a line meets so many at a key, whatever its group
PARTS = 4  # of a line that meets others at a hot segment
BLOCKS = 8  # of a part in which one edit is looked for
SMALL = 8  # lines of a group that gives its pairs, at most
SHORT = 8  # code points of a part that isn't cut again
CHECKED = 12  # segments by which a pair is told off before its distance is computed
STEPS = tuple(1 << k for k in range(12, -1, -1))  # code points by which common ends of two lines are looked for
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 25  # of the map of lines that met, which is sent to every task
BLANKS = " \t\r"


def lines_of(docs: DataFrame, least: int) -> DataFrame:
    """``doc_id``, ``doc_key`` (of id and text), ``pos`` from 0, ``line`` (trimmed) and ``id`` (its hash) of lines that count."""
    split = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc_key"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    split = split.withColumn("line", F.btrim("line", F.lit(BLANKS))).where(F.length("line") >= least)
    return split.withColumn("id", F.xxhash64("line"))


def segment(length: Column, i: int | Column, segments: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment ``i`` of a line: even sizes, the longer ones last."""
    i = F.lit(i) if isinstance(i, int) else i
    base = F.floor(length / segments).cast("int")
    short = F.lit(segments) - length % segments  # segments of the smaller size
    return base * i + F.greatest(F.lit(0), i - short), base + (i >= short).cast("int")


def entries(edits: int) -> tuple[list[Column], list[int]]:
    """Probe keys of ``line``, and which of them are its index keys as well: its own segments, by its own length."""
    n = F.length("line")
    probes, own = [], []
    for less in range(edits + 1):  # the indexed line is shorter by so much, or as long
        size = n - less
        for i in range(edits + 1):
            start, width = segment(size, i, edits + 1)
            before, after = i, edits - i  # edits that can lie before the segment, and after it
            for shift in range(max(-before, less - after), min(before, less + after) + 1):
                own += [len(probes)] * (less == 0 and shift == 0)
                probes.append(F.xxhash64(size, F.lit(i), F.substring("line", start + shift + 1, width)))
    return probes, own


def rest(s: Column, start: Column) -> Column:
    """What follows the first ``start`` code points."""
    return F.substring(s, start + 1, F.length(s))


def without(s: Column, place: Column) -> Column:
    return F.concat(F.substring(s, F.lit(1), place), rest(s, place + 1))


def one_edit(nodes: DataFrame) -> DataFrame:
    """``key``, ``node``, ``more``, ``long`` and ``leaf``: nodes of one key that share a leaf (as texts of both lengths
    where ``more`` is 1) are one edit apart, and all such nodes share one.

    ``nodes``: distinct ``key``, ``node`` (hash of ``s``), ``told`` (nodes that have the same aren't looked for), ``s``,
    ``more`` (by how much the longer texts of this key are longer, 0 or 1) and ``long`` (whether this is one of them). The text is cut into BLOCKS blocks, nodes meet by all
    but one of them, and that one is cut again. A leaf is the text without the edited place, known by that place where
    texts are equally long; groups without two sides, or with one node, go at every step.
    """
    live, leaves = nodes.withColumn("k", F.xxhash64("key", "more")), []
    own = F.when(F.col("long"), F.col("more")).otherwise(0)
    n = F.length("s") - own
    while True:
        sides = live.groupBy("k").agg(F.min("told").alias("t0"), F.max("told").alias("t1"), F.min("long").alias("l0"), F.max("long").alias("l1"), F.max("more").alias("m"))
        live = stored(live.join(sides.where("t0 <> t1 AND (m = 0 OR l0 <> l1)").select("k"), "k", "left_semi"))
        taken = lambda last, mark: F.transform(F.sequence(F.lit(0), last), lambda p: F.xxhash64("k", mark(p), without(F.col("s"), p)))
        edited = F.when(F.col("more") == 0, taken(F.greatest(n - 1, F.lit(0)), lambda p: p)).when(F.col("long"), taken(n, lambda p: F.lit(-1))).otherwise(F.array(F.xxhash64("k", F.lit(-1), "s")))
        leaves.append(live.where(n <= SHORT).select("key", "node", "more", "long", F.explode(F.array_distinct(edited)).alias("leaf")))
        long_ = live.where(n > SHORT)
        if long_.isEmpty():
            return reduce(DataFrame.unionByName, leaves)
        start, width = segment(n, F.col("i"), BLOCKS)
        block = F.xxhash64("k", "i", F.substring("s", F.lit(1), start), rest(F.col("s"), start + width + own)).alias("k")
        live = long_.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).select("key", "node", "told", "more", "long", block, F.substring("s", start + 1, width + own).alias("s"))


def in_one_part(rows: DataFrame) -> DataFrame:
    """Rows by all but one part, which becomes ``s``."""
    own = F.when(F.col("side") > 0, F.col("less")).otherwise(0)
    start, width = segment(F.length("s") - own, F.col("i"), PARTS)
    key = F.xxhash64("key", "less", "i", F.substring("s", F.lit(1), start), rest(F.col("s"), start + width + own))
    each = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return each.select(key.alias("key"), "id", F.substring("s", start + 1, width + own).alias("s"), "less", "side")


def in_two_parts(rows: DataFrame) -> DataFrame:
    """Rows by all but two parts, ``x`` and ``y``, in each of which the one of ``role`` 1 is longer by ``dx`` and ``dy``.

    Equally long lines take both roles where an insertion comes before a deletion; of each pair one has it that way.
    ``tx`` and ``ty`` are hashes of the parts, where these adjoin of what is left without the character at their common
    border by which one is longer: lines with one of them equal differ in the other part alone.
    """
    longer = [[(0, 0, 0), (1, -1, -1), (1, -1, 1)], [(1, 0, None), (0, 1, None)], [(1, 1, None)]]  # dx, dy and role (None: the side), by less
    pairs = list(combinations(range(PARTS), 2))
    way = [F.array(*[F.struct(*[F.lit(v).cast("int").alias(c) for c, v in zip(("i", "j", "dx", "dy", "role"), (i, j, *w), strict=True)]) for i, j in pairs for w in ways]) for ways in longer]
    each = rows.withColumn("way", F.explode(F.when(F.col("less") == 0, way[0]).when(F.col("less") == 1, way[1]).otherwise(way[2]))).select("key", "id", "s", "less", "side", "way.*")
    each = each.withColumn("role", F.coalesce("role", "side"))
    n = F.length("s") - F.when(F.col("side") > 0, F.col("less")).otherwise(0)
    (a, wa), (b, wb) = (segment(n, F.col(c), PARTS) for c in "ij")
    mx, my = (F.when(F.col("role") > 0, F.col(d)).otherwise(0) for d in ("dx", "dy"))
    each = each.select("*", a.alias("a"), wa.alias("wa"), b.alias("b"), wb.alias("wb"), mx.alias("mx"), my.alias("my"))
    x, y = F.substring("s", F.expr("a + 1"), F.expr("wa + mx")), F.substring("s", F.expr("b + mx + 1"), F.expr("wb + my"))
    adjoin = F.col("j") == F.col("i") + 1
    tx, ty = F.when(adjoin, F.substring("s", F.expr("a + 1"), F.col("wa"))).otherwise(x), F.when(adjoin & (F.col("my") == 1), rest(y, F.lit(1))).otherwise(y)
    outside = F.substring("s", F.lit(1), F.col("a")), F.substring("s", F.expr("a + wa + mx + 1"), F.expr("b - a - wa")), rest(F.col("s"), F.expr("b + wb + mx + my"))
    return each.select(
        "id", F.xxhash64("key", "i", "j", "dx", "dy", *outside).alias("key"), x.alias("x"), y.alias("y"), F.xxhash64(tx).alias("tx"), F.xxhash64(ty).alias("ty"), "dx", "dy", "role",
    )


def apart_twice(rows: DataFrame) -> DataFrame:
    """``key``, ``id`` and ``role`` of lines with one edit in each of two parts; those of a key are two edits apart."""

    def both(rows: DataFrame) -> DataFrame:
        sides = rows.groupBy("key").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("id", "tx", "ty", "role")])
        sides = sides.where("min_id <> max_id AND min_tx <> max_tx AND min_ty <> max_ty AND (min_role = 0 AND max_role = 0 OR min_role < max_role)")
        return stored(rows.join(sides.select("key"), "key", "left_semi"))

    def narrowed(rows: DataFrame, text: str, d: str) -> DataFrame:
        longer = (F.col(d) != 0) & ((F.col(d) > 0) == (F.col("role") > 0))
        nodes = rows.select("key", F.col(f"h{text}").alias("node"), F.col(f"t{text}").alias("told"), F.col(text).alias("s"), F.abs(d).alias("more"), longer.alias("long")).distinct()
        leaf = stored(one_edit(nodes)).drop("more").withColumnsRenamed({"key": "_key", "node": "_node", "long": "_long"})
        return rows.join(leaf, (F.col("key") == F.col("_key")) & (F.col(f"h{text}") == F.col("_node")) & (longer == F.col("_long"))).drop("_key", "_node", "_long", "key").withColumnRenamed("leaf", "key")

    rows = both(rows.withColumns({"hx": F.xxhash64("x"), "hy": F.xxhash64("y")}))
    rows = both(narrowed(rows, "x", "dx"))
    return narrowed(rows, "y", "dy").select("key", "id", "role")


def left_over(rows: DataFrame) -> DataFrame:
    """``key``, ``id`` and ``role`` by what is left of short texts without two edited places."""
    own = F.when(F.col("side") > 0, F.col("less")).otherwise(0)
    n, s = F.length("s") - own, F.col("s")
    upto = lambda last: F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    one = lambda text, last: F.transform(upto(last), lambda q: F.xxhash64("key", q, without(text, q)))
    two = F.flatten(F.transform(upto(F.length("s") - 2), lambda p: F.transform(F.sequence(p, F.length("s") - 2), lambda q: F.xxhash64("key", F.when(F.col("less") == 0, p * 64 + q).otherwise(-1), without(without(s, p), q)))))
    moved = F.transform(upto(n - 1), lambda p: F.xxhash64("key", F.lit("moved"), without(s, p)))
    changed = F.flatten(F.transform(upto(n), lambda p: one(without(s, p), n - 1)))
    whole = F.array(F.xxhash64("key", F.lit(-1), "s"))
    keys = F.when(F.col("less") == 0, F.concat(two, moved)).when(F.col("less") == 1, F.when(F.col("side") > 0, changed).otherwise(one(s, n - 1))).otherwise(F.when(F.col("side") > 0, two).otherwise(whole))
    return rows.select("id", F.col("side").alias("role"), F.explode(F.array_distinct(keys)).alias("key"))


def linked(rows: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that join each group (``key``, ``id``, ``role``): lines of role 0 to its least, others to the least of the other role."""
    least = rows.groupBy("key").agg(F.min(F.when(F.col("role") <= 0, F.col("id"))).alias("low"), F.min(F.when(F.col("role") > 0, F.col("id"))).alias("high"))
    least = stored(least.where("low IS NOT NULL").withColumnRenamed("key", "_key"))  # so that a hot key can be split
    to = F.when(F.col("role") < 0, F.col("high")).otherwise(F.col("low"))
    return rows.join(least, F.col("key") == F.col("_key")).select(F.least("id", to).alias("a"), F.greatest("id", to).alias("b")).where("a < b")


def near_at_hot(hot: DataFrame, edits: int) -> DataFrame:
    """Links ``a``, ``b`` that join what is within ``edits`` edits among lines (``id``, ``line``) of hot segments; others may miss."""
    ways = [(0, 0)] + [(less, side) for less in range(1, edits + 1) for side in (-1, 1)]
    ways = F.explode(F.array(*[F.struct(F.lit(less).alias("less"), F.lit(side).alias("side")) for less, side in ways]))
    rows = hot.select("id", F.col("line").alias("s"), ways.alias("way")).select("id", "s", "way.less", "way.side")
    # Lines that are compared have one length, but for what the longer has more; all parts below are cut by it.
    rows = rows.withColumn("key", F.xxhash64("less", F.length("s") - F.when(F.col("side") > 0, F.col("less")).otherwise(0)))
    if edits == 1:
        nodes = rows.select("key", F.col("id").alias("node"), F.col("id").alias("told"), "s", F.col("less").alias("more"), (F.col("side") > 0).alias("long"))
        role = F.when(F.col("more") == 0, 0).when(F.col("long"), 1).otherwise(-1)
        return linked(one_edit(nodes).select(F.col("leaf").alias("key"), F.col("node").alias("id"), role.alias("role")))
    found, twice = [], []
    while True:
        groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("side").alias("s0"), F.max("side").alias("s1"))
        rows = stored(rows.join(groups.where("n > 1 AND (s0 = 0 AND s1 = 0 OR s0 < s1)").select("key", "n"), "key"))
        few = rows.where(F.col("n") <= SMALL)
        a, b = (few.select("key", F.col("id").alias(x), F.col("s").alias(f"s{x}"), F.col("side").alias(f"side{x}")) for x in "ab")
        pairs = a.join(b, "key").where("sidea < sideb OR sidea = 0 AND sideb = 0 AND a < b")
        found.append(verified(pairs.select("a", "b", "sa", "sb"), "sa", "sb", edits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        many = rows.where(F.col("n") > SMALL).drop("n")
        short = F.length("s") <= SHORT + F.when(F.col("side") > 0, F.col("less")).otherwise(0)
        found.append(linked(left_over(many.where(short))))
        many = many.where(~short)
        if many.isEmpty():
            break
        twice.append(in_two_parts(many))
        rows = in_one_part(many)
    if twice:
        found.append(linked(apart_twice(reduce(DataFrame.unionByName, twice))))
    return reduce(DataFrame.unionByName, found).where("a <> b").distinct()


def by_length(a: str, b: str) -> dict[str, Column]:
    """``_longer`` and ``_shorter`` of two texts, computed once for what follows."""
    first = F.length(a) >= F.length(b)
    return {"_longer": F.when(first, F.col(a)).otherwise(F.col(b)), "_shorter": F.when(first, F.col(b)).otherwise(F.col(a))}


def cores() -> list[dict[str, Column]]:
    """``_longer`` and ``_shorter`` without what both begin and end with, step by step of columns; edits lie in the rest alone.

    The common part is found by halves of STEPS, so of longer ones a piece may stay, which changes no distance.
    """
    steps = F.array(*[F.lit(k) for k in STEPS])
    more = lambda at, k, ok: F.when(ok, at + k).otherwise(at)
    long_, short, m, n = F.col("_longer"), F.col("_shorter"), F.col("_m"), F.col("_n")
    ahead = F.aggregate(steps, F.lit(0), lambda p, k: more(p, k, (p + k <= n) & (F.substring(long_, p + 1, k) == F.substring(short, p + 1, k))))
    behind = F.aggregate(steps, F.lit(0), lambda q, k: more(q, k, (q + k <= n - F.col("_ahead")) & (F.substring(long_, m - q - k + 1, k) == F.substring(short, n - q - k + 1, k))))
    core = lambda text, size: F.substring(text, F.col("_ahead") + 1, size - F.col("_ahead") - F.col("_behind"))
    return [{"_m": F.length("_longer"), "_n": F.length("_shorter")}, {"_ahead": ahead}, {"_behind": behind}, {"_longer": core(long_, m), "_shorter": core(short, n), "_n": n - F.col("_ahead") - F.col("_behind")}]


def mostly_there(edits: int, segments: int) -> Column:
    """Whether ``_longer`` has all but ``edits`` of the ``segments`` of ``_shorter`` (of ``_n`` code points) near their places.

    Half of them are looked for first, which tells most pairs off.
    """
    found = []
    for i in range(segments):
        start, width = segment(F.col("_n"), i, segments)
        first = F.greatest(F.lit(0), start - edits)
        found.append(F.contains(F.substring("_longer", first + 1, start - first + width + edits), F.substring("_shorter", start + 1, width)).cast("int"))
    half = found[::2]
    return (reduce(Column.__add__, half) >= len(half) - edits) & (reduce(Column.__add__, found) >= segments - edits)


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two texts are within ``edits`` edits, for texts whose lengths differ by no more.

    Column by column of the dynamic program, bit ``k`` stands for the row that is ``k - edits`` below the column's own:
    ``vp`` and ``vn`` say where a cell is one more or one less than the cell above it, ``d0`` where it equals the cell
    diagonally before it. The last cell's diagonal starts at the difference of the lengths and grows by one in each
    column in which its bit of ``d0`` is unset.
    """
    longer = F.when(F.length(a) >= F.length(b), a).otherwise(b)
    shorter = F.when(F.length(a) >= F.length(b), b).otherwise(a)
    pad = F.array_repeat(F.lit(""), edits)
    rows = F.concat(pad, F.split(longer, ""), pad, pad)
    gap = F.length(longer) - F.length(shorter)
    full = (1 << (2 * edits + 1)) - 1
    pair = F.struct(rows.alias("rows"), gap.alias("gap"))
    start = F.struct(F.lit(full & ~((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(0).alias("at"), F.lit(0).alias("more"))

    def step(rows: Column, gap: Column):
        def column(s: Column, c: Column) -> Column:
            bits = [F.when(F.get(rows, s["at"] + k) == c, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(2 * edits + 1)]
            match = bits[0]
            for x in bits[1:]:
                match = match.bitwiseOR(x)
            return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["at"].alias("at"), s["more"].alias("more"), match.alias("match"))

        def next_(s: Column) -> Column:
            vp, vn, match = s["vp"], s["vn"], s["match"]
            d0 = (match.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(match).bitwiseOR(vn).bitwiseAND(F.lit(full))
            return F.struct(vp.alias("vp"), vn.alias("vn"), s["at"].alias("at"), s["more"].alias("more"), d0.alias("d0"))

        def update(s: Column) -> Column:
            vp, vn, d0 = s["vp"], s["vn"], s["d0"]
            hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(F.lit(full)))
            hn = d0.bitwiseAND(vp)
            down = F.shiftright(d0, 1)
            return F.struct(
                hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(F.lit(full))).alias("vp"),
                down.bitwiseAND(hp).alias("vn"),
                (s["at"] + 1).alias("at"),
                (s["more"] + F.when(d0.bitwiseAND(F.element_at(F.array(*[F.lit(1 << (edits + g)) for g in range(edits + 1)]), gap + 1)) == 0, 1).otherwise(0)).alias("more"),
            )

        # Each part is bound by a one-element transform, so that it is computed once.
        bound = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
        return lambda s, c: bound(bound(column(s, c), next_), update)

    run = F.transform(F.array(pair), lambda p: p["gap"] + F.aggregate(F.split(shorter, ""), start, step(p["rows"], p["gap"]), lambda s: s["more"]))
    return (gap <= edits) & (F.element_at(run, 1) <= edits)


def verified(pairs: DataFrame, la: str, lb: str, edits: int) -> DataFrame:
    """``a`` and ``b`` of pairs whose texts ``la`` and ``lb`` are within ``edits`` edits."""
    for columns in (by_length(la, lb), *cores()):
        pairs = pairs.withColumns(columns)
    # Behind a generator, so that no condition is moved below and computes the columns again.
    pairs = pairs.select("a", "b", F.explode(F.array(F.struct("_longer", "_shorter", "_n"))).alias("c")).select("a", "b", "c.*")
    pairs = pairs.where((F.length("_longer") - F.col("_n") <= edits) & mostly_there(edits, CHECKED))
    return pairs.where((F.col("_n") == 0) | within(F.col("_longer"), F.col("_shorter"), edits)).select("a", "b")


def meetings(keyed: DataFrame, names: list[str], own: list[int]) -> DataFrame:
    """``a``, ``b``, ``hot``: lines that meet at a key, HOT at most for each probe; of a hot key one row for each probe.

    ``keyed``: ``id`` and its probe keys ``names``, of which those at ``own`` are its index keys.
    """
    each = Window.partitionBy("key")
    index = keyed.select(F.col("id").alias("a"), F.explode(F.array(*[names[i] for i in own])).alias("key")).withColumns({"lines": F.count("*").over(each), "least": F.min("a").over(each)})
    index = index.where((F.col("lines") <= HOT) | (F.col("a") == F.col("least"))).select("key", "a", (F.col("lines") > HOT).alias("hot"))  # a hot key is one row
    probes = keyed.select(F.col("id").alias("b"), F.explode(F.array(*names)).alias("key"))
    # Every line probes its own segments too, so a line with a hot segment shows up as the one that probes it.
    return index.join(probes, "key").where("hot OR a <> b")


def near_lines(docs: DataFrame, edits: int, least: int) -> DataFrame:
    """Pairs ``a``, ``b`` of distinct lines (by hash) within ``edits`` edits of each other."""
    if edits not in (0, 1, 2):
        raise ValueError("lines are compared within 0, 1 or 2 edits")
    lines = lines_of(docs, least)
    probes, own = entries(edits)
    # What is shuffled of a line are its keys, as numbers; equal lines have equal ones.
    names = [f"k{i}" for i in range(len(probes))]
    keyed = stored(lines.select("id", *[k.alias(c) for k, c in zip(probes, names, strict=True)]).groupBy("id").agg(*[F.min(c).alias(c) for c in names]))
    met = meetings(keyed, names, own)
    met = met.select(F.when(F.col("hot"), F.col("b")).otherwise(F.least("a", "b")).alias("a"), F.when(~F.col("hot"), F.greatest("a", "b")).alias("b"))
    met = stored(met.distinct())

    # Texts of the lines that met: a bitmap of their hashes, of bounded size, keeps most others out of the shuffle.
    need = met.select(F.explode(F.array("a", "b")).alias("id")).where("id IS NOT NULL")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * met.count()).bit_length()))
    word, bit = f"cast(pmod(id, {bits}) >> 6 as int)", f"cast(pmod(id, {bits}) & 63 as int)"
    bitmap = need.selectExpr(f"{word} AS _word", f"shiftleft(1L, {bit}) AS _bit").groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    some = lines.select("id", "line").join(F.broadcast(bitmap), F.expr(word) == F.col("_word"))
    some = some.where(F.expr(f"(shiftrightunsigned(_bits, {bit}) & 1) = 1")).select("id", "line")
    texts = stored(some.groupBy("id").agg(F.any_value("line").alias("line")))

    pairs = met.where("b IS NOT NULL")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b")
    links = stored(verified(both, "la", "lb", edits))
    hot = met.where("b IS NULL").select(F.col("a").alias("id"))
    if not edits or hot.isEmpty():
        return links
    return stored(links.unionByName(near_at_hot(stored(texts.join(hot, "id", "left_semi")), edits)))


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, ``n_lines`` and ``n_removed``.

    Lines (between line feeds, trimmed of spaces, tabs and carriage returns) of ``least`` code points or more that are
    equal or linked by steps of ``edits`` edits at most form a group; of each group the first line stays, by ``doc_id``
    (null last) and place, and the others go. Everything else in a text stays as it is.

    Defined cases: a null text stays null, with no lines; an empty text has one empty line; a text whose lines all go
    becomes empty; rows equal in id and text are one document and are treated alike; long texts are split whole; an
    empty table gives an empty result; columns of ``docs`` with the names of results are replaced. Lines are known by a
    64-bit hash.
    """
    places = stored(lines_of(docs, least).select("id", "doc_id", "doc_key", "pos").distinct())
    groups = components(near_lines(docs, edits, least))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc_key", "pos")
    grouped = places.join(groups, "id", "left").select(F.coalesce("component_id", "id").alias("group"), "doc_id", "doc_key", "pos")
    firsts = grouped.groupBy("group").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("group", "first")
    firsts = stored(firsts)  # so that a hot group can be split where it is joined
    gone = grouped.join(firsts, "group").where(place != F.col("first")).select("doc_key", "pos")
    gone = gone.groupBy("doc_key").agg(F.sort_array(F.collect_list("pos")).alias("_gone")).withColumnRenamed("doc_key", "_key")

    rows = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_removed")])
    out = rows.withColumn("_doc", F.xxhash64("doc_id", "text")).join(gone, F.col("_doc") == F.col("_key"), "left")
    lines = F.split("text", "\n", -1)
    # What stands between the lines that go: from after each of them up to the next.
    from_ = F.concat(F.array(F.lit(-1)), F.col("_gone"))
    to = F.concat(F.col("_gone"), F.array(F.col("n_lines")))
    kept = F.flatten(F.transform(F.arrays_zip(from_.alias("f"), to.alias("t")), lambda g: F.slice(lines, g["f"] + 2, g["t"] - g["f"] - 1)))
    out = out.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0))).withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = out.withColumn("text", text).withColumn("n_removed", F.coalesce(F.size("_gone"), F.lit(0)))
    out = out.withColumn("n_removed", F.when(F.col("_gone").isNull(), 0).otherwise(F.col("n_removed")))
    return out.select(*rows.columns, F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"))
