"""Report visuals to plans: roles to groups and values, and filters along relationships.

A visual's columns in grouping roles make its groups; measures, and columns that the model sums, are its values. A group
filters the table of a value through active relationships, from the one side to the many side, and the other way as well
where a relationship filters in both directions. The path is searched over the model's few relationships; it becomes a
chain of joins of distinct keys, so a value that several keys lead to counts once in each group.

Measures are evaluated over the fact table in the context of each group. Groups that nothing leads to from the fact table
have no row, and facts that no group leads to form the blank group, whose name is null. Where no path leads to a value's
table, the groups don't filter it. Rows whose values are all blank are left out.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelineage.operators import measures as m

# Roles of a visual whose columns group. In the other roles, columns that the model doesn't sum group too.
GROUPING_ROLES = ("Category", "Location", "Field", "Rows", "Columns", "Series", "Legend", "Group", "Details", "X")
MEASURE_TABLE = "_Measures"


@dataclass(frozen=True)
class Relationship:
    """Many side first."""

    from_table: str
    from_column: str
    to_table: str
    to_column: str
    is_active: bool = True
    both: bool = False


@dataclass(frozen=True)
class Model:
    tables: dict[str, DataFrame]
    relationships: tuple[Relationship, ...] = ()
    summed: frozenset[tuple[str, str]] = frozenset()  # (table, column) that the model sums
    fact: str = "sales_dashboard"


@dataclass(frozen=True)
class Field:
    role: str
    entity: str
    property: str
    is_measure: bool


@dataclass
class Visual:
    groups: list[Field] = field(default_factory=list)
    measures: list[Field] = field(default_factory=list)
    sums: list[Field] = field(default_factory=list)


def relationships_of(rows: DataFrame) -> tuple[Relationship, ...]:
    """From the rows of a model's relationships file: one row per relationship."""
    return tuple(Relationship(r.from_table, r.from_column, r.to_table, r.to_column, r.is_active, r.cross_filter == "bothDirections") for r in rows.collect())


def fields_of(rows: DataFrame) -> dict[str, list[Field]]:
    """Fields of each visual (``file``), in order: a row per projection of a report."""
    found: dict[str, list[Field]] = {}
    for r in rows.orderBy("file", "role", "place").collect():
        found.setdefault(r.file, []).append(Field(r.role, r.entity, r.property, r.field_type == "measure"))
    return found


def split(fields: Iterable[Field], model: Model) -> Visual:
    out = Visual()
    for f in fields:
        kind = out.measures if f.is_measure else out.groups if f.role in GROUPING_ROLES or (f.entity, f.property) not in model.summed else out.sums
        kind.append(f)
    return out


def path(model: Model, start: str, end: str) -> list[tuple[str, str, str]] | None:
    """Steps (column here, next table, column there) by which a filter on ``start`` reaches ``end``: the fewest there are."""
    todo, seen = deque([(start, [])]), {start}
    while todo:
        at, steps = todo.popleft()
        if at == end:
            return steps
        for r in (r for r in model.relationships if r.is_active):
            for here, column, there, other in ((r.to_table, r.to_column, r.from_table, r.from_column), (r.from_table, r.from_column, r.to_table, r.to_column))[: 1 + r.both]:
                if here == at and there not in seen and there in model.tables:
                    seen.add(there)
                    todo.append((there, [*steps, (column, there, other)]))
    return None


def in_context(model: Model, groups: list[Field], table: str) -> tuple[DataFrame, list[str]]:
    """Rows of ``table`` with a column per group that filters it (``_g0``, ``_g1``, ... by the group's place), and those columns."""
    rows, kept = model.tables[table], []
    for entity in dict.fromkeys(g.entity for g in groups):
        own = [(f"_g{i}", g.property) for i, g in enumerate(groups) if g.entity == entity]
        steps = path(model, entity, table)
        if steps is None:
            continue
        kept += [name for name, _ in own]
        if not steps:
            rows = rows.withColumns({name: F.col(c) for name, c in own})
            continue
        keys = model.tables[entity].select(*[F.col(c).alias(name) for name, c in own], F.col(steps[0][0]).alias("_key")).distinct()
        for (_, there, column), after in zip(steps, [*steps[1:], None], strict=True):
            if after is None:
                rows = rows.join(keys.withColumnRenamed("_key", "_on"), F.col(column) == F.col("_on"), "left").drop("_on")
            else:
                onward = model.tables[there].select(F.col(column).alias("_on"), F.col(after[0]).alias("_next"))
                keys = onward.join(keys, F.col("_on") == F.col("_key")).select(*[name for name, _ in own], F.col("_next").alias("_key")).distinct()
    return rows, kept


def year_to_date(rows: DataFrame, by: list[str], value: Callable, name: str) -> DataFrame:
    """Over the dates of each context in the year of its last one."""
    last = rows.groupBy(*by).agg(F.trunc(F.max("OrderDate"), "year").alias("_from"))
    return m.on(by, rows, last).where(F.col("OrderDate") >= F.col("_from")).groupBy(*by).agg(value().alias(name))


def month_before(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Change of revenue against the dates of a context moved back by a month, in its own rows."""
    moved = rows.select(*by, F.add_months("OrderDate", -1).alias("OrderDate")).distinct()
    before = m.on([*by, "OrderDate"], rows, moved, "left_semi").groupBy(*by).agg(m.revenue().alias("_before"))
    both = m.on(by, rows.groupBy(*by).agg(m.revenue().alias("_now")), before)
    return both.select(*by, m.ratio(m.minus(F.col("_now"), F.col("_before")), F.col("_before")).alias(name))


def measure(rows: DataFrame, by: list[str], name: str, model: Model, groups: list[Field]) -> DataFrame:
    """``by`` and the measure ``name`` in the context of each group of ``rows``."""
    if name == "New Customers":
        return m.new_customers(rows, by)
    if name in ("Revenue YTD", "Profit YTD"):
        return year_to_date(rows, by, m.revenue if name == "Revenue YTD" else m.profit, name)
    if name == "MoM Revenue %":
        return month_before(rows, by, name)
    if name.startswith("Executive "):  # year to date only where dates are filtered, which no group of this fact does
        value = {"Executive Revenue KPI": m.revenue(), "Executive Profit KPI": m.profit(), "Executive Margin KPI": m.ratio(m.profit(), m.revenue())}[name]
        return rows.groupBy(*by).agg(value.alias(name))
    if name == "Territory Revenue Rank":
        return m.dense_revenue_rank(rows, by[0]).withColumnRenamed("Territory Revenue Rank", name) if by else rows.agg(F.lit(1).alias(name))
    if name == "Territory Revenue %":  # only the fact table's own region is taken out of the filter
        over = [f"_g{i}" for i, g in enumerate(groups) if (g.entity, g.property) == (model.fact, "Region") and f"_g{i}" in by]
        return m.share_of_total(rows, by, over[0], name, F.sum("Revenue")) if over else rows.groupBy(*by).agg(m.ratio(m.revenue(), m.revenue()).alias(name))
    return m.evaluate(rows, by, [name])


def beside(groups: list[str], parts: list[DataFrame]) -> DataFrame:
    """Values by the same groups in one row, whichever part has the group."""

    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        other = b.withColumnsRenamed({g: f"_o{g}" for g in groups})
        same = reduce(lambda x, g: x & F.col(g).eqNullSafe(F.col(f"_o{g}")), groups, F.lit(True))
        found = a.join(other, same, "full") if groups else a.crossJoin(other)  # without groups: one row each
        return found.withColumns({g: F.coalesce(g, f"_o{g}") for g in groups}).drop(*[f"_o{g}" for g in groups])

    return reduce(both, parts)


def compile_visual(model: Model, fields: Iterable[Field]) -> DataFrame:
    """A column per field, under its property's name (with its table's where two have one name)."""
    fields = list(fields)
    visual = split(fields, model)
    every = [f"_g{i}" for i in range(len(visual.groups))]
    parts, names = [], {}

    def keep(part: DataFrame, kept: list[str], columns: dict[str, str]) -> None:
        lost = [g for g in every if g not in kept]
        if lost and kept:
            raise ValueError("groups of which only some filter a value are not supported")
        if lost:  # one row, beside every group
            own = [visual.groups[int(g[2:])] for g in lost]
            if len({g.entity for g in own}) > 1:
                raise ValueError("groups of several tables that don't filter a value are not supported")
            part = model.tables[own[0].entity].select(*[F.col(f.property).alias(g) for f, g in zip(own, lost, strict=True)]).distinct().crossJoin(F.broadcast(part))
        parts.append(part.withColumnsRenamed(columns))
        names.update(columns)

    if visual.measures:
        rows, kept = in_context(model, visual.groups, model.fact)
        plain = [f.property for f in visual.measures if f.property in m.MEASURES]
        if plain:
            keep(m.evaluate(rows, kept, plain), kept, {p: f"_m{p}" for p in plain})
        for f in visual.measures:
            if f.property not in m.MEASURES:
                keep(measure(rows, kept, f.property, model, visual.groups), kept, {f.property: f"_m{f.property}"})
    for table in dict.fromkeys(f.entity for f in visual.sums):
        rows, kept = in_context(model, visual.groups, table)
        own = [f.property for f in visual.sums if f.entity == table]
        keep(rows.groupBy(*kept).agg(*[F.sum(c).alias(f"_s{c}") for c in own]), kept, {f"_s{c}": f"_s{table}.{c}" for c in own})
    if not parts:  # a list of values
        if len({g.entity for g in visual.groups}) != 1:
            raise ValueError("a visual without values lists the columns of one table")
        return model.tables[visual.groups[0].entity].select(*[g.property for g in visual.groups]).distinct()
    out = beside(every, parts)
    values = [c for c in out.columns if c not in every]
    if every:
        out = out.where(reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in values]))
    often = [f.property for f in fields]
    label = lambda f: f.property if often.count(f.property) == 1 else f"{f.entity}.{f.property}"
    groups = iter(every)
    column = lambda f: f"_m{f.property}" if f.is_measure else f"_s{f.entity}.{f.property}" if f in visual.sums else next(groups)
    return out.select(*[F.col(f"`{column(f)}`").alias(label(f)) for f in fields])
