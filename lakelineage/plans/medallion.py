"""Running the medallion: steps that read, transform and write, with metrics of every step."""

from __future__ import annotations

from collections.abc import Callable
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakelineage.operators import gold, silver

Transform = Callable[[DataFrame], DataFrame]


#: Table property of a version that was written whole and checked.
CHECKED = "lakelineage.checked"


def versions(spark: SparkSession, target: str) -> dict[int, tuple[str, bool]]:
    """Versions of ``target`` by number: the table and whether it was checked."""
    schema, _, name = target.rpartition(".")
    found = {}
    for t in spark.sql(f"SHOW TABLES IN {schema or 'default'} LIKE '{name.lower()}__v*'").collect():
        if m := re.fullmatch(rf"{re.escape(name)}__v(\d+)", t.tableName, re.IGNORECASE):
            own = f"{schema or 'default'}.{t.tableName}"
            found[int(m[1])] = own, any(p.key == CHECKED for p in spark.sql(f"SHOW TBLPROPERTIES {own}").collect())
    return found


def recover(spark: SparkSession, target: str) -> None:
    """Bring ``target`` to its last checked version where a crash came before its name was set, and drop what a crash left half done."""
    known = versions(spark, target)
    checked = [n for n, (_, ok) in known.items() if ok]
    if checked and not spark.catalog.tableExists(target):
        spark.sql(f"CREATE OR REPLACE VIEW {target} AS SELECT * FROM {known[max(checked)][0]}")
    for own, ok in known.values():
        if not ok:
            spark.sql(f"DROP TABLE {own}")


def publish_version(spark: SparkSession, target: str, rows: DataFrame, fmt: str = "parquet", keep: int = 2) -> int:
    """Write ``rows`` as a new version of ``target`` and set its name to it; returns the number of rows.

    The version is written aside, counted while it is written and checked; only then does the view ``target`` point to
    it, in one change of the catalog, so readers see the last good version or the new one. A step that fails or gives no
    rows changes nothing. A plain table of that name becomes version 0; if a crash comes before the view is made, the next
    step (or :func:`recover`) makes it. The last ``keep`` versions stay, for readers that began before.
    """
    if not rows.columns:
        raise ValueError(f"{target} has no columns")
    recover(spark, target)
    known = versions(spark, target)
    own = f"{target}__v{max(known, default=0) + 1}"
    seen = Observation()
    try:
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.format(fmt).saveAsTable(own)
        n = seen.get["rows"]
        if n == 0:
            raise ValueError(f"{target} has no rows")
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {own}")
        raise
    spark.sql(f"ALTER TABLE {own} SET TBLPROPERTIES ('{CHECKED}' = 'true')")
    if spark.catalog.tableExists(target) and spark.catalog.getTable(target).tableType != "VIEW":
        spark.sql(f"ALTER TABLE {target} SET TBLPROPERTIES ('{CHECKED}' = 'true')")
        spark.sql(f"ALTER TABLE {target} RENAME TO {target}__v0")
    spark.sql(f"CREATE OR REPLACE VIEW {target} AS SELECT * FROM {own}")
    for _, (old, _) in sorted(versions(spark, target).items())[:-keep]:
        spark.sql(f"DROP TABLE {old}")
    return n


@dataclass
class Run:
    """A run's format and metrics. Rows are counted while they are written, not by a second job."""

    spark: SparkSession
    format: str = "parquet"
    metrics: list[tuple[str, str, int, float, str | None]] = field(default_factory=list)

    def step(self, target: str, make: Callable[[], DataFrame]) -> bool:
        """Publish what ``make`` returns as ``target``; a failure is recorded, leaves the last good version and doesn't stop the run."""
        began = time.time()
        try:
            n = publish_version(self.spark, target, make(), self.format)
            self.metrics.append((target, "SUCCESS", n, time.time() - began, None))
            return True
        except Exception as problem:  # noqa: BLE001  a failed step is a row of the metrics
            self.metrics.append((target, "FAILED", 0, time.time() - began, f"{type(problem).__name__}: {problem}"[:2000]))
            return False

    def report(self) -> DataFrame:
        return self.spark.createDataFrame(self.metrics, "target string, status string, rows long, seconds double, error string")

    def finish(self) -> DataFrame:
        """The metrics, if every step went well."""
        failed = [m[0] for m in self.metrics if m[1] != "SUCCESS"]
        if failed:
            raise RuntimeError(f"failed: {', '.join(failed)}")
        return self.report()


SILVER: dict[str, Transform] = {"customer": silver.customers, "product": silver.products, "sales": silver.sales, "calendar": silver.calendar, "sales_territory": silver.territories}


def bootstrap(spark: SparkSession, *schemas: str) -> None:
    for s in schemas or ("bronze", "silver", "gold"):
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {s}")


def ingest(run: Run, read: Callable[[str], DataFrame], tables: dict[str, str]) -> None:
    """Bronze: ``tables`` maps a target to the landing name that ``read`` takes."""
    for target, source in tables.items():
        run.step(f"bronze.{target}", lambda source=source: read(source))


def process(run: Run, tables: dict[str, str]) -> None:
    """Silver: ``tables`` maps a silver table to its bronze one."""
    for target, source in tables.items():
        run.step(f"silver.{target}", lambda source=source, target=target: SILVER[target](run.spark.table(f"bronze.{source}")))


def publish(run: Run) -> None:
    """Gold: all tables, the catalog last."""
    t = run.spark.table
    star = gold.Star(t("silver.sales"), t("silver.customer"), t("silver.product"), t("silver.calendar"), t("silver.sales_territory"))
    for name, build in gold.BUILDERS.items():
        run.step(f"gold.{name}", lambda build=build: build(star))
    counts = run.report().where("target LIKE 'gold.%'").select(F.substring_index("target", ".", -1).alias("table"), "rows")
    run.step("gold.metadata_catalog", lambda: gold.metadata_catalog(counts, F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")))
