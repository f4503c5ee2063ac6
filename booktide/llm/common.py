"""What the operators share: reading, scratch tables, gapless ranks, components."""

from __future__ import annotations

import atexit
import gc
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a table whose size is counted first may be broadcast.
BROADCAST_ROWS = 50_000
#: Links up to which components are found in one task, without a shuffle (3 MB).
LINKS_IN_ONE = 200_000
#: Rows of a batch that goes to Python.
ARROW_ROWS = 1000

_scratch: list[tuple[SparkSession, str]] = []
_shipped: dict[str, str] = {}
_made: ContextVar[list[DataFrame] | None] = ContextVar("_made", default=None)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, whatever store that folder is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """df.mapInArrow, with this package sent to the executors once for each Spark context.

    Batches have ARROW_ROWS rows unless the session says otherwise: rows can be long texts, and a batch is held by both sides.
    """
    context, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    if _shipped.get("to") != context.applicationId:
        top = Path(__file__).resolve().parents[1]
        path = f"{tempfile.mkdtemp()}/{top.name}.zip"
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(top.rglob("*.py")):
                out.write(file, file.relative_to(top.parent))
        context.addPyFile(path)
        _shipped["to"] = context.applicationId
    return df.mapInArrow(fn, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or one of our own where that is unset (tests, one machine)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster scratch tables need a folder that all machines share")
        at = "file:///tmp/checkpoints/booktide"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def kept(df: DataFrame, release: bool = False) -> DataFrame:
    """df written as a table to the shared folder and read back: lineage ends here, each later read sees the same rows, and a lost executor costs nothing but its running tasks. The folder goes when the program ends. release: also ask the driver to let go of the shuffle files of what has been written, which else stay until it collects garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/booktide-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch.append((spark, path))
    if release:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if (made := _made.get()) is not None:
        made.append(out)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that kept has returned and that nothing reads any more, in place of when the program ends."""
    for df in tables:
        entry = (df.sparkSession, df._scratch_path)
        _scratch.remove(entry)
        _delete(*entry)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within it, tables that kept returns last to its end only, but for those handed to the function that it gives. No other may be read later."""
    made, stays = [], []
    token = _made.set(made)
    try:
        yield lambda df: (stays.append(df), df)[1]
    finally:
        _made.reset(token)
        dropped(*(df for df in made if not any(df is x for x in stays) and (df.sparkSession, df._scratch_path) in _scratch))
        if (outer := _made.get()) is not None:
            outer += stays


def forget() -> None:
    """Delete the scratch tables of this program."""
    while _scratch:
        spark, path = _scratch.pop()
        if spark.sparkContext._jsc is None:  # the session is gone already
            print(f"left behind: {path}", file=sys.stderr)
            continue
        _delete(spark, path)


atexit.register(forget)


def fresh(name: str, columns: Sequence[str]) -> str:
    """name, with as many underscores after it as it takes to be none of columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a kept table, if a count shows that it is small; else the table itself, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str | None = None) -> DataFrame:
    """df with ``rank`` (from 0, gapless in each group) and, if value names a long column, ``before`` (its sum over the earlier rows of the group).

    The group columns hold no nulls. Rows are dealt by ranges of (group, order), so a group of any size is spread over many tasks; each
    task numbers its own part, and a prefix sum over the parts' totals (one row for each task and group) gives each part its start. Rows
    that tie in all of order get different ranks in no fixed order.
    """
    parts = kept(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*group, *order, "_tie")
        .withColumn("_part", F.spark_partition_id())
    )
    total = [F.count(F.lit(1)).alias("_rows"), *([F.sum(value).alias("_sum")] if value else [])]
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part", *group).agg(*total).select(
        "_part", *group, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rank0"),
        *([F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum0")] if value else []),
    )
    own = Window.partitionBy("_part", *group).orderBy(*order, "_tie")
    numbered = parts.withColumn("rank", F.row_number().over(own))
    if value:
        numbered = numbered.withColumn("before", F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    out = numbered.join(starts, ["_part", *group]).withColumn("rank", F.col("rank") - 1 + F.col("_rank0"))
    if value:
        out = out.withColumn("before", F.col("before") + F.col("_sum0"))
    return out.drop("_part", "_tie", "_rank0", "_sum0")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of links (two long columns): one row (id, component) for each id in a link; component is the smallest id reachable.

    Alternating large-star and small-star rounds: each node passes its smallest neighbour on to the others, so a path shrinks by a
    constant factor in a round. Each round is written to the shared folder. A node's neighbours are only ever met through partial
    aggregation (min), never gathered; the driver sees one count for each round. Up to LINKS_IN_ONE links, of which rounds only make
    fewer, one task takes a round: its shuffles would be many tasks of a few rows, whose records the driver holds.
    """
    edges = kept(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    together = (lambda df: df.coalesce(1)) if edges.count() <= LINKS_IN_ONE else (lambda df: df)
    before = None
    while True:
        both = together(edges.union(edges.select("v", "u")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = kept(large.where("u <> v").distinct())
        own = together(down)
        low = own.groupBy("u").agg(F.min("v").alias("m"))
        small = together(own.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))))
        edges, old = kept(small.where("u <> v").distinct()), edges
        dropped(old, down)
        now = together(edges).agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    member = together(edges).select(F.col("u").alias("id"), F.col("v").alias("component"))
    return member.union(member.select(F.col("component").alias("id"), "component").distinct())


def long_of(hex_digits: Column) -> Column:
    """Up to 15 hex digits as a long."""
    return F.conv(hex_digits, 16, 10).cast("long")
