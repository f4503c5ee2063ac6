"""Writing facts: rows with citations, all of a unit or nothing, reports, proposals, and a trace from a result to its frames."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def artifacts(rows: DataFrame, known: DataFrame, parser: str) -> DataFrame:
    """The files that rows cite (relpath, sha256) and that are not known yet under this parser: artifact_id, relpath, sha256, parser_version.

    Ids go on after the known ones. known: artifact_id, relpath, parser_version.
    """
    own = known.where(F.col("parser_version") == parser)
    new = rows.groupBy("relpath").agg(F.min("sha256").alias("sha256")).join(own.select("relpath"), "relpath", "left_anti")
    last = known.agg(F.coalesce(F.max("artifact_id"), F.lit(0))).first()[0]
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("relpath"))  # files of one unit of work
    return new.select((n + last).alias("artifact_id"), "relpath", "sha256", F.lit(parser).alias("parser_version"))


def cited(rows: DataFrame, files: DataFrame, parser: str) -> DataFrame:
    """rows with artifact_id in place of relpath; a row whose file is unknown is an error."""
    f = files.where(F.col("parser_version") == parser).select("relpath", "artifact_id")
    x = rows.join(f, "relpath", "left")
    there = F.when(F.col("artifact_id").isNotNull(), F.col("artifact_id")).otherwise(F.raise_error(F.concat(F.lit("no artifact for "), "relpath")))
    return x.withColumn("artifact_id", there).drop("relpath")


def child_rows(parents: DataFrame, key: str, ladders: str) -> DataFrame:
    """Levels of ladders, a column of arrays (a side each) of arrays of [price, quantity]: key, side, rank, price, qty."""
    x = parents.select(key, F.posexplode(F.from_json(ladders, "array<array<array<string>>>")).alias("side", "l"))
    return x.select(key, "side", F.posexplode("l").alias("rank", "v")).select(key, "side", "rank", F.col("v")[0].alias("price"), F.col("v")[1].alias("qty"))


def commit(spark: SparkSession, root: str, unit: str, tables: dict[str, DataFrame], check: Callable[[dict[str, DataFrame]], DataFrame] | None = None) -> bool:
    """Write the tables of one unit of work, all or nothing; False if the unit is there already.

    Each table goes to its own folder under the unit's name in staging; the folder then moves into place in one step. What is in place is
    read by facts() and never changed. check gives rule and n from the tables as written; a rule that is broken ends the unit.
    """
    jvm = spark.sparkContext._jvm
    path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((root, *parts)))
    fs = path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path("units", unit)):
        return False
    fs.delete(path("staging", unit), True)
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/staging/{unit}/{name}")
    if check is not None:
        written = {name: spark.read.schema(df.schema).parquet(f"{root}/staging/{unit}/{name}") for name, df in tables.items()}
        if bad := [(r.rule, r.n) for r in check(written).where("n > 0").collect()]:  # a row for each rule
            fs.delete(path("staging", unit), True)
            raise ValueError(f"{unit}: rules broken: {bad}")
    fs.mkdirs(path("units"))
    if not fs.rename(path("staging", unit), path("units", unit)):
        raise OSError(f"{unit} could not be moved into place")
    return True


def facts(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    """All committed rows of a table, with the unit that wrote each."""
    x = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{root}/units")
    at = F.split(F.col("_metadata.file_path"), "/")
    return x.withColumns({"unit": F.element_at(at, -3), "_table": F.element_at(at, -2)}).where(F.col("_table") == table).drop("_table")


def counted(rows: DataFrame, reason: str, at: str, ref: str) -> DataFrame:
    """How often each reason occurs, with its first and last place: reason, n, first_ms, first_ref, last_ms, last_ref."""
    place = F.struct(at, ref)
    return rows.groupBy(F.col(reason).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_ms"), F.min_by(ref, place).alias("first_ref"), F.max(at).alias("last_ms"), F.max_by(ref, place).alias("last_ref"))


def markdown(df: DataFrame, title: str, most: int = 10_000) -> str:
    """A small result as a Markdown table. A result of more rows than most is an error: reports are of aggregates."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{title}: more than {most} rows")
    told = lambda v: "" if v is None else f"{v:g}" if isinstance(v, float) else str(v)
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(told(v) for v in r) + " |" for r in rows), ""])


def csv_report(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def proposals(sides: DataFrame, method: str) -> str:
    """Corrections for the sides of clean links as TOML: venue, native_id, side, evidence. They take effect once a person has approved them."""
    out = []
    for r in sides.orderBy("venue", "native_id", "side").toLocalIterator():
        fields = {"venue": r.venue, "native_id": r.native_id, "side": r.side, "status": "manual_verified", "method": method, "evidence": r.evidence}
        out.append("[[correction]]\n" + "".join(f"{k} = {json.dumps(v)}\n" for k, v in fields.items()))
    return "\n".join(out)


def specs(text: str, table: str) -> list[dict]:
    """The entries of one table of a TOML text (signals, corrections, games)."""
    import tomllib

    return tomllib.loads(text).get(table, [])


def traced(results: DataFrame, links: list[tuple[DataFrame, str, str]], frames: DataFrame, ref: str) -> DataFrame:
    """results with the rows they rest on, one link after another, and the hash of the frame that the last one cites.

    links: (table, column of what has been joined so far, key of the table). frames: ref, frame. A citation without a frame has hash null;
    see untraced. Columns of linked tables have the place of their link before their names.
    """
    x = results
    for k, (table, mine, key) in enumerate(links):
        t = table.select(*(F.col(c).alias(f"l{k}_{c}") for c in table.columns))
        x = x.join(t, x[mine] == t[f"l{k}_{key}"], "left")
    f = frames.select(F.col("ref").alias("_ref"), F.sha2("frame", 256).alias("frame_sha256"))
    return x.join(f, x[ref] == f["_ref"], "left").drop("_ref")


def untraced(rows: DataFrame) -> DataFrame:
    """Traced rows whose frame was not found."""
    return rows.where("frame_sha256 is null")


def recomputed(stored: DataFrame, again: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Results that differ from what the same facts give again: key, column, stored, again (as text). None must be left."""
    s = stored.select(*key, *(F.col(c).cast("string").alias(f"s_{c}") for c in columns))
    a = again.select(*key, *(F.col(c).cast("string").alias(f"a_{c}") for c in columns))
    x = s.join(a, key, "full")
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"s_{c}").alias("stored"), F.col(f"a_{c}").alias("again")) for c in columns))
    return x.select(*key, F.explode(pairs).alias("d")).select(*key, "d.*").where("not (stored <=> again)")


def documents(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows as canonical JSON documents: keys sorted, no spaces, no database ids among the fields."""
    cols: list[Column] = [F.col(c) for c in sorted(fields)]
    return rows.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("document"))
