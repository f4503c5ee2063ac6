"""The raw archive: sealed gzip segments of text frames, journaled in manifests, read with their hashes checked."""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import json
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "file string, stream_id string, segment_id string, sha256 string, bytes long, frame_count long, first_recv_ts_ms long, last_recv_ts_ms long, sealed_ts_ms long, unclean_close boolean"
#: Rows up to which a list whose size is counted first may be broadcast.
SMALL = 50_000
#: A frame's keys, in this order.
KEYS = ["recv_ts_ms", "conn_id", "dir", "frame"]
FRAME = "relpath string, seg_pos string, line int, recv_ts_ms long, conn_id string, dir string, frame string"


class ArchiveError(ValueError):
    """A segment or frame is not as its manifest or the format says."""


def _days(days: list[str] | None) -> str:
    return "*" if days is None else "{" + ",".join(sorted(set(days))) + "}"


def segments(spark: SparkSession, root: str, source: str, days: list[str] | None = None) -> DataFrame:
    """Journaled segments of a source: the manifest's columns, relpath, day, and seg_pos, which orders them by day and place in the journal.

    Only the journals of the days asked for are opened. A torn last line of a journal is left out; other bad lines are an error.
    """
    try:
        text = spark.read.text(f"{root}/{source}/{_days(days)}/manifest.jsonl", wholetext=True).withColumn("day", F.element_at(F.split(F.input_file_name(), "/"), -2))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        text = spark.createDataFrame([], "value string, day string")
    parts = F.split("value", "\n")
    whole = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))  # what stands behind the last line feed is torn or empty
    rows = text.select("day", F.posexplode(whole).alias("pos", "line")).select("day", "pos", F.from_json("line", MANIFEST, {"mode": "FAILFAST"}).alias("m"))
    return rows.select("m.*", "day", F.concat_ws("/", F.lit(source), "day", "m.file").alias("relpath"), F.concat_ws("/", "day", F.lpad(F.col("pos").cast("string"), 9, "0")).alias("seg_pos"))


def overlapping(segs: DataFrame, lo: int, hi: int) -> DataFrame:
    """Segments whose times meet [lo, hi], by the manifest alone, so that no other file is opened."""
    return segs.where((F.col("first_recv_ts_ms") <= hi) & (F.col("last_recv_ts_ms") >= lo))


def decoded(rel: str, lines: Iterator[bytes], count: int | None, whole: bool = True) -> Iterator[tuple[int, int, str, str, str]]:
    """(line, recv_ts_ms, conn_id, dir, frame) of each line, checked one by one; at the end the count. whole: a torn last line is an error, else it is left out."""
    n = 0
    for n, raw in enumerate(lines, 1):
        if not raw.endswith(b"\n"):
            if whole:
                raise ArchiveError(f"{rel}: the last line is torn")
            return
        r = json.loads(raw)
        if list(r) != KEYS or not isinstance(r["recv_ts_ms"], int) or r["dir"] not in ("in", "out", "event") or not isinstance(r["conn_id"], str) or not isinstance(r["frame"], str):
            raise ArchiveError(f"{rel}#{n - 1}: not a frame")
        yield n - 1, *(r[k] for k in KEYS)
    if count is not None and n != count:
        raise ArchiveError(f"{rel}: {n} frames, the manifest says {count}")


def _told(rows: Iterator[tuple], rel: str, pos: str | None) -> Iterator[pa.RecordBatch]:
    """Frames in batches, so that a segment of any length is never held decoded."""
    while part := list(itertools.islice(rows, 5_000)):
        line, *rest = zip(*part, strict=True)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([rel] * len(part)), pa.array([pos] * len(part), pa.string()), pa.array(line, pa.int32()), *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))], ["relpath", "seg_pos", "line", *KEYS])


def frames(spark: SparkSession, root: str, segs: DataFrame) -> DataFrame:
    """The frames of segments, each file checked first by size and sha256, then line by line, and last by its count.

    Files are found by their day folders; one that is listed but missing is an error. A file is decompressed as it is read.
    """
    listed = segs.select("relpath", "seg_pos", "bytes", "sha256", "frame_count")
    where = {r.at for r in segs.select(F.regexp_replace("relpath", "/[^/]+$", "").alias("at")).distinct().collect()}  # a folder for each source and day
    if not where:
        return spark.createDataFrame([], FRAME)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load([f"{root}/{x}" for x in sorted(where)])
    named = files.withColumn("relpath", F.array_join(F.slice(F.split("path", "/"), -3, 3), "/"))
    if lost := listed.join(named.select("relpath"), "relpath", "left_anti").first():
        raise ArchiveError(f"{lost.relpath}: listed, but missing")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rel, pos, size, sha, count = (batch.column(c)[k].as_py() for c in ("relpath", "seg_pos", "bytes", "sha256", "frame_count"))
                content = batch.column("content")[k].as_buffer()
                if len(content) != size or hashlib.sha256(content).hexdigest() != sha:
                    raise ArchiveError(f"{rel}: size or hash differs from the manifest")
                yield from _told(decoded(rel, gzip.open(pa.BufferReader(content)), count), rel, pos)

    few = listed.limit(SMALL + 1).count() <= SMALL
    return named.join(F.broadcast(listed) if few else listed, "relpath").select("relpath", "seg_pos", "content", "bytes", "sha256", "frame_count").mapInArrow(decode, FRAME)


def active_frames(spark: SparkSession, root: str, source: str, days: list[str] | None = None) -> DataFrame:
    """The frames of segments that are still written (*.part): nothing vouches for them, and a torn last line is left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.part").load(f"{root}/{source}/{_days(days)}")
    named = files.select(F.array_join(F.slice(F.split("path", "/"), -3, 3), "/").alias("relpath"), "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rel = batch.column("relpath")[k].as_py()
                yield from _told(decoded(rel, iter(io.BytesIO(batch.column("content")[k].as_buffer()).readline, b""), None, whole=False), rel, None)

    return named.mapInArrow(decode, FRAME)


def all_frames(spark: SparkSession, root: str, source: str, lo: int, hi: int) -> DataFrame:
    """Frames received in [lo, hi] from sealed and active segments of the days that these times touch."""
    day = lambda ms: datetime.fromtimestamp(ms / 1000, UTC).date()
    days = [str(day(lo) + timedelta(n)) for n in range((day(hi) - day(lo)).days + 1)]
    sealed = frames(spark, root, overlapping(segments(spark, root, source, days), lo, hi))
    return sealed.unionByName(active_frames(spark, root, source)).where(F.col("recv_ts_ms").between(lo, hi))


def window(spark: SparkSession, root: str, source: str, lo: int, hi: int) -> DataFrame:
    """Frames of a source received in [lo, hi], in order of time, segment and line."""
    found = frames(spark, root, overlapping(segments(spark, root, source), lo, hi))
    return found.where(F.col("recv_ts_ms").between(lo, hi)).orderBy("recv_ts_ms", "seg_pos", "line")


def rest_exchanges(framed: DataFrame) -> DataFrame:
    """Requests with their bodies and completions, one row for each request id. A second body is an error.

    An exchange is ok when it completed without failure, with a status of 2xx and a body. Unfinished ones stay, without a completion.
    Columns: request_id, request, complete (JSON), body (recv_ts_ms, seg_pos, line, relpath, frame), first_ms, done_ms, status, ok, path, query,
    purpose, subjects, headers, session_id.
    """
    kind = F.get_json_object("frame", "$.type")
    pos = F.col("seg_pos") if "seg_pos" in framed.columns else F.lit(None).cast("string").alias("seg_pos")
    body = F.when(F.col("dir") == "in", F.struct("recv_ts_ms", pos, "line", "relpath", "frame"))
    is_event = lambda t: (F.col("dir") == "event") & (kind == t)
    rid = F.coalesce(F.when(F.col("dir") == "event", F.get_json_object("frame", "$.request_id")), "conn_id")
    g = framed.groupBy(rid.alias("request_id")).agg(
        F.max(F.when(is_event("rest_request"), F.col("frame"))).alias("request"), F.max(F.when(is_event("rest_complete"), F.col("frame"))).alias("complete"), F.count(body).alias("n"),
        F.min(body).alias("body"), F.min("recv_ts_ms").alias("first_ms"), F.max(F.when(is_event("rest_complete"), F.col("recv_ts_ms"))).alias("done_ms"),
    )
    g = g.where("request is not null").withColumn("body", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("second body of request "), "request_id"))).otherwise(F.col("body"))).drop("n")
    status = F.get_json_object("complete", "$.status").cast("int")
    ok = F.col("complete").isNotNull() & F.get_json_object("complete", "$.failure").isNull() & status.between(200, 299) & F.col("body").isNotNull()
    asked = lambda k: F.get_json_object("request", f"$.{k}").alias(k)
    return g.select(
        "*", status.alias("status"), F.coalesce(ok, F.lit(False)).alias("ok"), asked("path"), asked("query"), asked("purpose"), asked("origin"), asked("session_id"), asked("start_ts_ms").cast("long"),
        F.from_json(F.get_json_object("request", "$.subjects"), "array<string>").alias("subjects"), F.from_json(F.get_json_object("complete", "$.response_headers"), "array<array<string>>").alias("headers"),
    )


def rest_stream(framed: DataFrame) -> DataFrame:
    """The same over a stream of frames: an exchange is told when its completion arrives, and its state is dropped then. Columns: request_id, request, complete, body."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    rid = F.coalesce(F.when(F.col("dir") == "event", F.get_json_object("frame", "$.request_id")), "conn_id")
    keyed = framed.select(rid.alias("request_id"), F.when(F.col("dir") == "event", F.get_json_object("frame", "$.type")).otherwise(F.when(F.col("dir") == "in", "body")).alias("kind"), "frame")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = dict(zip(("request", "body"), state.get, strict=True)) if state.exists else {"request": None, "body": None}
        for pdf in batches:
            for kind, frame in zip(pdf.kind, pdf.frame, strict=True):
                if kind == "body" and held["body"] is not None:
                    raise ArchiveError(f"second body of request {key[0]}")
                held |= {"body": frame} if kind == "body" else {"request": frame} if kind == "rest_request" else {"done": frame} if kind == "rest_complete" else {}
        if "done" in held:
            if state.exists:
                state.remove()
            if held["request"] is not None:
                yield pd.DataFrame([(key[0], held["request"], held["done"], held["body"])], columns=["request_id", "request", "complete", "body"])
        else:
            state.update((held["request"], held["body"]))

    return keyed.groupBy("request_id").applyInPandasWithState(step, "request_id string, request string, complete string, body string", "request string, body string", "append", GroupStateTimeout.NoTimeout)


def resume_index(exchanges: DataFrame) -> DataFrame:
    """What an archive holds already: for each source, URL and query the latest good response: done_ms, purpose, body, the one that ended last.

    exchanges: rows of rest_exchanges with a column source.
    """
    good = exchanges.where("ok").withColumn("url", F.concat("origin", "path"))
    pick = F.struct("done_ms", "request_id", "purpose", F.col("body.frame").alias("body"))
    return good.groupBy("source", "url", "query").agg(F.max(pick).alias("r")).select("source", "url", "query", "r.done_ms", "r.purpose", "r.body")


def sealed_through(spark: SparkSession, root: str) -> int | None:
    """The time up to which the archive is complete; None if that cannot be read."""
    try:
        row = spark.read.text(f"{root}/sealed_through.json", wholetext=True).first()
        return int(json.loads(row.value)["sealed_through_ms"])
    except (AnalysisException, ValueError, KeyError, TypeError, AttributeError):  # absent or torn: nothing counts as sealed
        return None


def seal_watermark(open_ms: DataFrame, now_ms: int) -> int:
    """How far a set of segments is complete: the earliest time of any that is open, waiting to be sealed, or failed to be (a column at_ms); else now."""
    first = open_ms.agg(F.min("at_ms")).first()[0]
    return now_ms if first is None else min(first, now_ms)


def verify(spark: SparkSession, root: str, source: str) -> DataFrame:
    """What is wrong with a source's archive: relpath, problem. Files and journal are held against each other, and each listed file against its entry."""
    segs = segments(spark, root, source)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,part}").load(f"{root}/{source}/*").withColumn("relpath", F.array_join(F.slice(F.split("path", "/"), -3, 3), "/"))
    twice = segs.groupBy("relpath").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("relpath", F.lit("listed twice").alias("problem"))
    missing = segs.join(files.select("relpath"), "relpath", "left_anti").select("relpath", F.lit("listed, but missing").alias("problem"))
    loose = files.select("relpath").join(segs, "relpath", "left_anti").select("relpath", F.when(F.col("relpath").endswith(".part"), "active, not sealed").otherwise("not in the journal").alias("problem"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                rel, size, sha, count, lo, hi = (batch.column(c)[k].as_py() for c in ("relpath", "bytes", "sha256", "frame_count", "first_recv_ts_ms", "last_recv_ts_ms"))
                content = batch.column("content")[k].as_buffer()
                if len(content) != size:
                    out.append((rel, "size differs"))
                if hashlib.sha256(content).hexdigest() != sha:
                    out.append((rel, "sha256 differs"))
                    continue
                try:
                    times = [t for _, t, *_ in decoded(rel, gzip.open(pa.BufferReader(content)), None)]
                except (ValueError, OSError, EOFError) as e:
                    out.append((rel, f"unreadable: {e}"))
                    continue
                if len(times) != count:
                    out.append((rel, "frame count differs"))
                if times and (min(times) != lo or max(times) != hi):
                    out.append((rel, "time bounds differ"))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.string()) for j in (0, 1)], ["relpath", "problem"])

    bad = files.join(segs.select("relpath", "bytes", "sha256", "frame_count", "first_recv_ts_ms", "last_recv_ts_ms").dropDuplicates(["relpath"]), "relpath")
    bad = bad.select("relpath", "content", "bytes", "sha256", "frame_count", "first_recv_ts_ms", "last_recv_ts_ms").mapInArrow(check, "relpath string, problem string")
    return twice.unionByName(missing).unionByName(loose).unionByName(bad)


def volume(segs: DataFrame) -> DataFrame:
    """Segments, bytes, frames and unclean closes of each source and day."""
    return segs.groupBy(F.substring_index("relpath", "/", 1).alias("source"), "day").agg(F.count(F.lit(1)).alias("segments"), F.sum("bytes").alias("bytes"), F.sum("frame_count").alias("frames"), F.count_if("unclean_close").alias("unclean"))


def admitted(windows: DataFrame, sealed_ms: int | None, ledger: DataFrame, key: list[str]) -> DataFrame:
    """Windows that may be loaded: they end strictly before the seal, and the ledger does not have them yet."""
    return windows.where(F.col("window_end_ms") < F.lit(-1 if sealed_ms is None else sealed_ms)).join(ledger.select(*key).distinct(), key, "left_anti")


def write_segment(root: str, source: str, day: str, name: str, rows: list[dict]) -> dict:
    """Write one sealed segment and journal it (for fixtures): rows have KEYS in order."""
    from pathlib import Path

    at = Path(root, source, day)
    at.mkdir(parents=True, exist_ok=True)
    raw = gzip.compress("".join(json.dumps({k: r[k] for k in KEYS}, separators=(",", ":")) + "\n" for r in rows).encode(), mtime=0)
    (at / name).write_bytes(raw)
    times = [r["recv_ts_ms"] for r in rows]
    entry = {"file": name, "stream_id": name.split(".")[0], "segment_id": name, "sha256": hashlib.sha256(raw).hexdigest(), "bytes": len(raw), "frame_count": len(rows), "first_recv_ts_ms": min(times), "last_recv_ts_ms": max(times), "sealed_ts_ms": max(times), "unclean_close": False}
    with (at / "manifest.jsonl").open("a") as out:
        out.write(json.dumps(entry) + "\n")
    return entry
