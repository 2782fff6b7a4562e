"""WARC archives with an external index merge.

Pages are written as WARC records, one gzip member each: a `response` for the smallest page_id of each
payload of REVISIT_BYTES or more (and for every smaller payload), a `revisit` for the others. Each task
sorts its captures by URL key and timestamp and writes an archive and a sorted run of index lines with
a sparse table of offsets. The runs are then merged: passes of FAN_IN runs a task while there are more
than FAN_IN of them, then one pass in which each task takes a range of keys, seeks to it in every run,
and merges with a loser tree. The result is the capture history in global order of (range, position), and the
archives are read back through it.

Only urls go through Python before the archives are written, and only ids and digests are shuffled to
find equal payloads (payloads themselves move where more of them repeat than a broadcast may hold).
Ids pass through Python as text or Arrow integers, so none is rounded.

Files go through pyarrow's file systems, to the folder the session shares, under names of their own for
each task attempt; only the names that a finished task returns are read, so lost executors leave at
worst unread files.

Defined cases: a null html is an empty payload; a null url has the empty URL key; rows with a null
page_id are responses; repeated page_ids keep one record each, and of repeated rows with the smallest
page_id all are responses; an empty input gives empty archives and an empty result. Further columns
are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .shared import materialise, scratch, small

REVISIT_BYTES = 100
#: Index lines between two entries of a run's sparse table; runs that one task merges; lines of history for each task.
SPARSE, FAN_IN, RANGE_LINES = 256, 64, 200_000
BUFFER = 1 << 18
#: Repeated payloads (a digest and an id each: 40 MB at most) that may be broadcast once counted.
MAX_REPEATED = 500_000
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
CAPTURE = "page_id long, urlkey string, ts string, digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"
_CONTROL = re.compile(r"[\x00-\x20]")
FIELDS = [c.split(" ")[0] for c in CAPTURE.split(", ")]


def url_key(url: str | None) -> str:
    """The host's labels in reverse, then path and query: pages of one site stand together."""
    try:
        parts = urlsplit((url or "").strip().lower())
        host = parts.hostname or ""
    except ValueError:
        return (url or "").strip().lower().replace(" ", "%20")
    labels = ",".join(reversed(host.removeprefix("www.").split(".")))
    return f"{labels}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "") if host else (url or "").strip().lower()


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _open_out(path: str):
    system, local = _file_system(path)
    system.create_dir(local.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(local, compression=None, buffer_size=BUFFER)


def _open_in(path: str):
    system, local = _file_system(path)
    return system.open_input_file(local)


def _member(kind: str, url: str, date: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member with one record."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}"]
    lines += [f"{k}: {v}" for k, v in headers]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def parse_member(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


class _RunWriter:
    """Sorted index lines of one run, and the offset of every SPARSE-th of them."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.cdxj"
        self.out, self.offset, self.lines, self.sparse = _open_out(self.path), 0, 0, []

    def write(self, line: bytes) -> None:
        if self.lines % SPARSE == 0:
            self.sparse.append((line_key(line), self.offset))
        self.out.write(line)
        self.offset += len(line)
        self.lines += 1

    def close(self) -> dict:
        self.out.close()
        return {"run": self.path, "lines": self.lines, "keys": [k for k, _ in self.sparse], "offsets": [o for _, o in self.sparse]}


RUN = "run string, lines long, keys array<string>, offsets array<long>"


def to_line(capture: dict) -> bytes:
    """`urlkey timestamp page_id json`, one capture a line. The id is padded so that text order is its order."""
    rest = {k: capture[k] for k in FIELDS if k not in ("urlkey", "ts")}
    shown = "" if capture["page_id"] is None else f"{capture['page_id'] + (1 << 63):020d}"
    return f"{capture['urlkey']}\t{capture['ts']}\t{shown}\t{json.dumps(rest)}\n".encode()


def line_key(line: bytes) -> str:
    return line.rpartition(b"\t")[0].decode()


def from_line(line: bytes) -> dict:
    urlkey, ts, _, rest = line.decode().rstrip("\n").split("\t", 3)
    return {"urlkey": urlkey, "ts": ts, **json.loads(rest)}


def _write(frames: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    """Archive and run of one task; its rows arrive sorted by (urlkey, ts, page_id)."""
    archive = f"{folder}/{uuid.uuid4().hex}.warc.gz"
    out, offset, run = None, 0, None
    for frame in frames:
        for row in frame.itertuples(index=False):
            if out is None:
                out, run = _open_out(archive), _RunWriter(folder)
            payload = (row.html or "").encode()
            at = EPOCH + timedelta(seconds=int(row.ts))
            page_id = None if row.page_id is None else int(row.page_id)  # ids arrive as text
            headers = [("WARC-Payload-Digest", f"sha256:{row.digest}"), ("X-Page-Id", str(page_id)), ("X-Payload-Length", str(len(payload)))]
            revisit = row.record_type == "revisit"
            refers_to = int(row.refers_to) if revisit else None
            if revisit:
                headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", str(refers_to))]
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
            url = "".join((row.url or "").split())
            member = _member(row.record_type, url, at.strftime("%Y-%m-%dT%H:%M:%SZ"), headers, block)
            out.write(member)
            run.write(to_line({"page_id": page_id, "urlkey": row.urlkey, "ts": at.strftime("%Y%m%d%H%M%S"), "digest": row.digest, "payload_bytes": len(payload), "record_type": row.record_type, "refers_to": refers_to, "file": archive, "offset": offset, "length": len(member)}))
            offset += len(member)
    if out is not None:
        out.close()
        yield pd.DataFrame([run.close()])


def _lines(path: str, start: int, low: str, high: str | None) -> Iterator[tuple[str, bytes]]:
    """(key, line) of a run from `start` on, with low <= key < high, through a bounded buffer."""
    with _open_in(path) as source:
        source.seek(start)
        rest = b""
        while True:
            block = source.read(BUFFER)
            if not block:
                return
            *lines, rest = (rest + block).split(b"\n")
            for line in lines:
                key = line_key(line)
                if high is not None and key >= high:
                    return
                if key >= low:
                    yield key, line + b"\n"


class LoserTree:
    """Merges k sorted iterators of (key, value): each inner node holds the loser of its match, the root the winner."""

    def __init__(self, sources: list[Iterator[tuple[str, bytes]]]):
        self.sources = sources
        self.k = len(sources)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        self.winner = self._build(1) if self.k > 1 else 0

    def _next(self, i: int) -> tuple | None:
        return next(self.sources[i], None)

    def _beats(self, a: int, b: int) -> bool:
        """Ties go to the run with the smaller number, so the merge is stable."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        left, right = self._build(2 * node), self._build(2 * node + 1)
        winner, loser = (left, right) if self._beats(left, right) else (right, left)
        self.losers[node] = loser
        return winner

    def __iter__(self) -> Iterator[tuple[str, bytes]]:
        while self.k and (head := self.heads[self.winner]) is not None:
            yield head
            champion = self.winner
            self.heads[champion] = self._next(champion)
            node = (champion + self.k) // 2
            while node >= 1:  # only the matches on the way to the root are played again
                if self._beats(self.losers[node], champion):
                    champion, self.losers[node] = self.losers[node], champion
                node //= 2
            self.winner = champion


def _merge_group(frames: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    """One run from the runs of each row's list."""
    for frame in frames:
        for paths in frame["paths"]:
            run = _RunWriter(folder)
            for _, line in LoserTree([_lines(p, 0, "", None) for p in paths]):
                run.write(line)
            yield pd.DataFrame([run.close()])


def _merge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The captures of each range of keys, in order, from all runs."""
    for batch in batches:
        for row in batch.to_pylist():
            sources = [_lines(path, at, row["low"], row["high"]) for path, at in zip(row["paths"], row["starts"], strict=True)]
            out = []
            for position, (_, line) in enumerate(LoserTree(sources)):
                out.append({"range": row["range"], "position": position, **from_line(line)})
                if len(out) == 5_000:
                    yield pa.RecordBatch.from_pylist(out, HISTORY)
                    out = []
            yield pa.RecordBatch.from_pylist(out, HISTORY)


def merge_runs(runs: DataFrame, folder: str, fan_in: int = FAN_IN, range_lines: int = RANGE_LINES) -> DataFrame:
    """The history (range, position, capture) in global order, from locally sorted runs."""
    if fan_in < 4:
        raise ValueError("fan_in: at least 4")
    spark = runs.sparkSession
    n = runs.count()
    while n > fan_in:
        # About 2 n / fan_in groups of half of fan_in each; those that chance makes larger are sliced. From 4 on, this always leaves fewer runs.
        numbered = runs.select("run", F.pmod(F.xxhash64("run"), F.lit(-(-n * 2 // fan_in))).alias("group"))
        groups = numbered.groupBy("group").agg(F.array_sort(F.collect_list("run")).alias("paths"))
        groups = groups.select(F.explode(F.expr(f"transform(sequence(0, CAST((size(paths) - 1) DIV {fan_in} AS INT)), i -> slice(paths, i * {fan_in} + 1, {fan_in}))")).alias("paths"))
        runs = materialise(groups.repartition(n // fan_in + 1).mapInPandas(lambda it: _merge_group(it, folder), RUN), "warc-runs")
        n = runs.count()
    # Every so many entries of all sparse tables, in order, start a range of range_lines lines or so.
    entries = runs.select("run", F.explode(F.arrays_zip("keys", "offsets")).alias("e")).select("run", F.col("e.keys").alias("key"), F.col("e.offsets").alias("offset"))
    parts = max(-(-entries.count() // max(range_lines // SPARSE, 1)), 1)
    dealt = materialise(entries.repartitionByRange(parts, "key").select("run", "key", "offset", F.spark_partition_id().alias("part")), "warc-entries")
    lows = [(r["part"], r["key"]) for r in dealt.groupBy("part").agg(F.min("key").alias("key")).orderBy("part").collect()]  # one row for each task of the merge
    bounds = [(i, part, "" if i == 0 else key, lows[i + 1][1] if i + 1 < len(lows) else None) for i, (part, key) in enumerate(lows)]
    ranges = spark.createDataFrame(bounds, "range int, part int, low string, high string")
    # At most fan_in runs meet each range. A run is read from its last entry before the range, which is the last of its earlier parts.
    names = F.array(*(F.lit(r["run"]) for r in runs.select("run").collect())).cast("array<string>")
    last = dealt.groupBy("run", "part").agg(F.max("offset").alias("offset")).withColumnsRenamed({"run": "__run", "part": "__part"})
    met = ranges.withColumn("run", F.explode(names))
    met = met.join(last, (F.col("run") == F.col("__run")) & (F.col("part") == F.col("__part")), "left")
    earlier = Window.partitionBy("run").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    started = met.select("range", "low", "high", "run", F.coalesce(F.max("offset").over(earlier), F.lit(0)).alias("start"))
    tasks = started.groupBy("range", "low", "high").agg(F.array_sort(F.collect_list(F.struct("run", "start"))).alias("runs"))
    tasks = tasks.select("range", "low", "high", F.col("runs.run").alias("paths"), F.col("runs.start").alias("starts"))
    return tasks.repartition(max(len(bounds), 1), "range").mapInArrow(_merge_range, f"range int, position long, {CAPTURE}")


def _read_back(batches: Iterator[pa.RecordBatch], sink: Callable = parse_member) -> Iterator[pa.RecordBatch]:
    """Records at the index's places; rows arrive sorted by file and offset, so each archive is read forwards once."""
    source, name = None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["file"] != name:
                if source is not None:
                    source.close()
                source, name = _open_in(row["file"]), row["file"]
            source.seek(row["offset"])
            headers, payload = sink(source.read(row["length"]))
            revisit = headers["WARC-Type"] == "revisit"
            page_id = headers["X-Page-Id"]
            out.append({
                "range": row["range"], "position": row["position"], "page_id": None if page_id == "None" else int(page_id), "url": headers["WARC-Target-URI"], "html": None if revisit else payload.decode(),
                "payload_bytes": int(headers["X-Payload-Length"]) if revisit else len(payload),
                "payload_digest": headers["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
                "record_type": headers["WARC-Type"], "refers_to": int(headers["X-Refers-To-Page-Id"]) if revisit else None,
            })
        yield pa.RecordBatch.from_pylist(out, RECORDS)
    if source is not None:
        source.close()


RECORD = "range int, position long, page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split(" ") for field in schema.split(", "))])


HISTORY, RECORDS = _arrow(f"range int, position long, {CAPTURE}"), _arrow(RECORD)


@F.pandas_udf(StringType())
def _url_keys(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url_key(u)))  # no key holds the separators of a line


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archives and sorted runs of the pages (page_id, url, html, and ts: seconds since EPOCH); the table of runs."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string"), "html", "ts")
    marked = rows.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    long_enough = F.coalesce(F.octet_length("html"), F.lit(0)) >= REVISIT_BYTES
    # One row for each repeated payload; one that a third of the pages share is folded before the shuffle.
    first = marked.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = small(materialise(first.select(F.col("digest").alias("__digest"), "first"), "warc-repeated"), MAX_REPEATED)
    # Shorter payloads look for nothing: a key of their own keeps a common one from being hot where the join shuffles.
    sought = F.when(long_enough, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    joined = marked.withColumn("__sought", sought).join(first, F.col("__sought") == F.col("__digest"), "left")
    revisit = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    typed = joined.select(
        F.col("page_id").cast("string").alias("page_id"), "url", "html", "ts", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).cast("string").alias("refers_to"), _url_keys("url").alias("urlkey"), F.col("page_id").alias("__order"),
    )
    ordered = typed.sortWithinPartitions("urlkey", "ts", "__order").drop("__order")
    return materialise(ordered.mapInPandas(lambda it: _write(it, folder), RUN), "warc-manifest")


def history(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write, merge: the capture history in order of (range, position)."""
    folder = folder or scratch(pages.sparkSession, "warc")
    return merge_runs(write_archives(pages, folder), folder)


def read_records(captures: DataFrame) -> DataFrame:
    """The records at the captures' places, payloads included."""
    ordered = captures.select("range", "position", "file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_read_back, RECORD)


def op7_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("ts", F.coalesce(F.col("page_id") % 86_400, F.lit(0)).cast("long"))
    captures = materialise(history(pages), "warc-history")
    return read_records(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest
"""
