"""Data sources over stored fetch logs and search answers, for ``spark.read.format``.

``fetchlog``: a folder of Parquet files of (url, status, content_type, fetched_at, body), dealt into folders ``bucket=k`` by
the host's CRC-32. A partition is a file. Filters on host, status, content type and time are pushed: a host prunes the folders
that can't hold it, and all of them are applied by the Parquet reader before a batch leaves it.

``searchanswers``: a folder of JSON lines (query, body) of a search service; rows are its results in order. A partition is a file; filters on the query are pushed.

Paths are URIs of any store that Arrow's file systems open; workers read through these, never by local paths of the driver.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from webloom.functions.urls import host
from webloom.sources.content import search_results

BUCKETS = 64
LOG = "url string, host string, status int, content_type string, fetched_at timestamp, body binary"
ANSWERS = "query string, place int, title string, url string, snippet string"


@dataclass
class FilePart(InputPartition):
    path: str


def _micros(at: datetime) -> int:
    """Microseconds since 1970, as a log stores its times."""
    return ((at if at.tzinfo else at.replace(tzinfo=timezone.utc)) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def _files(uri: str, suffix: str) -> list[str]:
    """Paths of a folder's files, as the file system names them."""
    fs, path = _opened(uri)
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=False))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and f.base_name.endswith(suffix) and not f.base_name.startswith(("_", ".")))


class _Reader(DataSourceReader):
    """What both sources share: the folder, and filters that were taken."""

    columns: frozenset[str] = frozenset()
    kinds: tuple = (EqualTo, In)

    def __init__(self, options: dict) -> None:
        self.uri = options["path"]
        self.taken: list = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, self.kinds) and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                self.taken.append(f)
            else:
                yield f

    def expression(self) -> ds.Expression | None:
        out = None
        for f in self.taken:
            name = f.attribute[0]
            column, stored = ds.field("fetched_us" if name == "fetched_at" else name), _micros if name == "fetched_at" else lambda x: x
            if isinstance(f, In):
                one = column.isin([stored(x) for x in f.value])
            else:
                value = stored(f.value)
                one = (
                    column == value if isinstance(f, EqualTo) else column < value if isinstance(f, LessThan) else column <= value if isinstance(f, LessThanOrEqual)
                    else column > value if isinstance(f, GreaterThan) else column >= value
                )
            out = one if out is None else out & one
        return out

    def values(self, name: str) -> set | None:
        """The values that a column can have by the filters, None: any."""
        out: set | None = None
        for f in self.taken:
            if f.attribute == (name,) and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                out = own if out is None else out & own
        return out


class FetchLogReader(_Reader):
    columns = frozenset(("host", "status", "content_type", "fetched_at"))
    kinds = (EqualTo, In, LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)

    def partitions(self) -> list[FilePart]:
        hosts = self.values("host")
        folders = None if hosts is None else {f"bucket={zlib.crc32(h.encode()) % BUCKETS}" for h in hosts}
        return [FilePart(p) for p in _files(self.uri, ".parquet") if folders is None or folders & set(p.split("/"))] or [FilePart("")]

    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = _opened(self.uri)
        names = ["url", "host", "status", "content_type", "fetched_us", "body"]
        for batch in ds.dataset(part.path, filesystem=fs, format="parquet").to_batches(columns=names, filter=self.expression(), batch_size=1024):
            if batch.num_rows:
                columns = [c.cast(pa.timestamp("us", "UTC")) if n == "fetched_us" else c for n, c in zip(names, batch.columns, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[n.replace("fetched_us", "fetched_at") for n in names])


class FetchLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fetchlog"

    def schema(self) -> str:
        return LOG

    def reader(self, schema) -> FetchLogReader:
        return FetchLogReader(self.options)


class SearchAnswersReader(_Reader):
    columns = frozenset(("query",))

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.count = int(options.get("count", 10))

    def partitions(self) -> list[FilePart]:
        return [FilePart(p) for p in _files(self.uri, ".json")] or [FilePart("")]

    def read(self, part: FilePart) -> Iterator[tuple]:
        if not part.path:
            return
        fs, _ = _opened(self.uri)
        wanted = self.values("query")
        with fs.open_input_stream(part.path) as raw:
            for line in _lines(raw):
                row = json.loads(line)
                if wanted is None or row.get("query") in wanted:
                    try:
                        found = search_results(row.get("body") or "", self.count)
                    except ValueError:
                        found = []  # an answer that can't be read holds nothing
                    for place, x in enumerate(found):
                        yield (row.get("query"), place, x.get("title"), x.get("url"), x.get("snippet"))


def _lines(raw, size: int = 1 << 20) -> Iterator[bytes]:
    held = b""
    while chunk := raw.read(size):
        *whole, held = (held + chunk).split(b"\n")
        yield from filter(None, whole)
    if held.strip():
        yield held


class SearchAnswers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "searchanswers"

    def schema(self) -> str:
        return ANSWERS

    def reader(self, schema) -> SearchAnswersReader:
        return SearchAnswersReader(self.options)


def registered(spark: SparkSession) -> SparkSession:
    """The session with both formats, and with filters pushed into them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FetchLog)
    spark.dataSource.register(SearchAnswers)
    return spark


def write_log(fetched: DataFrame, path: str) -> None:
    """Store fetched pages (url, status, content_type, fetched_at, body) as a fetch log. Files are dealt by host and a part of the URL's hash, so that no host is one task's work."""
    rows = fetched.select("url", host(F.col("url")).alias("host"), F.col("status").cast("int").alias("status"), "content_type", F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("fetched_us"), F.col("body").cast("binary").alias("body"))
    bucket = (F.crc32(F.col("host").cast("binary")) % BUCKETS).cast("int")
    rows.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("url"), F.lit(8))).write.partitionBy("bucket").parquet(path)
