"""Packed extensions as tables: entries of archives, their manifests, and messages in the language that is there.

Archives are rows of (path, content), as Spark's own ``binaryFile`` format reads them. An archive that can't be read, is
damaged or would unpack to more than its bounds is one row with an error, and ends no job.
"""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

# Bounds of an archive, unpacked: bytes of an entry, of all.
MOST_ENTRY, MOST_TOTAL = 32 << 20, 128 << 20
#: Bytes of entries that a batch of rows holds, about.
BATCH_BYTES = 8 << 20

ENTRIES = "path string, name string, size long, body binary, error string"


class ArchiveError(ValueError):
    pass


def clean_name(name: str) -> str:
    """An entry's path within its archive, "" if it leads out of it."""
    path = posixpath.normpath(name.strip().lstrip("/"))
    return "" if path in (".", "..") or path.startswith("../") or "\\" in path or "\0" in path else path


def inner_zip(raw: bytes) -> bytes:
    """What follows the signatures of a packed extension (versions 2 and 3); other bytes as they are."""
    if raw[:4] != b"Cr24":
        return raw
    if len(raw) < 16:
        raise ArchiveError("header cut off")
    version, a, b = struct.unpack_from("<III", raw, 4)
    skip = 16 + a + b if version == 2 else 12 + a if version == 3 else -1
    if skip < 0:
        raise ArchiveError(f"unknown version {version}")
    if skip > len(raw):
        raise ArchiveError("header longer than the file")
    return raw[skip:]


def unpacked(raw: bytes, most_entry: int = MOST_ENTRY, most_total: int = MOST_TOTAL) -> Iterator[tuple[str, bytes]]:
    """(name, body) of an archive's files. Bounds hold for what entries declare and for what they turn out to be."""
    try:
        with zipfile.ZipFile(io.BytesIO(inner_zip(raw))) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
            if any(i.file_size > most_entry for i in infos):
                raise ArchiveError("an entry is too large")
            if sum(i.file_size for i in infos) > most_total:
                raise ArchiveError("the archive is too large")
            left = most_total
            for info in infos:
                name = clean_name(info.filename)
                if not name:
                    continue
                with z.open(info) as f:
                    body = f.read(min(most_entry, left) + 1)
                if len(body) > min(most_entry, left):
                    raise ArchiveError("an entry is larger than it says")
                left -= len(body)
                yield name, body
    except (zipfile.BadZipFile, EOFError, NotImplementedError, RuntimeError, OSError, struct.error) as e:
        raise ArchiveError(f"no archive: {e}") from e


def entries(files: DataFrame, most_entry: int = MOST_ENTRY, most_total: int = MOST_TOTAL) -> DataFrame:
    """(path, name, size, body, error): a row a file of each archive, or one row with the error of an archive that can't be read to its end (its files before that stay)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["path", "name", "size", "body", "error"])

        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    for name, body in unpacked(raw.as_py() or b"", most_entry, most_total):
                        rows.append((path, name, len(body), body, None))
                        held += len(body)
                        if held > BATCH_BYTES:
                            yield batch_of()
                            rows, held = [], 0
                except ArchiveError as e:
                    rows.append((path, None, None, None, str(e)))
        yield batch_of()

    return files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInArrow(each, ENTRIES)


_SCRIPT = "struct<matches:array<string>,exclude_matches:array<string>,include_globs:array<string>,exclude_globs:array<string>,js:array<string>,css:array<string>,run_at:string,all_frames:boolean>"
_MANIFEST = (
    "manifest_version int, name string, version string, description string, default_locale string, permissions array<string>, host_permissions array<string>, background struct<service_worker:string,page:string,scripts:array<string>,persistent:boolean>, "
    f"content_scripts array<{_SCRIPT}>, web_accessible_resources string, declarative_net_request struct<rule_resources:array<struct<id:string,enabled:boolean,path:string>>>, _corrupt string"
)


def manifests(found: DataFrame) -> DataFrame:
    """A row a manifest: its fields, content scripts as they apply (``run_at`` document_idle unless said), resources that pages may use, rule files that are on; ``error`` if it can't be read."""
    raw = found.where("name = 'manifest.json'").select("path", F.decode("body", "UTF-8").alias("raw"))
    m = raw.select("path", F.from_json("raw", _MANIFEST, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("m"))
    scripts = F.transform(F.coalesce("m.content_scripts", F.array().cast(f"array<{_SCRIPT}>")), lambda s: s.withField("run_at", F.when(s.run_at.isin("document_start", "document_end"), s.run_at).otherwise("document_idle")))
    # the older form lists names, the newer one groups of them with the pages that may use them
    old, new = F.from_json("m.web_accessible_resources", "array<string>"), F.from_json("m.web_accessible_resources", "array<struct<resources:array<string>,matches:array<string>>>")
    is_old = F.col("m.web_accessible_resources").rlike(r'^\s*\[\s*"')
    resources = F.when(is_old, F.array(F.struct(old.alias("resources"), F.array().cast("array<string>").alias("matches")))).otherwise(new)
    rules = F.filter(F.coalesce("m.declarative_net_request.rule_resources", F.array().cast("array<struct<id:string,enabled:boolean,path:string>>")), lambda r: F.coalesce(r.enabled, F.lit(True)))
    error = F.when(F.col("m").isNull() | F.col("m._corrupt").isNotNull(), "the manifest is no JSON object").when(F.coalesce("m.manifest_version", F.lit(0)) == 0, "the manifest has no version")
    return m.select(
        "path", F.col("m.manifest_version"), F.col("m.name").alias("name"), F.col("m.version").alias("version"), F.col("m.description").alias("description"), F.col("m.default_locale").alias("default_locale"), "m.permissions", "m.host_permissions",
        F.coalesce("m.background.service_worker", "m.background.page", F.get("m.background.scripts", 0)).alias("background"), scripts.alias("content_scripts"), resources.alias("web_accessible"), rules.alias("rule_files"), error.alias("error"),
    )


def messages(found: DataFrame, told: DataFrame, last: str = "en") -> DataFrame:
    """(path, locale, key, message, placeholders) of each archive in one language: its manifest's default, else ``last``.

    The chain is a join of an archive's message files with its two languages by rank, and the first that holds any
    message. Keys and names of placeholders are in lower case.
    """
    files = found.select("path", F.regexp_extract("name", r"^_locales/([^/]+)/messages\.json$", 1).alias("locale"), F.decode("body", "UTF-8").alias("raw")).where("locale <> ''")
    wanted = told.select("path", F.posexplode(F.array("default_locale", F.lit(last))).alias("rank", "locale")).where("locale IS NOT NULL")
    kind = "map<string,struct<message:string,placeholders:map<string,struct<content:string>>>>"
    held = files.join(wanted, ["path", "locale"]).select("path", "locale", "rank", F.from_json("raw", kind).alias("m")).where("size(m) > 0")
    first = held.withColumn("_best", F.min("rank").over(Window.partitionBy("path"))).where("rank = _best")
    rows = first.select("path", "locale", F.explode("m").alias("key", "v"))
    names = F.map_from_entries(F.transform(F.map_entries(F.coalesce("v.placeholders", F.create_map().cast("map<string,struct<content:string>>"))), lambda e: F.struct(F.lower(e.key), e.value.content)))
    return rows.select("path", "locale", F.lower("key").alias("key"), F.coalesce("v.message", F.lit("")).alias("message"), names.alias("placeholders"))


_PART = re.compile(r"\$(?:(\$)|([1-9])|([^$]*)\$)")


def expand(message: str, placeholders: dict[str, str] | None = None, given: list[str] | None = None) -> str:
    """``$$`` is a dollar sign, ``$1`` to ``$9`` are what is given, ``$name$`` is a placeholder's content, expanded itself; a name that isn't known stays."""
    held, given = placeholders or {}, given or []
    out, at = [], 0
    while (m := _PART.search(message, at)) is not None:
        out.append(message[at : m.start()])
        at = m.end()
        if m[1]:
            out.append("$")
        elif m[2]:
            out.append(given[int(m[2]) - 1] if int(m[2]) <= len(given) else "")
        elif m[3].lower() in held:
            out.append(expand(held[m[3].lower()], None, given))
        else:
            out.append("$")
            at = m.start() + 1
    return "".join(out) + message[at:]


def expanded(rows: DataFrame, given: Column | None = None) -> DataFrame:
    """Messages with ``text``: tokens replaced by placeholders and by what is given (an array of texts)."""

    @pandas_udf("string")
    def each(message: pd.Series, placeholders: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([expand(m or "", dict(p) if p is not None else None, list(v) if v is not None else None) for m, p, v in zip(message, placeholders, values, strict=True)])

    return rows.withColumn("text", each("message", "placeholders", given if given is not None else F.array().cast("array<string>")))


def translated(rows: DataFrame, column: str, told: DataFrame) -> DataFrame:
    """Rows (with ``path``) whose texts name messages (``__MSG_key__``): each is replaced by its archive's, or by nothing if there is none.

    Texts are cut at their names, and the parts joined with the messages by archive and key.
    """
    whole_row = rows.select(F.struct(*rows.columns).alias("_row"), F.col("path"), F.monotonically_increasing_id().alias("_id"))
    cut = whole_row.select("_row", "_id", "path", F.posexplode(F.split(F.regexp_replace(F.coalesce(F.col(f"_row.{column}"), F.lit("")), r"__MSG_(.*?)__", "\u0001m$1\u0001"), "\u0001")).alias("at", "part"))
    named = cut.withColumn("key", F.when(F.col("at") % 2 == 1, F.lower(F.substring("part", 2, 1 << 30))))
    known = expanded(told).select("path", "key", "text")
    parts = named.join(known, ["path", "key"], "left").select("_row", "_id", F.struct("at", F.when(F.col("key").isNull(), F.col("part")).otherwise(F.coalesce("text", F.lit(""))).alias("x")).alias("s"))
    whole = parts.groupBy("_id").agg(F.first("_row").alias("_row"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s.x), "").alias("_text"))
    return whole.select(*[F.col("_text").alias(c) if c == column else F.col(f"_row.{c}").alias(c) for c in rows.columns])
