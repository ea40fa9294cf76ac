"""Source files from directories and ZIP archives."""

from __future__ import annotations

import base64
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.errors import SourceError
from corvane.functions.paths import LANGUAGES, SCANNED, is_excluded, language

MAX_BYTES, MAX_FILES = 512 << 10, 5000


def _decoded(rows: DataFrame) -> DataFrame:
    """Drop binaries, decode with U+FFFD for bad bytes, count lines."""
    text = F.make_valid_utf8(F.col("bytes").cast("string"))
    rows = rows.filter(F.position(F.unhex(F.lit("00")), F.col("bytes")) == 0)
    rows = rows.withColumn("content", text)
    return rows.select("repo_id", "file_path", "language", F.col("size_bytes"), (F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1).cast("int").alias("line_count"), "content")


def directory(spark: SparkSession, path: str, repo_id: str = "repo", max_bytes: int = MAX_BYTES, max_files: int = MAX_FILES, languages: list[str] | None = None) -> DataFrame:
    """source_file rows of a folder, sorted by path, at most max_files; none is an error.

    Path, suffix and size are tested before any content is read.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    allowed = languages or SCANNED
    suffixes = [s for s, name in LANGUAGES.items() if name in allowed]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    relative = F.substring(F.col("path"), len(root) + 2, 1 << 20)
    rows = files.filter(F.col("length") <= max_bytes).withColumn("file_path", relative).withColumn("language", language(F.col("file_path")))
    rows = rows.filter(F.lower(F.regexp_extract("file_path", "[.]([^./]*)$", 1)).isin(suffixes) & ~is_excluded(F.col("file_path")))
    rows = rows.orderBy("file_path").limit(max_files).select(F.lit(repo_id).alias("repo_id"), "file_path", "language", F.col("length").alias("size_bytes"), F.col("content").alias("bytes"))
    out = _decoded(rows)
    if out.isEmpty():
        raise SourceError(f"no source file under {path}")
    return out


def unzip(archives: DataFrame, blob: str = "zip_b64", max_bytes: int = MAX_BYTES, max_files: int = MAX_FILES) -> DataFrame:
    """source_file rows of archives(repo_id, base64 ZIP): all known suffixes, unsafe paths and large members left out.

    If all members of an archive share their first folder, it is dropped. A broken archive gives no rows.
    """
    suffixes = set(LANGUAGES)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo, blob64 in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(base64.b64decode(blob64 or "")))
                except (ValueError, zipfile.BadZipFile):
                    continue
                heads = {name.split("/")[0] for name in archive.namelist()}
                prefix = f"{next(iter(heads))}/" if len(heads) == 1 and any("/" in n for n in archive.namelist()) else ""
                rows = []
                for info in sorted(archive.infolist(), key=lambda x: x.filename):
                    name = info.filename.replace("\\", "/").removeprefix(prefix)
                    unsafe = name.startswith("/") or ".." in name.split("/")
                    if info.is_dir() or unsafe or info.file_size > max_bytes or name.rpartition(".")[2].lower() not in suffixes or "." not in name:
                        continue
                    data = archive.read(info)
                    if b"\0" not in data and len(rows) < max_files:
                        rows.append((repo, name, len(data), data))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (batch.column(0).type, pa.string(), pa.int64(), pa.binary()), strict=True)], ["repo_id", "file_path", "size_bytes", "bytes"])

    kind = archives.schema["repo_id"].dataType.simpleString()
    found = archives.select("repo_id", blob).mapInArrow(members, f"repo_id {kind}, file_path string, size_bytes long, bytes binary")
    return _decoded(found.withColumn("language", language(F.col("file_path"))))


def strip_common_root(files: DataFrame) -> DataFrame:
    """Drop the first folder of all paths of a repository if they share it."""
    head, w = F.split("file_path", "/")[0], Window.partitionBy("repo_id")
    same = (F.min(head).over(w) == F.max(head).over(w)) & (F.min(F.size(F.split("file_path", "/"))).over(w) > 1)
    return files.withColumn("_same", same).withColumn("file_path", F.when(F.col("_same"), F.regexp_replace("file_path", "^[^/]+/", "")).otherwise(F.col("file_path"))).drop("_same")


def load_repository(spark: SparkSession, path: str | None = None, zip_b64: str | None = None, repo_id: str = "repo") -> DataFrame:
    """source_file rows, by path, of exactly one source: a folder (a clone, say) or a base64 ZIP archive."""
    if bool(path) == bool(zip_b64):
        raise SourceError("give a path or an archive, and not both" if path else "give a path or an archive")
    if path:
        return directory(spark, path, repo_id)
    out = unzip(spark.createDataFrame([(repo_id, zip_b64)], "repo_id string, zip_b64 string"))
    if out.isEmpty():
        raise SourceError("no source file in the archive")
    return out.orderBy("file_path")
