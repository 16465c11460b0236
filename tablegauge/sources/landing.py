"""Landing and processed-table sinks, with file manifests."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

CHUNK = 4 << 20
#: Bytes that a task copies or digests, unless one file has more.
TASK_BYTES = 1 << 30
#: Folder of the manifest, mark of a landing that has begun, and what files that are still being written are called.
MANIFEST, STARTED, ASIDE = "_manifest", "_started", "_aside-"


def listed_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, size_bytes) of every file under a path, from the file listing alone."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", F.col("length").alias("size_bytes"))


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    scheme, _, rest = uri.partition(":")
    # the file reader writes "file:/path" where a URI has "file:///path"
    return fs.FileSystem.from_uri(f"file:///{rest.lstrip('/')}" if scheme == "file" else uri if "://" in uri else f"file://{uri}")


def _walk(files: DataFrame, destination: str | None) -> DataFrame:
    """Stream the bytes of each file through an executor, in chunks: digest them, and copy them where there is a destination."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, places = [], []
            for path in batch.column("path").to_pylist():
                digest, (system, name) = hashlib.sha256(), _open(path)
                place, out = path, None
                if destination:
                    place = f"{destination.rstrip('/')}/{name.rsplit('/', 1)[-1]}"
                    target, final = _open(place)
                    # written aside and renamed when it is whole: another attempt at the task never meets half a file
                    copy = f"{final.rpartition('/')[0]}/{ASIDE}{uuid.uuid4().hex}"
                    out = target.open_output_stream(copy, compression=None)
                with system.open_input_stream(name, compression=None) as source:
                    while chunk := source.read(CHUNK):
                        digest.update(chunk)
                        if out is not None:
                            out.write(chunk)
                if out is not None:
                    out.close()
                    target.move(copy, final)
                digests.append(digest.hexdigest())
                places.append(place)
            yield pa.RecordBatch.from_arrays(
                [pa.array(places, pa.string()), batch.column("size_bytes"), pa.array(digests, pa.string())], names=["path", "size_bytes", "sha256"])

    # a file is read by one task; tasks follow from the bytes, so that their share does not grow with the folder
    size = files.agg(F.sum("size_bytes")).first()[0] or 0
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return files.repartition(tasks, "path").mapInArrow(
        run, "path string, size_bytes bigint, sha256 string")


def file_manifest(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, size_bytes, sha256) of every file under a path; SHA-256 of the bytes, whatever the size."""
    return _walk(listed_files(spark, path, pattern), None).withColumn("path", F.regexp_replace("path", ":/+", ":/"))


def land_raw(spark: SparkSession, source: str, destination: str) -> DataFrame:
    """Immutable byte-for-byte copy of the files under ``source`` and its manifest (path, size_bytes, sha256).

    Files keep their names; two source files of one name are refused. The digest is taken from the bytes that were copied.
    The manifest is written last, under ``_manifest``: a destination that has one is refused, one without it was left by a
    run that broke off and is landed again, file by file."""
    target, folder = _open(destination.rstrip("/"))
    there = {i.base_name for i in target.get_file_info(fs.FileSelector(folder, allow_not_found=True))}
    done = target.get_file_info(f"{folder}/{MANIFEST}/_SUCCESS").type != fs.FileType.NotFound
    if done or (there and STARTED not in there):
        raise FileExistsError(f"{destination!r} exists; landed data is not changed")
    files = listed_files(spark, source)
    name = F.element_at(F.split("path", "/"), -1)
    if not files.groupBy(name.alias("name")).count().where("count > 1").isEmpty():
        raise ValueError(f"files of one name under {source!r}")
    target.create_dir(folder, recursive=True)
    with target.open_output_stream(f"{folder}/{STARTED}") as marker:
        marker.write(b"")
    _walk(files, destination).write.mode("overwrite").parquet(f"{destination.rstrip('/')}/{MANIFEST}")
    for found in target.get_file_info(fs.FileSelector(folder)):
        if found.base_name.startswith(ASIDE):  # of attempts that broke off
            target.delete_file(found.path)
    return read_manifest(spark, destination)


def read_manifest(spark: SparkSession, destination: str) -> DataFrame:
    """(path, size_bytes, sha256) of landed files."""
    return spark.read.schema("path string, size_bytes bigint, sha256 string").parquet(f"{destination.rstrip('/')}/{MANIFEST}")


def save_processed(df: DataFrame, root: str, dataset_id: str, execution_id: str) -> dict:
    """Write under ``exec-<id>`` once; rows are counted by the same job that writes them."""
    target = f"{root}/{dataset_id}/exec-{execution_id}"
    seen = Observation("written")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("error").parquet(target)
    files = file_manifest(df.sparkSession, target, "part-*").agg(
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size"),
        F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("sha256"))), 256).alias("sha256"),
    ).first()
    return dict(
        path=target, row_count=seen.get["rows"], column_count=len(df.columns), size_bytes=files["size"],
        sha256=files["sha256"],
    )
