"""Gates before extraction, upload records, the page cache, and storage semantics over listings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.config import Settings
from chunkloom.functions import text as tx
from chunkloom.schema import checked, derived_id

ACCEPTED = (".pdf", ".docx", ".doc")
#: Formats that can be extracted; legacy .doc is accepted at the gate and reported as unsupported.
SUPPORTED = (".pdf", ".docx")
MAX_BYTES = Settings().max_upload_size


def gated(files: DataFrame, max_bytes: int = MAX_BYTES, accepted: tuple[str, ...] = ACCEPTED) -> DataFrame:
    """files (path, length, ...) with extension, mime_type and error: null, or why a file is turned away.

    Nothing is dropped: callers keep error IS NULL and quarantine the rest. A filter on length alone
    reaches the binaryFile scan, see sources.blobs.
    """
    name = F.regexp_extract("path", "[^/]*$", 0)
    extension = tx.suffix(F.col("path"))
    error = F.when(F.length(name) == 0, "no file name").when(~extension.isin(*accepted), F.concat(F.lit("unsupported type "), extension)).when(F.col("length") > max_bytes, "too large")
    return files.withColumns({"extension": extension, "mime_type": tx.mime_type(F.col("path")), "error": error})


def quarantined(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files to go on with, and those turned away."""
    return files.where("error IS NULL"), files.where("error IS NOT NULL")


def upload_key(tenant_id: Column, content: Column, path: Column) -> Column:
    """Where an upload is kept: by tenant and content, with the path's extension."""
    return F.concat(F.lit("upload_files/"), tenant_id.cast("string"), F.lit("/"), F.sha2(content, 256), tx.suffix(path))


def upload_records(files: DataFrame, tenant_id: Column, created_by: Column, created_at: Column, storage_type: str = "local", role: str = "account", source_url: Column | None = None) -> DataFrame:
    """Upload records of files (path, length, content). Keys and ids derive from content, so uploads cannot
    overwrite each other and reruns give the same records."""
    digest = F.sha2("content", 256)
    name = F.regexp_extract("path", "[^/]*$", 0)
    extension = tx.suffix(F.col("path"))
    return files.select(
        derived_id(tenant_id, digest, name).alias("id"), tenant_id.cast("string").alias("tenant_id"), F.lit(storage_type).alias("storage_type"),
        upload_key(tenant_id, F.col("content"), F.col("path")).alias("key"), name.alias("name"), F.col("length").cast("long").alias("size"), F.ltrim(extension, F.lit(".")).alias("extension"),
        tx.mime_type(F.col("path")).alias("mime_type"), checked(F.lit(role), "creator_user_role").alias("created_by_role"), created_by.cast("string").alias("created_by"), created_at.cast("timestamp_ntz").alias("created_at"),
        F.lit(False).alias("used"), F.lit(None).cast("string").alias("used_by"), F.lit(None).cast("timestamp_ntz").alias("used_at"), digest.alias("hash"), (source_url if source_url is not None else F.lit("")).alias("source_url"),
    )


def landed(files: DataFrame, root: str) -> DataFrame:
    """Writes the content of files (key, content) below root, each in the task that holds it; key, uri and size of each.

    Lazy like any DataFrame: write or count the result. Keys derive from content, so a task that runs again
    writes the same bytes to the same place. Roots are paths or URIs that Arrow's file systems know
    (file, s3, gs, hdfs). A row without content is landed as an empty object; one without a key is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for batch in batches:
            keys, sizes = batch.column(0).to_pylist(), []
            for key, content in zip(keys, batch.column(1)):
                data = content.as_py() or b""
                path = f"{base.rstrip('/')}/{key}"
                system.create_dir(path.rpartition("/")[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([f"{root.rstrip('/')}/{k}" for k in keys], pa.string()), pa.array(sizes, pa.int64())], names=["key", "uri", "size"])

    return files.select("key", F.col("content").cast("binary").alias("content")).mapInArrow(run, "key string, uri string, size long")


def read_through(files: DataFrame, cache: DataFrame, extract, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(pages of all files, pages to add to the cache). cache and extract's result are pages with the key column.

    Hits come from the cache, misses are extracted; both are pages, so the shape never changes.
    """
    hits = cache.join(files.select(key).distinct(), key, "left_semi")
    fresh = extract(files.join(cache.select(key).distinct(), key, "left_anti"))
    return hits.select(*fresh.columns).unionByName(fresh), fresh


def existing(names: DataFrame, listing: DataFrame, key: str = "path") -> DataFrame:
    """names with exists, by the listing."""
    return names.join(listing.select(key, F.lit(True).alias("exists")).distinct(), key, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def without(listing: DataFrame, deletions: DataFrame, key: str = "path") -> DataFrame:
    """The listing after deletions; deleting what is not there changes nothing."""
    return listing.join(deletions.select(key).distinct(), key, "left_anti")


def scanned(listing: DataFrame, prefix: str, files: bool = True, directories: bool = False) -> DataFrame:
    """Paths under a prefix: files, the directories above them, or both; one of the two must be wanted.

    A prefix that holds nothing gives no rows; sources.storage.Storage.scan raises for a path that is not there.
    """
    if not files and not directories:
        raise ValueError("nothing to list: neither files nor directories")
    base = prefix.rstrip("/") + "/"
    under = listing.select("path").where(F.col("path").startswith(base))
    found = under.select("path", F.lit(False).alias("is_dir")) if files else None
    if directories:
        parts = F.split(F.substring(F.col("path"), F.lit(len(base) + 1), F.length("path")), "/")
        above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.lit(base), F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))
        dirs = under.select(F.explode(above).alias("path")).distinct().select("path", F.lit(True).alias("is_dir"))
        found = dirs if found is None else found.unionByName(dirs)
    return found.distinct()
