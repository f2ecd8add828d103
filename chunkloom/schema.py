"""Row types and closed string domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())
METADATA = T.MapType(T.StringType(), T.StringType())
CHILD = T.StructType([T.StructField("page_content", T.StringType(), False), T.StructField("vector", VECTOR), T.StructField("metadata", METADATA)])
ATTACHMENT = T.StructType([T.StructField("page_content", T.StringType(), False), T.StructField("provider", T.StringType()), T.StructField("vector", VECTOR), T.StructField("metadata", METADATA)])
DOCUMENT = T.StructType([
    T.StructField("page_content", T.StringType(), False), T.StructField("id_", T.StringType()), T.StructField("vector", VECTOR), T.StructField("metadata", METADATA),
    T.StructField("provider", T.StringType()), T.StructField("children", T.ArrayType(CHILD)), T.StructField("attachments", T.ArrayType(ATTACHMENT)),
])
PAGE = T.StructType([T.StructField("page_content", T.StringType(), False), T.StructField("metadata", T.StructType([T.StructField("source", T.StringType()), T.StructField("page", T.IntegerType())]))])
UPLOAD_FILE = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("tenant_id", T.StringType(), False), T.StructField("storage_type", T.StringType(), False), T.StructField("key", T.StringType(), False),
    T.StructField("name", T.StringType(), False), T.StructField("size", T.LongType(), False), T.StructField("extension", T.StringType(), False), T.StructField("mime_type", T.StringType()),
    T.StructField("created_by_role", T.StringType(), False), T.StructField("created_by", T.StringType(), False), T.StructField("created_at", T.TimestampNTZType(), False), T.StructField("used", T.BooleanType(), False),
    T.StructField("used_by", T.StringType()), T.StructField("used_at", T.TimestampNTZType()), T.StructField("hash", T.StringType()), T.StructField("source_url", T.StringType()),
])
DEFAULT_PROVIDER = "dify"

#: The closed string domains.
DOMAINS: dict[str, tuple[str, ...]] = {
    "creator_user_role": ("account", "end_user"),
    "user_from": ("account", "end-user"),
    "workflow_run_triggered_from": ("debugging", "app-run", "rag-pipeline-run", "rag-pipeline-debugging", "webhook", "schedule", "plugin"),
    "draft_variable_type": ("node", "sys", "conversation"),
    "message_status": ("normal", "error"),
    "execution_offload_type": ("inputs", "process_data", "outputs"),
    "workflow_trigger_status": ("pending", "queued", "running", "succeeded", "paused", "failed", "rate_limited", "retrying"),
    "app_trigger_status": ("enabled", "disabled", "unauthorized", "rate_limited"),
}


def in_domain(value: Column, domain: str) -> Column:
    """Whether a value is in a domain; null is not known to be."""
    return value.isin(*DOMAINS[domain])


def checked(value: Column, domain: str) -> Column:
    """The value, or an error at run time if it is outside the domain; null passes."""
    return F.when(value.isNull() | in_domain(value, domain), value).otherwise(F.raise_error(F.concat(F.lit(f"not in {domain}: "), value)))


def enum_length(domain: str, length: int | None = None) -> int:
    """Column width of an enumeration: the longest value, 20 at least, unless a sufficient one is given."""
    longest = max(map(len, DOMAINS[domain]))
    if length is not None and length < longest:
        raise ValueError(f"length {length} is too short for {domain}")
    return length if length is not None else max(longest, 20)


def same(a: Column, b: Column) -> Column:
    """Equality in which null only equals null."""
    return a.eqNullSafe(b)


def string_uuid(value: Column) -> Column:
    """The lower-case canonical form of a UUID with or without hyphens; null if it is none."""
    digits = F.lower(F.regexp_replace(value, "-", ""))
    parts = [F.substring(digits, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(digits.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts))


def derived_id(*parts: Column) -> Column:
    """A stable identifier in place of a random one: SHA-256 over the parts."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)
