"""Documents as rows: pages joined in order, parents with children, counts, markdown tables, hyperlinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions import text as tx
from chunkloom.schema import DEFAULT_PROVIDER, derived_id


def joined_in_order(df: DataFrame, keys: list[str], position: str, text: str, separator: str = "\n\n") -> DataFrame:
    """keys, n rows and the texts of each group joined by position; null texts count as empty.

    Ordering happens within the collected group, as rows arrive from a shuffle in any order.
    """
    pairs = F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(pairs, lambda x: x["t"]), separator).alias("text"))


def with_children(parents: DataFrame, children: DataFrame, key: str, position: str) -> DataFrame:
    """parents with an array column children of struct(page_content, vector, metadata), ordered by position; none is an empty array."""
    pairs = F.collect_list(F.struct(F.col(position).alias("p"), "page_content", "vector", "metadata"))
    ordered = F.array_sort(pairs, lambda a, b: F.when(a["p"] < b["p"], -1).when(a["p"] > b["p"], 1).otherwise(0))  # maps have no order of their own
    parts = F.transform(ordered, lambda x: F.struct(x["page_content"].alias("page_content"), x["vector"].alias("vector"), x["metadata"].alias("metadata")))
    grouped = children.groupBy(key).agg(parts.alias("children"))
    return parents.join(grouped, key, "left").withColumn("children", F.coalesce("children", F.array().cast("array<struct<page_content: string, vector: array<float>, metadata: map<string, string>>>")))


def flattened(parents: DataFrame, key: str) -> DataFrame:
    """One row a child: key, child_idx from 0, page_content, vector, metadata."""
    return parents.select(key, F.posexplode("children").alias("child_idx", "c")).select(key, F.col("child_idx").cast("long").alias("child_idx"), "c.*")


def library_documents(documents: DataFrame) -> DataFrame:
    """The projection that splitters take: text and metadata; ids, vectors and children are left behind."""
    return documents.select(F.col("page_content").alias("text"), "metadata")


def as_pages(df: DataFrame, source: Column, page: Column, text: Column, provider: str = DEFAULT_PROVIDER) -> DataFrame:
    """Document rows with page metadata (pages count from 0) and derived ids."""
    return df.select(derived_id(source, page).alias("id_"), text.alias("page_content"), F.struct(source.alias("source"), page.cast("int").alias("page")).alias("metadata"), F.lit(provider).alias("provider"))


def upload_summary(pages: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Per file: pages and chunks processed, which an upload reports."""
    counted = pages.groupBy(key).agg(F.count(F.lit(1)).alias("pages_processed"))
    return counted.join(chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunks_processed")), key, "left").withColumn("chunks_processed", F.coalesce("chunks_processed", F.lit(0).cast("long")))


def cell_text(paragraphs: Column) -> Column:
    """A table cell: its non-empty paragraphs, the first of equal ones, joined by a space."""
    return F.array_join(F.array_distinct(F.filter(F.transform(paragraphs, tx.strip), lambda p: F.length(p) > 0)), " ")


def column_count(rows: Column) -> Column:
    """The most cells of any row; null of no rows."""
    return F.array_max(F.transform(rows, F.size))


def padded(row: Column, columns: Column) -> Column:
    """A row's cells cut or filled up with empty ones to a number of columns."""
    return F.slice(F.concat(row, F.array_repeat(F.lit(""), columns)), F.lit(1), columns)


def table_markdown(rows: Column) -> Column:
    """Rows of cells as a markdown table whose first row is the head; pipes are not escaped; null of no rows."""
    width = column_count(rows)

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    lines = F.transform(rows, lambda r: line(padded(r, width)))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(line(F.array_repeat(F.lit("---"), width))), F.slice(lines, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))), "\n"))


def hyperlinks(runs: DataFrame, keys: list[str], position: str, text: str = "text", url: str = "url") -> DataFrame:
    """runs with rendered: a run's text, as a markdown link where the run before it that had text, or an empty
    one since, gave a URL.

    A URL waits until the next run with text, which uses it up. keys name the paragraph; name the
    document instead to let URLs carry over paragraphs. State is a window's last value, not a loop.
    """
    order = Window.partitionBy(*keys).orderBy(position)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = F.length(F.coalesce(F.col(text), F.lit(""))) > 0
    counted = runs.withColumn("_upto", F.sum(filled.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    waiting = F.last(F.when(F.col(url).isNotNull(), F.struct(F.col("_upto").alias("n"), F.col(url).alias("url"))), ignorenulls=True).over(before)
    carried = counted.withColumn("_waiting", waiting).withColumn("_before", F.col("_upto") - filled.cast("int"))
    rendered = F.when(filled & (F.col("_waiting.n") == F.col("_before")), tx.markdown_link(F.col(text), F.col("_waiting.url"))).otherwise(F.col(text))
    return carried.withColumn("rendered", rendered).drop("_upto", "_waiting", "_before")


def image_links(runs: DataFrame, relations: DataFrame, keys: list[str]) -> DataFrame:
    """runs with link, the target of their relation id within keys; runs without a known relation keep null."""
    targets = relations.select(*keys, F.col("rel_id"), F.col("target").alias("link")).dropDuplicates([*keys, "rel_id"])
    return runs.join(targets, [*keys, "rel_id"], "left")
