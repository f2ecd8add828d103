"""Queries over the driver's tables, one for each operator or a few that belong together."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom import schema
from chunkloom.functions import text as tx
from chunkloom.functions import vectors as vx
from chunkloom.operators import chunk, documents, ingest, retrieve, store
from chunkloom.plans import round_trips
from chunkloom.plans.oracles import CJK_FROM, CJK_TO
from chunkloom.shared import shared_dir, written
from chunkloom.sources import blobs


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def sentences_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


def sentences_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(tx.sentences(F.col("text"), tx.SENTENCE_LATIN)).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", tx.token_count(text).cast("long").alias("n_tokens"), F.char_length(text).cast("long").alias("n_letters"), F.octet_length(text).cast("long").alias("n_bytes"), F.char_length(tx.strip(text)).cast("long").alias("n_stripped"))


def _tokens(size: int, overlap: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chunk.token_chunks(_docs(spark, sf_dir), size, overlap)

    return query


def _packed(size: int, overlap: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chunk.sentence_pack(_docs(spark, sf_dir), size, overlap)

    return query


def sentence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.sentence_window(_docs(spark, sf_dir))


def window_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = chunk.sentence_window(_docs(spark, sf_dir)).withColumn("window", F.when(F.col("chunk_idx") % 2 == 0, F.col("window")))
    return nodes.select("doc_id", "chunk_idx", retrieve.shown_text(F.col("text"), F.col("window")).alias("shown"), F.coalesce("window", F.lit("N/A")).alias("window_or_default"))


def _semantic(percentile: float):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chunk.semantic_split(_docs(spark, sf_dir), percentile)

    return query


def adjacent_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.adjacent_similarity(_docs(spark, sf_dir))


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.hybrid_split(_docs(spark, sf_dir))


def hybrid_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text without spaces, made of documents: vowels become Han characters, which are a token each, and stops their wide forms."""
    made = _docs(spark, sf_dir).withColumn("text", F.translate("text", CJK_FROM, CJK_TO))
    return chunk.hybrid_split(made, sentences=tx.SENTENCE_CJK, tokenizer=tx.WORD_CJK, separator="")


def overlap_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.overlap_preview(_docs(spark, sf_dir), 65, size=500)


def hybrid_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many semantic chunks stayed whole and how many were packed anew, with their sizes."""
    chunks = chunk.hybrid_split(_docs(spark, sf_dir))
    parents = chunks.groupBy("doc_id", "parent_idx").agg(F.count(F.lit(1)).alias("parts"), F.max("n_tokens").alias("largest"))
    return parents.groupBy((F.col("parts") > 1).alias("resplit")).agg(F.count(F.lit(1)).alias("parents"), F.sum("parts").alias("chunks"), F.max("largest").alias("largest"))


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents as pages and their token chunks, as an upload reports them."""
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return documents.upload_summary(docs, chunk.token_chunks(docs), "source")


def conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.joined_in_order(_table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")


def conversation_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("page_content"), F.lit(None).cast("array<float>").alias("vector"), F.create_map(F.lit("role"), F.col("role")).alias("metadata"))
    parents = turns.select("conv_id").distinct()
    return documents.flattened(documents.with_children(parents, turns, "conv_id", "turn"), "conv_id").select("conv_id", "child_idx", "page_content", F.col("metadata")["role"].alias("role"))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents.as_pages(_table(spark, sf_dir, "documents"), F.col("source"), F.col("doc_id"), F.col("text"))
    return pages.select("id_", "page_content", F.col("metadata.source").alias("source"), F.col("metadata.page").alias("page"), "provider")


def library_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("text").alias("page_content"), F.to_json(F.struct("source", F.col("doc_id").alias("page"))).alias("metadata"), F.lit("dify").alias("provider"))
    return documents.library_documents(docs)


def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    pair = e.join(other, "vec_id")
    return pair.select("vec_id", F.round(vx.dot(F.col("a"), F.col("b")), 6).alias("dot"), F.round(vx.norm(F.col("a")), 6).alias("norm"), F.round(vx.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


def similarity_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    sims = vector_functions(spark, sf_dir)
    return sims.agg(*(F.round(F.percentile("cosine", F.lit(q / 100)), 6).alias(f"p{q}") for q in (5, 50, 95)))


def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieve.top_k(queries, e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector")), 4)


def retrieval(spark: SparkSession, sf_dir: str, k: int = 4) -> DataFrame:
    """Hybrid chunks and their vectors, stored once, and the best chunks for each benchmark item, with their text."""
    chunks = chunk.hybrid_split(_docs(spark, sf_dir)).withColumn("row_id", F.concat_ws(":", F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lpad(F.col("chunk_idx").cast("string"), 6, "0")))
    stored = written(store.embedded(chunks), "chunks")
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), vx.encoded(F.col("text")).alias("vector"))
    hits = retrieve.top_k(queries, stored, k)
    return retrieve.with_nodes(hits, stored.select("row_id", "doc_id", "chunk_idx", "text")).select(F.col("query_id").alias("item_id"), "rank", "doc_id", "chunk_idx", "score", "text")


def url_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _table(spark, sf_dir, "pages").select("page_id", tx.valid_url(url).alias("valid"), tx.is_web(url).alias("web"), F.try_parse_url(url, F.lit("HOST")).alias("host"), tx.suffix(F.regexp_extract(url, "^[^?#]*", 0)).alias("extension"))


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of named files made of documents: some upper-case names, several types, and sizes up to 20 MB."""
    docs = _table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*(F.lit(x) for x in (".pdf", ".PDF", ".docx", ".doc", ".txt", ""))), (F.col("doc_id") % 6 + 1).cast("int"))
    return docs.select(F.concat(F.lit("store/"), "source", F.lit("/"), F.col("doc_id").cast("string"), kind).alias("path"), (F.col("n_chars") * 1024).alias("length"), F.col("text").cast("binary").alias("content"), "doc_id", "source")


def upload_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = ingest.gated(_listing(spark, sf_dir).select("path", "length"))
    return gated.select("path", "length", "extension", "mime_type", "error")


def upload_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ingest.upload_records(_listing(spark, sf_dir), F.col("source"), F.lit("system"), F.lit("2024-01-01 00:00:00"))
    return made.select("id", "tenant_id", "storage_type", "key", "name", "size", "extension", "mime_type", "created_by_role", "created_by", "used", "hash", "source_url")


def landed_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads landed in the shared folder under keys of their content, and read back from there."""
    files = _listing(spark, sf_dir).withColumn("key", ingest.upload_key(F.col("source"), F.col("content"), F.col("path")))
    root = f"{shared_dir(spark)}/chunkloom-{uuid.uuid4().hex}"
    written(ingest.landed(files, root), "landed")
    found = blobs.files(spark, root, max_bytes=None)
    return found.select(F.regexp_extract("path", "upload_files/.*$", 0).alias("key"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"))


def storage_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.scanned(_listing(spark, sf_dir), "store", directories=True)


def storage_exists_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = _listing(spark, sf_dir).select("path", "doc_id")
    left = ingest.without(listing, listing.where("doc_id % 3 = 0"))
    return ingest.existing(listing.select("path"), left)


def cached_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through the cache: even documents are cached, odd ones extracted (here: marked)."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    cache = docs.where("key % 2 = 0").select("key", F.lit(0).alias("page"), "text")
    pages, _ = ingest.read_through(docs, cache, lambda files: files.select("key", F.lit(0).alias("page"), F.concat("text", F.lit("!")).alias("text")))
    return pages


def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One markdown table of nations for each region."""
    n = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    return n.groupBy("r_name").agg(rows.alias("body")).select("r_name", documents.table_markdown(F.concat(F.array(F.array(F.lit("key"), F.lit("name"), F.lit("note"))), "body")).alias("markdown"), documents.column_count(F.col("body")).cast("long").alias("columns"))


def cell_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as the paragraphs of a cell."""
    return _docs(spark, sf_dir).select("doc_id", documents.cell_text(F.split("text", "\n")).alias("cell"))


def hyperlink_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as runs: every third one gives a URL, system turns are empty."""
    runs = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "system", "").otherwise(F.concat(F.lit("t"), F.col("turn").cast("string"))).alias("text"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("https://h/"), F.col("turn").cast("string"))).alias("url"))
    return documents.hyperlinks(runs, ["conv_id"], "turn").select("conv_id", "turn", "rendered")


def image_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    runs = docs.select("source", "doc_id", F.concat(F.lit("rId"), (F.col("doc_id") % 7).cast("string")).alias("rel_id"))
    relations = docs.where("doc_id % 7 < 4").select("source", F.concat(F.lit("rId"), (F.col("doc_id") % 7).cast("string")).alias("rel_id"), F.concat(F.lit("img/"), "source", F.lit("/"), (F.col("doc_id") % 7).cast("string")).alias("target"))
    return documents.image_links(runs, relations, ["source"]).select("source", "doc_id", "rel_id", "link")


def rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link, image, marker and indent text, and the extension of a content type."""
    pages = _table(spark, sf_dir, "pages")
    images = F.col("page_id") % 3
    return pages.select("page_id", tx.markdown_link(F.col("page_id").cast("string"), F.col("url")).alias("link"), tx.markdown_image(F.lit("http://files/"), F.col("page_id").cast("string")).alias("image"), tx.with_image_markers(F.lit("page"), images).alias("marked"), tx.indent(F.lit("a\nb")).alias("indented"), tx.extension_of_mime(F.when(images == 0, "image/PNG; q=1").otherwise("text/x")).alias("extension"))


def image_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by magic bytes, over bytes made from page ids."""
    heads = F.array(*(F.lit(h) for h in ("FFD8FF00", "89504E470D0A1A0A", "0000000C6A5020200D0A870A", "474946383961", "424D00", "49492A00", "4D4D002A", "49492B00", "4D4D002B", "00FF")))
    return _table(spark, sf_dir, "pages").select("page_id", tx.image_format(F.unhex(F.element_at(heads, (F.col("page_id") % 10 + 1).cast("int")))).alias("format"))


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web addresses found in text: each page's own URL within a sentence."""
    text = F.concat(F.lit("see "), F.col("url"), F.lit(' or "https://a.com/b" and '), F.col("url"), F.lit("."))
    return _table(spark, sf_dir, "pages").select("page_id", F.posexplode(tx.urls(text)).alias("pos", "found")).select("page_id", F.col("pos").cast("long").alias("pos"), "found")


def byte_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream reads of 4,096 bytes: their number and the sizes of the first and last."""
    pieces = tx.byte_pieces(F.encode("text", "UTF-8"))
    return _docs(spark, sf_dir).withColumn("p", pieces).select("doc_id", F.size("p").cast("long").alias("pieces"), F.octet_length(F.get("p", F.lit(0))).cast("long").alias("first"), F.octet_length(F.element_at("p", -1)).cast("long").alias("last"))


def enum_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "account").when(F.col("role") == "assistant", "end_user").otherwise("robot").alias("role"))
    return roles.select("conv_id", "turn", schema.in_domain(F.col("role"), "creator_user_role").alias("known"), schema.same(F.when(F.col("turn") > 1, F.col("role")), F.lit(None).cast("string")).alias("equals_null"))


def docx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines written as DOCX paragraphs and read back as markdown."""
    return round_trips.docx_pages(_docs(spark, sf_dir))


def pdf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines written as a PDF page and read back."""
    return round_trips.pdf_pages(_docs(spark, sf_dir))


QUERIES = {
    "g1_sentences_cjk": sentences_cjk, "g1_sentences_latin": sentences_latin, "m5_token_counts": token_counts,
    "g2_token_chunks_500_100": _tokens(500, 100), "g2b_token_chunks_30_0": _tokens(30, 0), "g2b_token_chunks_30_10": _tokens(30, 10),
    "g3_sentence_pack_512_100": _packed(512, 100), "g4_sentence_pack_500_65": _packed(500, 65), "g5_sentence_pack_256_50": _packed(256, 50),
    "g6_sentence_window_3": sentence_window, "g7_semantic_p95": _semantic(95), "g7_semantic_p5": _semantic(5), "g8_hybrid": hybrid, "g8_hybrid_cjk": hybrid_cjk, "g8_hybrid_sizes": hybrid_by_size, "g10_overlap_preview": overlap_preview,
    "k9_adjacent_similarity": adjacent_similarity, "a1_page_counts": page_counts, "a5_conversation_text": conversation_text, "s_conversation_children": conversation_children, "s_document_pages": document_pages, "p9_library_documents": library_documents,
    "m1_vector_functions": vector_functions, "a4_similarity_percentile": similarity_percentile, "t1_vector_top_k": vector_top_k, "t2_retrieval": retrieval, "t4_window_replacement": window_replacement,
    "p4_url_gate": url_gate, "p1_upload_gates": upload_gates, "s_upload_records": upload_records, "k1_landed_uploads": landed_uploads, "s15_storage_scan": storage_scan, "k5_storage_exists_delete": storage_exists_delete, "c1_cached_pages": cached_pages,
    "r1_table_markdown": table_markdown, "r3_cell_text": cell_text, "w3_hyperlinks": hyperlink_runs, "j1_image_links": image_links, "f4_rendering": rendering, "f7_image_magic": image_magic, "f3_page_urls": page_urls, "s16_byte_pieces": byte_pieces, "s_enum_checks": enum_checks,
    "s11_docx_round_trip": docx_round_trip, "s8_pdf_round_trip": pdf_round_trip,
}
