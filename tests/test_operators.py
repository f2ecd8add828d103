import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom import schema
from chunkloom.config import Settings, merge_settings
from chunkloom.functions import text as tx
from chunkloom.functions import vectors as vx
from chunkloom.operators import documents, ingest, retrieve


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_settings():
    assert Settings.load({}, {}) == Settings()
    got = Settings.load({"CHUNK_SIZE": "9", "TOP_K": ""}, {"chunk_size": "7", "UPLOAD_DIR": "up"})
    assert (got.chunk_size, got.top_k, got.upload_dir) == (7, 4, "up")
    assert merge_settings({"A_X": "1", "A_Y": None}, {"a_x": "2", "B": "3"}, "A_") == {"x": "2"}


def test_vectors_equal_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype("f4").tolist(), rng.normal(size=8).astype("f4").tolist()) for i in range(50)] + [(99, [0.0] * 8, [1.0] * 8)]
    df = spark.createDataFrame(rows, "i int, a array<float>, b array<float>")
    for r in df.select("i", "a", "b", vx.cosine(F.col("a"), F.col("b")).alias("c")).collect():
        a, b = np.array(r.a, float), np.array(r.b, float)
        assert r.c is None if r.i == 99 else abs(r.c - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) < 1e-12


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.integers(0, 3, (60, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(60, None)], "row_id int, vector array<double>").repartition(5)
    queries = df.where("row_id < 7").select(F.col("row_id").alias("query_id"), "vector")
    got = {}
    for r in retrieve.top_k(queries, df, 3, query_bytes=300).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.row_id, r.score))
    for q in range(7):
        n = np.sqrt((vectors * vectors).sum(1))
        scores = [(-round(float(vectors[q] @ vectors[i] / n[q] / n[i]), 6), i) for i in range(60) if n[q] and n[i]]
        assert [i for i, _ in got.get(q, [])] == [i for _, i in sorted(scores)[:3]]
    assert retrieve.top_k(queries.limit(0), df, 3).count() == 0
    one_pass = retrieve.top_k(queries, df, 3)
    assert sorted(one_pass.collect()) == sorted(retrieve.top_k(queries, df, 3, query_bytes=300).collect())
    named = retrieve.top_k(queries, df.withColumn("row_id", F.lpad(F.col("row_id").cast("string"), 3, "0")), 3)
    assert {(r.query_id, r["rank"], int(r.row_id)) for r in named.collect()} == {(r.query_id, r["rank"], r.row_id) for r in one_pass.collect()}


def test_shuffled_candidates_do_not_grow_with_batches(spark):
    """A task passes on k rows a query, in however many Arrow batches it reads its rows; equal scores in plenty change nothing."""
    rows = spark.range(4000).select(F.col("id").alias("row_id"), F.array(F.lit(1.0), (F.col("id") % 3).cast("double")).alias("vector")).repartition(4)
    queries = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)] + [(9, [1.0, 1.0, 1.0]), (10, None)], "query_id long, vector array<double>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    counts, hits = [], []
    for size in ("20", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            counts.append(retrieve.candidates(queries, rows, 3).count())
            hits.append(sorted(retrieve.top_k(queries, rows, 3).collect()))
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert counts == [4 * 5 * 3] * 2 and hits[0] == hits[1]
    assert [r.row_id for r in hits[0] if r.query_id == 0] == [0, 3, 6]


def test_stored_chunks(spark, tmp_path):
    from chunkloom.operators import store

    calls = spark.sparkContext.accumulator(0)

    def lengths(batch):
        calls.add(len(batch))
        return [[float(len(t)), 1.0] for t in batch]

    chunks = spark.createDataFrame([(i, "x" * i, f"around {i}" if i % 2 else None) for i in range(1, 9)], "row_id long, text string, window string")
    settings = Settings(vector_store_dir=str(tmp_path / "store"))
    stored = store.save(store.embedded(chunks, vx.Model(lengths)), settings=settings)
    assert store.load(spark, settings=settings).count() == 8 and calls.value == 8
    hits = retrieve.top_k(spark.createDataFrame([(0, [3.0, 1.0])], "query_id long, vector array<double>"), stored, 2)
    for few in (10, 0):
        shown = {r.row_id: r.text for r in retrieve.with_nodes(hits, stored.select("row_id", "text", "window"), few).collect()}
        assert shown == {3: "around 3", 4: "xxxx"}
    assert calls.value == 8  # nothing is encoded again when the table is read
    store.save(store.embedded(chunks), str(tmp_path / "store"), "append")
    assert store.load(spark, str(tmp_path / "store")).count() == 16


def test_hyperlinks_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(d, p, rng.choice(["", "t", "u", None]), rng.choice([None, None, "h1", "h2"])) for d in range(40) for p in range(25)]
    df = spark.createDataFrame(rows, "d int, p int, text string, url string").repartition(4)
    got = {(r.d, r.p): r.rendered for r in documents.hyperlinks(df, ["d"], "p").collect()}
    for d in range(40):
        waiting = None
        for _, p, text, url in (r for r in rows if r[0] == d):
            if text:
                assert got[d, p] == (f"[{text}]({waiting})" if waiting else text)
                waiting = None
            else:
                assert got[d, p] == text
            waiting = url or waiting


def test_text_functions(spark):
    for name, expected in (("a/b.PDF", ".pdf"), ("x.tar.gz", ".gz"), ("none", ""), (".bashrc", ""), ("d.x/y", "")):
        assert one(spark, tx.suffix(F.lit(name))) == expected
    assert one(spark, tx.urls(F.lit("see http://a.com/b and https://c.d/e?f=1+2."))) == ["http://a.com/b", "https://c.d/e?f=1+2."]
    assert one(spark, tx.urls(F.lit('HYPERLINK "https://a.com/b" http://a.com/b http://x//'), compat=True)) == ['https://a.com/b"', "http://x//"]
    for url, ok in (("http://a", True), ("mailto:x", False), ("//a/b", False), ("a", False), (None, False)):
        assert one(spark, tx.valid_url(F.lit(url).cast("string"))) is ok
    for magic, name in (("FFD8FFE0", "jpg"), ("89504E470D0A1A0A00", "png"), ("4D4D002A", "tiff"), ("0011", None), ("", None)):
        assert one(spark, tx.image_format(F.unhex(F.lit(magic)))) == name
    assert one(spark, tx.with_image_markers(F.lit("t"), F.lit(0))) == "t"
    assert one(spark, F.transform(tx.byte_pieces(F.lit("x" * 9000).cast("binary")), F.octet_length)) == [4096, 4096, 808]
    assert one(spark, F.size(tx.byte_pieces(F.lit("").cast("binary")))) == 0
    assert one(spark, F.size(tx.tokens(F.lit("中文ab 文"), tx.WORD_CJK))) == 4


def test_schema_functions(spark):
    assert one(spark, schema.string_uuid(F.lit("6BA7B810-9dad-11d1-80b4-00c04fd430c8"))) == "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    assert one(spark, schema.string_uuid(F.lit("nope"))) is None
    assert one(spark, schema.checked(F.lit("account"), "creator_user_role")) == "account"
    with pytest.raises(Exception, match="not in creator_user_role"):
        one(spark, schema.checked(F.lit("robot"), "creator_user_role"))
    assert schema.enum_length("message_status") == 20 and schema.enum_length("message_status", 6) == 6
    with pytest.raises(ValueError, match="too short"):
        schema.enum_length("message_status", 3)


def test_tables(spark):
    rows = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")))
    assert one(spark, documents.table_markdown(rows)) == "| a | b |\n| --- | --- |\n| c |  |"
    assert one(spark, documents.table_markdown(F.array().cast("array<array<string>>"))) is None
    assert one(spark, documents.cell_text(F.array(F.lit(" x "), F.lit(""), F.lit("y"), F.lit("x")))) == "x y"


def test_documents_of_the_full_schema(spark):
    part = {"page_content": "child", "vector": [1.0], "metadata": {"k": "v"}}
    df = spark.createDataFrame([("text", "1", None, {"source": "f"}, schema.DEFAULT_PROVIDER, [part, {**part, "page_content": "second"}], [{**part, "provider": "p"}]), ("alone", "2", None, None, None, [], None)], schema.DOCUMENT)
    assert [(r.id_, r.child_idx, r.page_content) for r in documents.flattened(df, "id_").collect()] == [("1", 0, "child"), ("1", 1, "second")]
    assert [tuple(r) for r in documents.library_documents(df).collect()] == [("text", {"source": "f"}), ("alone", None)]


def test_gates_cache_and_storage(spark):
    files = spark.createDataFrame([("in/a.PDF", 5, bytearray(b"x")), ("in/b.docx", 11_000_000, bytearray(b"y")), ("in/s/c.txt", 1, bytearray(b"z")), ("in/", 0, bytearray(b""))], "path string, length long, content binary")
    gated = {r.path: r.error for r in ingest.gated(files).collect()}
    assert gated == {"in/a.PDF": None, "in/b.docx": "too large", "in/s/c.txt": "unsupported type .txt", "in/": "no file name"}
    records = ingest.upload_records(files.limit(1), F.lit("t"), F.lit("u"), F.lit("2024-01-01"))
    assert [f.name for f in records.schema] == [f.name for f in schema.UPLOAD_FILE]
    assert records.first().extension == "pdf"
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    cache = spark.createDataFrame([("a", "old")], "key string, text string")
    pages, fresh = ingest.read_through(keys, cache, lambda f: f.select("key", F.lit("new").alias("text")))
    assert sorted((r.key, r.text) for r in pages.collect()) == [("a", "old"), ("b", "new")] and fresh.count() == 1
    found = {(r.path, r.is_dir) for r in ingest.scanned(files.where("length > 0"), "in", directories=True).collect()}
    assert found == {("in/a.PDF", False), ("in/b.docx", False), ("in/s/c.txt", False), ("in/s/", True)}
    with pytest.raises(ValueError, match="nothing to list"):
        ingest.scanned(files, "in", files=False)


def test_tables_between_steps(spark, tmp_path, monkeypatch):
    """They lie in the shared folder, and go when they are swept; a cluster without such a folder is an error."""
    from types import SimpleNamespace

    from chunkloom import shared

    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    with monkeypatch.context() as patched:
        patched.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}")
        (tmp_path / "other").mkdir()
        table = shared.written(spark.range(3), "t")
        assert table.count() == 3 and len(list(tmp_path.glob("chunkloom-*/t"))) == 1
        assert shared.swept(spark) == 0 and shared.swept(spark, -60) == 1
        assert [p.name for p in tmp_path.iterdir()] == ["other"]
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_dir(cluster)


def test_queries_leave_the_session_as_it_was(spark, sf):
    from chunkloom.plans import registry

    settings = lambda: {r.key: r.value for r in spark.sql("SET").collect()}
    before = settings()
    for name in ("g8_hybrid", "t2_retrieval", "k1_landed_uploads"):
        registry.QUERIES[name](spark, sf).count()
    assert settings() == before
