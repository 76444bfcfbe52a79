import datetime as dt

from inkfold.operators import documents as D

T0 = dt.datetime(2024, 3, 1)


def test_upsert_chunks(spark):
    old = spark.createDataFrame([(1, i, "o") for i in range(3)] + [(2, 0, "o")], "document_id INT, chunk_index INT, chunk_text STRING")
    new = spark.createDataFrame([(1, 0, "n"), (3, 0, "n")], old.schema)
    once = D.upsert_chunks(old, new)
    rows = {tuple(r) for r in once.collect()}
    assert rows == {(1, 0, "n"), (2, 0, "o"), (3, 0, "n")}
    assert {tuple(r) for r in D.upsert_chunks(once, new).collect()} == rows


def test_upsert_documents(spark):
    schema = "id STRING, doc_number BIGINT, filename STRING, source STRING, page_count INT, merged_text STRING, deleted_at TIMESTAMP"
    old = spark.createDataFrame([("a", 1, "old.pdf", "test", 1, "x", T0), ("b", 2, "b.pdf", "test", 2, "y", None)], schema)
    new = spark.createDataFrame(
        [("n1", 1, "new.pdf", "user_upload", 9, None, None, T0), ("n0", 1, "older.pdf", "test", 5, "z", None, T0 - dt.timedelta(1)), ("c", 3, "c.pdf", "user_upload", 3, "w", None, T0)],
        schema + ", updated_at TIMESTAMP",
    )
    got = {r.doc_number: tuple(r) for r in D.upsert_documents(old, new).collect()}
    assert got[1] == ("a", 1, "old.pdf", "user_upload", 9, None, T0)
    assert got[2] == ("b", 2, "b.pdf", "test", 2, "y", None)
    assert got[3] == ("c", 3, "c.pdf", "user_upload", 3, "w", None)


def test_reprocess_guard(spark):
    docs = spark.createDataFrame([(1,), (2,)], "document_id INT")
    pages = spark.createDataFrame([(10, 1), (20, 2)], "id INT, document_id INT")
    regions = spark.createDataFrame([(100, 10), (200, 20)], "id INT, page_id INT")
    corrections = spark.createDataFrame([(100,)], "region_id INT")
    got = {tuple(r) for r in D.reprocess_guard(docs, pages, regions, corrections).collect()}
    assert got == {(1, 1, "skip"), (2, 0, "reprocess")}


U1, U2 = "0a0a0a0a-0000-0000-0000-00000000000a", "0b0b0b0b-0000-0000-0000-00000000000b"


def test_id_mapping(spark):
    ids = spark.createDataFrame([(1, U1), (2, U2)], "doc_number BIGINT, doc_uuid STRING")
    refs = spark.createDataFrame([("1",), (U2.upper(),), ("99",), ("junk",), ("007",), ("02",), (None,)], "document_ref STRING")
    got = {r.document_ref: (r.doc_number, r.doc_uuid) for r in D.map_doc_ids(refs, ids).collect()}
    assert got == {"1": (1, U1), U2.upper(): (2, U2), "99": (None, None), "junk": (None, None), "007": (None, None), "02": (2, U2), None: (None, None)}
    groups = spark.sql(f"SELECT 1 AS group_id, '{U1}' AS document_id, array(named_struct('region_id', 5)) AS regions UNION ALL SELECT 2, 'unknown', NULL")
    got = {r.group_id: r for r in D.rewrite_queue_ids(groups, ids).collect()}
    assert (got[1].document_id, got[1].document_id_uuid, got[1].doc_number) == ("1", U1, 1)
    assert tuple(got[1].regions[0]) == (5, "1", U1, 1)
    assert (got[2].document_id, got[2].document_id_uuid, got[2].doc_number, got[2].regions) == ("unknown", None, None, None)


def test_log_rules(spark):
    ids = spark.createDataFrame([(1, U1)], "doc_number BIGINT, doc_uuid STRING")
    paths = [f"/api/documents/{U1.upper()}/preview/", f"/api/documents/{U1}", f"/api/documents/{U2}/x", "/api/documents/12/x", f"/x/api/documents/{U1}"]
    log = spark.createDataFrame(list(enumerate(paths)), "event_id INT, path STRING")
    got = {r.event_id: r.rewritten_path for r in D.rewrite_doc_paths(log, ids).collect()}
    assert got == {0: "/api/documents/1/preview/", 1: "/api/documents/1", 2: paths[2], 3: paths[3], 4: paths[4]}
    posts = spark.createDataFrame(
        [("POST", "/api/ml/htr/corrections/", 201), ("POST", "/api/ml/search/feedback/", 299), ("POST", "/api/ml/search/feedback/", 300), ("GET", "/api/ml/search/feedback/", 200), ("POST", "/api/ml/search/feedback/x", 200)],
        "method STRING, path STRING, status INT",
    )
    assert sorted(r.counter for r in D.successful_feedback_posts(posts).collect()) == ["/metrics/click-recorded", "/metrics/correction-recorded"]


def test_merged_text(spark):
    pages = spark.createDataFrame([(1, 2, "p2", None), (1, 1, "p1", "h1"), (1, 3, "", None), (2, 1, None, "h")], "document_id INT, page_number INT, tesseract_text STRING, htr_text STRING")
    got = {r.document_id: (r.page_count, r.tesseract_text, r.htr_text, r.merged_text) for r in D.merge_document_text(pages).collect()}
    assert got == {1: (3, "p1\np2", "h1", "p1\nh1\np2"), 2: (1, "", "h", "h")}
