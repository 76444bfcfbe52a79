"""Explicit schemas of every dataset, as Spark DDL. Nothing is inferred at read time.

``doc_number`` is the integer document id of the document store, ``id`` / ``document_id`` the
string id of the data tables. Feeds that use another wire name for the integer id pass a
``rename`` mapping to the readers.
"""

DOCUMENTS = (
    "id STRING, doc_number BIGINT, filename STRING, source STRING, page_count INT, "
    "tesseract_text STRING, htr_text STRING, merged_text STRING, deleted_at TIMESTAMP"
)
DOCUMENT_PAGES = (
    "id STRING, document_id STRING, page_number INT, image_s3_url STRING, tesseract_text STRING, "
    "htr_text STRING, htr_confidence DOUBLE, htr_flagged BOOLEAN"
)
HANDWRITTEN_REGIONS = (
    "id STRING, page_id STRING, crop_s3_url STRING, htr_output STRING, htr_confidence DOUBLE"
)
HTR_CORRECTIONS = (
    "id STRING, region_id STRING, corrected_text STRING, opted_in BOOLEAN, user_id STRING, "
    "corrected_at TIMESTAMP, archived_at TIMESTAMP"
)
QUERY_SESSIONS = "id STRING, result_doc_ids ARRAY<STRING>"
SEARCH_FEEDBACK = "document_id STRING, feedback_type STRING"
FEEDBACK_ROWS = (
    "id BIGINT, document_id BIGINT, user_id BIGINT, kind STRING, correction_text STRING, "
    "rating SMALLINT, query_text STRING, metadata STRING, created_at TIMESTAMP"
)
# Names of the data tables (fixed values).
ML_TABLES = {
    "documents": DOCUMENTS,
    "document_pages": DOCUMENT_PAGES,
    "handwritten_regions": HANDWRITTEN_REGIONS,
    "htr_corrections": HTR_CORRECTIONS,
    "query_sessions": QUERY_SESSIONS,
    "search_feedback": SEARCH_FEEDBACK,
    "feedback": FEEDBACK_ROWS,
}

# Field names of the archive, the snapshot and the event topics (fixed values).
CORRECTION_ARCHIVE = (
    "correction_id STRING, region_id STRING, document_id STRING, original_text STRING, "
    "corrected_text STRING, opted_in BOOLEAN, user_id STRING, corrected_at STRING, "
    "crop_s3_url STRING, archived_at STRING, archive_version STRING"
)
TRAINING_SNAPSHOT = (
    "region_id STRING, crop_s3_url STRING, corrected_text STRING, original_text STRING, "
    "source STRING, split STRING, correction_date STRING, writer_id STRING"
)
LINE_IMAGES = "image_id STRING, image_png BINARY, transcription STRING, split STRING"

_ENVELOPE = "event_id STRING, event_type STRING, emitted_at STRING, "
# Event topics and their fields (fixed values).
EVENT_TOPICS = {
    "uploads": _ENVELOPE
    + "doc_number BIGINT, title STRING, mime_type STRING, page_count INT, uploaded_at STRING, "
    "source STRING",
    "corrections": _ENVELOPE
    + "doc_number BIGINT, corrected_text STRING, user_id STRING, region_id STRING, "
    "original_htr_output STRING, original_confidence DOUBLE, model_version_at_correction STRING",
    "feedback": _ENVELOPE
    + "session_id STRING, query_id STRING, doc_number BIGINT, kind STRING, rating INT, "
    "user_id STRING",
    "queries": _ENVELOPE
    + "session_id STRING, query_text STRING, user_id STRING, keyword_result_count INT, "
    "semantic_result_count INT, merged_result_ids ARRAY<BIGINT>, top_similarity_score DOUBLE, "
    "fallback_to_keyword BOOLEAN, model_version STRING",
}

CHUNK_POINTS = (
    "id STRING, vector ARRAY<FLOAT>, document_id STRING, chunk_index INT, chunk_text STRING, "
    "model_version STRING"
)
DOCUMENT_STATS = (
    "document_id STRING, thumbs_up BIGINT, thumbs_down BIGINT, clicks BIGINT, "
    "total_impressions BIGINT, up_rate DOUBLE, down_rate DOUBLE, computed_at TIMESTAMP"
)
METRIC_SAMPLES = "ts TIMESTAMP, metric STRING, labels MAP<STRING, STRING>, value DOUBLE"
ALERTS = "received_at TIMESTAMP, status STRING, labels MAP<STRING, STRING>"

# Response contracts: top-level field name -> JSON type of the sample value (fixed values).
CONTRACTS = {
    "htr_input": {
        "document_id": "str", "page_id": "str", "region_id": "str", "crop_s3_url": "str",
        "image_width": "int", "image_height": "int", "image_format": "str", "source": "str",
        "uploaded_at": "str",
    },
    "htr_output": {
        "region_id": "str", "htr_output": "str", "htr_confidence": "float",
        "htr_flagged": "bool", "model_version": "str", "inference_time_ms": "int",
    },
    "search_input": {
        "session_id": "str", "query_text": "str", "user_id": "str", "top_k": "int",
    },
    "search_output": {
        "session_id": "str", "query_text": "str", "results": "list",
        "fallback_to_keyword": "bool", "model_version": "str", "inference_time_ms": "int",
    },
}

# Metric names the alert rules depend on (fixed values).
REQUIRED_SERIES = [
    "htr_requests_total",
    "htr_corrections_total",
    "htr_confidence_count",
    "search_queries_total",
    "search_clicks_total",
    "search_top_similarity_count",
    "http_request_duration_seconds_count",
]

# Histogram upper bounds (fixed values).
CONFIDENCE_BUCKETS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0]
SIMILARITY_BUCKETS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
