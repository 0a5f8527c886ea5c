"""Row types of the engine's tables."""

PAGE = "doc_id string, page bigint, text string, title string"
CHUNK = "doc_id string, chunk bigint, name string, text string, first_page bigint, last_page bigint, is_reference boolean, start bigint"
SIGNALS = "n_chars int, n_images int, image_coverage double, garbage_ratio double, alpha_ratio double"
METADATA = (
    "title string, authors array<string>, year int, abstract string, doi string, arxiv_id string, version string, url string, "
    "license string, categories array<string>"
)
RECORD = (
    "index int, method string, n_chars int, seconds double, engine string, title string, model string, model_revision string, "
    "gen_tokens int, finish_reason string"
)
MANIFEST = (
    "doc_id string, source_path string, source_name string, source_kind string, mime string, size_bytes bigint, n_pages int, "
    f"source_pages int, max_pages int, ocr_all boolean, degraded boolean, pages array<struct<{RECORD.replace(' ', ':').replace(',:', ', ')}>>, "
    f"pipeline_version string, config_hash string, title string, metadata struct<{METADATA.replace(' ', ':').replace(',:', ', ')}>, "
    "created_at timestamp, total_seconds double"
)
TELEMETRY = (
    "candidate string, sample_id string, category string, seconds double, gen_tokens int, finish_reason string, attempts int, "
    "first_finish_reason string, total_gen_tokens int, gen_seconds double, peak_memory_gb double, text string, error string, ts timestamp"
)
