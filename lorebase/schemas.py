"""Explicit schemas of stored and passing records."""

from __future__ import annotations

BLOCK = "struct<type:string,text:string,page:int,bbox:array<double>,indent:double,font:string,headers:array<string>,rows:array<array<string>>,provenance:string,source_sha256:string>"
BOOKS = (
    "id string, title string, authority string, competition_scope array<string>, edition string, effective_from date, effective_until date, source_url string, discovery_url string, "
    "sha256 string, last_checked_at timestamp, ingested_at timestamp, status string, embedding_model string, content_fingerprint string"
)
CHUNKS = (
    "id string, rulebook_id string, edition string, section_key string, parent_section_key string, kind string, law_article string, section_title string, heading_path array<string>, body string, "
    f"blocks array<{BLOCK}>, page_start int, page_end int, printed_page_labels array<string>, source_url string, section_url string, effective_from date, effective_until date, embedding array<float>"
)
LINKS = "from_chunk_id string, to_chunk_id string, relation string, evidence string"
RUNS = (
    "id string, created_at timestamp, trace_id string, competition string, retrieval_config string, corpus_fingerprint string, model string, input_tokens int, output_tokens int, cost_usd decimal(14,8), "
    "latency_ms int, refused boolean, step_timings_ms map<string,int>, outcome string, pipeline_version string, diagnostics struct<provider_calls:int,cached_input_tokens:int,citation_count:int>"
)
WORDS = "page int, text string, x0 double, x1 double, top double, bottom double, fontname string"
EVIDENCE = "question_id long, evidence_id string, chunk_id string, rulebook_id string, section_key string, heading_path array<string>, edition string, url string, page_start int, page_end int, body string"
RECEIPT = "url string, anchor string, sha256 string, checked_at string, paragraphs array<string>"
CORRECTIONS = "section_key string, url string, anchor string, sha256 string"
SOURCE = (
    "id string, title string, authority string, competition_scope array<string>, edition string, source_url string, download_url string, discovery_url string, allowed_hosts array<string>, "
    "effective_from date, effective_until date, verified_on date, verification string, ingest_phase int, coverage array<string>, sha256 string, "
    f"corrections array<struct<{', '.join(x.replace(' ', ':') for x in CORRECTIONS.split(', '))}>>"
)
KINDS = ("section", "definition", "protocol", "guidance")
STATES = ("pending", "ready", "blocked")
RELATIONS = ("defines", "references", "explicit_variation")
CONTENT_BLOCKS = ("paragraph", "list_item", "table")
