"""Schemas of the archive's tables, as DDL."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "runs": "id long, started_at string, finished_at string, status string, account string, error string",
    "bodies": "sha256 string, body binary, byte_length long",
    "responses": "id long, event_id string, run_id long, account string, fetched_at string, operation string, variables_json string, query_id string, app_version string, http_status int, headers_json string, body_sha256 string, json_text string, parse_error string, projected int",
    "response_fetches": "event_id string, response_id long, run_id long, fetched_at string, headers_json string, acknowledged int",
    "issues": "id long, run_id long, response_id long, code string, context string, created_at string",
    "matches": "account string, kind string, match_key string, first_seen string, last_seen string, detail_response_id long",
    "match_refs": "account string, kind string, remote_id string, match_key string",
    "sightings": "response_id long, path string, account string, kind string, match_key string, summary_json string",
    "documents": "response_id long, account string, kind string, match_key string, json_text string",
    "jobs": "account string, operation string, variables_json string, kind string, match_key string, state string, attempts int, empty_retries int, next_attempt double, last_response_id long",
    "endpoint_heads": "account string, operation string, response_id long",
    "control": "key string, value string",
    "match_classification": "account string, kind string, match_key string, genre string, mode_raw string, bankara_mode string, rule_raw string, rule_name string, roster_class string, analysis_set string, team_count int, my_player_count int, opponent_counts array<int>, detail_response_id long, classified_at string",
    "rate_points": "account string, series_id string, label string, genre string, rule_raw string, match_key string, played_time string, value double, source string, priority string",
    "match_tags": "account string, match_key string, tag string, note string, created_at string, updated_at string",
    "analysis_genre": "genre string, label string, top_level int",
    "entities": "account string, typename string, entity_id string, response_id long, json_text string",
    "page_fingerprints": "account string, operation string, binding string, field_path string, sha256 string",
    "assets": "url string, state string, body_sha256 string, content_type string, attempts int, next_attempt double, last_error string",
    "asset_refs": "response_id long, url string, path string",
    "manifests": "sha256 string, fetched_at string, json_text string",
    "archive_change_feed": "event_id long, table_name string, operation string, old_rowid long, new_rowid long, old_key_json string, new_key_json string, changed_at string",
}

#: One fetch as it arrives: the spool and import sources.
ENVELOPE = "event_id string, account string, fetched_at string, operation string, variables string, query_id string, app_version string, status int, headers string, body_base64 string"
