"""Schemas of the catalogue's tables as DDL, and the values of its status columns.

Identifiers are strings, sizes and epochs longs; nanosecond times stay longs, as
timestamps here have microseconds only.
"""

from __future__ import annotations

PLATFORMS = ("macos", "windows", "linux", "other")
PLAN_STATES = ("draft", "ready", "expired", "executing", "completed", "cancelled")
#: The states of a move operation, in the order of their numbers here.
OPERATION_STATES = (
    "draft", "planned", "preflight_passed", "intent_logged", "executing", "published", "verified",
    "completed", "conflict", "failed", "cancelled", "recovery_needed", "rollback_pending", "rolled_back",
)
JOB_STATES = ("queued", "running", "pause_requested", "paused", "cancel_requested", "completed", "failed", "cancelled")
CATEGORIES = ("document", "image", "audio", "video", "archive", "code", "data", "other")
RECONCILE_KINDS = ("inserted", "unchanged", "metadata_updated", "moved")
#: Operations in these states need no recovery.
TERMINAL_STATES = ("completed", "conflict", "failed", "cancelled", "rolled_back")

IDENTITY = "struct<platform:string,volume_id:string,native_file_id:string,generation:string>"
SNAPSHOT = "struct<size:long,modified_at_ns:long,changed_at_ns:long,created_at_ns:long>"


LIBRARIES = "id string, name string, created_at_ms long, updated_at_ms long"
ROOTS = "id string, library_id string, path string, enabled boolean, created_at_ms long"
FILES = (
    "id string, library_id string, platform string, volume_id string, native_file_id string, generation string, "
    "current_path string, size long, modified_at_ns long, changed_at_ns long, created_at_ns long, "
    "quick_fingerprint string, content_hash string, last_seen_at_ms long, missing_since_ms long"
)
FILE_PATHS = "file_id string, path string, valid_from_ms long, valid_until_ms long"
PLANS = "id string, library_id string, status string, created_at_ms long, expires_at_ms long"
PLAN_ITEMS = f"plan_id string, ordinal int, file_id string, source_path string, target_path string, expected struct<identity:{IDENTITY},snapshot:{SNAPSHOT}>"
OPERATIONS = "id string, plan_id string, status string, created_at_ms long, completed_at_ms long, error_code string, error_message string"
OPERATION_ITEMS = (
    f"operation_id string, ordinal int, status string, source_path string, target_path string, source_identity {IDENTITY}, "
    f"target_identity {IDENTITY}, error_code string, error_message string"
)
JOBS = (
    "id string, kind string, status string, payload string, progress_current long, progress_total long, priority int, "
    "lease_owner string, lease_expires_at_ms long, created_at_ms long, updated_at_ms long"
)
JOB_EVENTS = "id long, job_id string, event string, detail string, created_at_ms long"
SMART_FOLDERS = (
    "id string, library_id string, name string, query string, created_at_ms long, updated_at_ms long, rule_version int, "
    "rule struct<version:int,text:string,extension:string,minimum_size:long,maximum_size:long>"
)
OBSERVATIONS = f"library_id string, new_file_id string, path string, identity {IDENTITY}, snapshot {SNAPSHOT}, observed_at_ms long"
WATCH_STATE = "automation_id string, path string, size long, mtime_ns long, stable_count int, handled boolean"
RULES = (
    "id string, name string, enabled boolean, priority int, conditions struct<extensions:array<string>,name_contains:string,min_size:long,"
    "max_size:long,older_than_days:int,newer_than_days:int>, destination string, created_at string"
)
