"""Schemas of the stored tables and deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the tables and their columns
SCHEMAS = {
    "projects": "id string, path string, name string, description string, collection_name string, space_name string, created_at timestamp, updated_at timestamp, last_indexed_at timestamp, status string, settings string, metadata string",
    "file_index_states": "id string, project_id string, file_path string, relative_path string, content_hash string, file_size long, last_modified timestamp, last_indexed timestamp, indexing_version int, chunk_count int, vector_count int, language string, file_type string, status string",
    "project_status": "project_id string, vector_status string, graph_status string, indexing_progress double, total_files int, indexed_files int, failed_files int, last_updated timestamp",
    "file_change_history": "id string, file_path string, project_id string, change_type string, previous_hash string, current_hash string, file_size long, timestamp timestamp, metadata string",
    "points": "collection string, id string, vector array<float>, payload struct<content: string, filePath: string, language: string, chunkType: array<string>, startLine: int, endLine: int, projectId: string>",
    "nodes": "id string, type string, name string, properties map<string, string>, project_id string",
    "edges": "id string, type string, src string, dst string, properties map<string, string>, project_id string",
}


def file_id(path: Column, project: Column | None = None) -> Column:
    parts = [F.regexp_replace(path, r"\\", "/")] + ([project] if project is not None else [])
    return F.concat(F.lit("file:"), F.concat_ws(":", *parts))


def chunk_id(path: Column, start: Column, end: Column, content: Column | None = None) -> Column:
    span = F.concat(start.cast("string"), F.lit("-"), end.cast("string"))
    tail = [F.substring(F.md5(content), 1, 8)] if content is not None else []
    return F.concat(F.lit("chunk:"), F.concat_ws(":", path, span, *tail))


def symbol_id(name: Column, kind: Column, path: Column, line: Column) -> Column:
    return F.concat(F.lit("symbol:"), F.concat_ws(":", name, kind, path, line.cast("string")))


def relation_id(src: Column, dst: Column, kind: Column) -> Column:
    return F.concat(F.lit("rel:"), F.substring(src, 1, 50), F.lit("->"), F.substring(dst, 1, 50), F.lit(":"), kind)


def safe_name(project: Column, prefix: str = "project") -> Column:
    fine = project.rlike(r"^[a-zA-Z0-9-][a-zA-Z0-9_-]{0,62}$")
    return F.when(fine, project).otherwise(F.concat(F.lit(prefix + "-"), F.substring(F.sha2(project, 256), 1, 16)))
