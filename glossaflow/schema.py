"""The annotation model as flat tables."""

from __future__ import annotations

#: Fields that every entity carries, and the order of entities at one place.
INFO = ["type", "preferred_form", "original_resource", "native_id", "umls_cui"]
ARTICLES = "collection_id string, doc_id string, basename string, type string, year string, metadata map<string,string>"
SECTIONS = "doc_id string, sec_id int, type string, text string, start int, end int, metadata map<string,string>"
SENTENCES = "doc_id string, sec_id int, sent_id int, text string, start int, end int"
ENTITIES = "doc_id string, sec_id int, sent_id int, id string, text string, start int, end int, " + ", ".join(f"{f} string" for f in INFO)
UNKNOWN = "unknown"
