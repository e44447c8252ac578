"""Explicit schemas of the documents, one per child list."""

from __future__ import annotations

META = "document_type string, schema_version int, generated_at string"
DIVISION = "id string, name string, source_url string, faculty_url string, summary string"
PERSON = ("id string, full_name string, title string, profile_url string, bio string, academic string, orcid string, expertise array<string>, "
          "division_ids array<string>, pubmed_query string, collect_publications boolean, image_url string")
WORK = ("id string, title string, doi string, pmid string, arxiv_id string, url string, year int, published_at string, venue string, type string, "
        "preprint_server string, faculty_ids array<string>, division_ids array<string>, sources array<string>, first_seen_at string, last_seen_at string, has_abstract boolean")
DETAIL = "id string, abstract string, authors array<struct<name:string,orcid:string>>"
HEALTH = "source_id string, division_id string, status string, message string, count int, checked_at string"
TRAINEE = "id string, last string, first string, degree string, program string, program_id string, aliases array<string>, query string, faculty_id string"
ACTIVITY = ("id string, organization_id string, source_type string, source_label string, url string, title string, published_at string, "
            "first_seen_at string, last_seen_at string, researcher_ids array<string>")
CHUNK = ("id string, kind string, hash string, title string, snippet string, researcher_ids array<string>, organization_ids array<string>, "
         "year int, venue string, url string, doi string")
EDGE = "src string, dst string, weight long, first_year int, last_year int"

#: The document types and versions that are read.
VERSIONS = {"directory": 1, "publications": 2, "collaboration": 1, "network-plus": 1, "activity": 2}
