"""Schemas of the engine's relations."""

AUTHOR = "struct<family: string, given: string, literal: string>"
CITER = "struct<DOI: string, URL: string, source: string>"
REFERENCE = "struct<key: string, unstructured: string, DOI: string>"

#: Works: one row for each citation record, projected from its JSON; raw keeps the rest.
WORKS = f"""_id string, type string, title string, original_title string, container_title string, container_title_short string,
collection_title string, volume string, issue string, page string, page_first string, DOI string, ISSN array<string>, publisher string,
publisher_place string, URL array<string>, author array<{AUTHOR}>, issued struct<year: bigint, month: bigint, day: bigint>,
is_referenced_by array<{CITER}>, reference array<{REFERENCE}>, abstract string, pdf string, kind string, source string, format string,
created string, modified string, fetched string, deleted string, cluster string, visited string"""

CONTAINER_DOCS = "_id string, name string, ISSN array<string>, variants array<string>, cluster_run string, junk boolean, curated boolean"
COVERAGE = "cluster_id string, cid string, title string, query string, match_id string, match_name string, score double, matched int, checked string"
