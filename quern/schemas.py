"""Explicit schemas of the inputs; production reads never infer one."""

from __future__ import annotations

#: A parsed document and a chunk of one.
DOCUMENT = "doc_id bigint, text string, file_path string, suffix string"
CHUNK = "doc_id bigint, chunk_index int, chunk_start int, chunk_end int, text string"
#: Rows of a vector collection; further columns are free.
COLLECTION = "id bigint, vector array<float>"
QA = "question string, answer string"
SYMPTOM = "doc_id string, disease_name string, symptom_text string, department string"
SHOP = "doc_id string, shop_name string, query_similarity double, desc_text string, meta_info struct<distance_m: int, avg_price: int, closing_time: string, tag: array<string>>"
BOOK_RANK = "book_id string, book_title string, book_content string"
INTENT = "id string, label string, scope string"
PASSAGE = "doc_id string, category string, title string, content string"
ROOM = "room_id string, room_name string, department string, floor string, doctor string, description string"
GOODS = "sku string, name string, brand string, category string, sub_category string, color string, pattern string, features array<string>, release_year int, material string, capacity_ml int, price double, age_range string, shelf_location string, description string, stock int"
CATALOG_BOOK = "book_id string, title string, author string, category string, floor string, zone string, status string, text string"
PARENT_CARD = "parent_id string, child_text string, card_fields array<struct<key: string, value: string>>"
SENTENCES = "doc_id string, title string, sentences array<string>"
SUMMARY = "topic_id string, title string, summary string, original_text string"
TREE = "zone_id string, zone string, zone_desc string, shelves array<struct<shelf: string, shelf_desc: string, books: array<struct<title: string, call_no: string, text: string>>>>"
DOMAIN = "id string, title string, scope string, entities array<struct<name: string>>, relations array<struct<source: string, label: string, target: string>>"
SPELLING = "wrong string, right string, prev string, next string"
