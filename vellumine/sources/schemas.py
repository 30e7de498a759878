"""Declared schemas; nothing is inferred."""

CHUNK = "text string, chunk_id string, chunk_type string, paper_id string, paper_title string, section_hierarchy array<string>, char_start int, char_end int, chunk_index int, total_chunks int, overlap_with_previous boolean"
CHUNK_FILE = f"paper_id string, paper_title string, chunk_type string, total_chunks int, chunks array<struct<{', '.join(c.replace(' ', ': ', 1) for c in CHUNK.split(', '))}>>"
SPAN = "struct<paper_id: string, char_start: int, char_end: int, quote: string>"
CLAIM = f"struct<id: string, text: string, supporting_spans: array<{SPAN}>, annotator_label: string, reviewer_label: string>"
GOLD = f"id string, question string, gold_answer string, difficulty string, category string, annotator string, reviewer string, review_status string, iaa_subset boolean, claims array<{CLAIM}>"
ELEMENT = "element_id string, label string, reading_order int, text string, bbox struct<x1: int, y1: int, x2: int, y2: int>"
