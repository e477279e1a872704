"""Schemas of the record collections, as DDL."""

RAW_BLOCK = (
    "doc_id string, pos int, type string, text string, text_level int, page_idx int, table_body string, table_caption array<string>, "
    "table_footnote array<string>, img_path string, image_caption array<string>, chart_caption array<string>, image_footnote array<string>, "
    "chart_footnote array<string>, content string, list_items array<string>, code_body string"
)
BLOCK = (
    "doc_id string, seq int, type string, text string, level int, page int, page_end int, section_path array<string>, table_html string, "
    "caption string, footnote string, context string, img_path string, derived boolean, absorbed boolean"
)
CHUNK = "doc_id string, seq int, kind string, text string, embed_body string, section_path string, page_start int, page_end int, derived boolean, table_html string"
FACT = "doc_id string, ord bigint, unit string, section string, page_start int, page_end int, item string, column string, value string"
ENTITY = "id string, name string, type string, codes array<string>, aliases array<string>, doc_ids array<string>"
PLAN = "struct<standalone_query:string,entity_mentions:array<string>>"
GOLD = "array<struct<file:string,quote:string>>"
TURN = f"struct<q:string,expect:string,gold:{GOLD},must_include:array<string>,must_not_include:array<string>>"
EVAL_ITEM = f"id string, category string, turns array<{TURN}>, expect string, gold {GOLD}, must_include array<string>, must_not_include array<string>, note string"
RECOGNISED = "type string, name string, codes array<string>, aliases array<string>"
REGISTRY = f"doc_id string, file_name string, content_type string, document_title string, status string, chunk_count int, entity struct<{RECOGNISED.replace(' ', ':').replace(',:', ',')}>, error string"
