"""Declared schemas of the tables that jobs read and write."""

PAGES = "book_id string, page_idx int, raw_text string"
CHUNKS = "book_id string, drug_name string, section_type string, species array<string>, book_page int, text string, ordinal int"
EVAL_CASES = "query_id bigint, query string, flow string, drug string, section string, species array<string>, relevant_logical_keys array<string>"
VECTORS = (
    "point_id string, vector array<float>, drug_name string, section_type string, species array<string>, book_page int, "
    "text string, logical_key string, content_hash string"
)
REGIMENS = "array<struct<indication:string,mg_per_kg_low:string,mg_per_kg_high:string,route:string,frequency:string,notes:string>>"
