"""pageloom: tables of links, items and seeds out of tables of captured pages."""

from .functions.dates import parse_date
from .functions.macros import Macros, job_macros
from .functions.parse import parse_array, parse_value, register_parser
from .functions.urls import canonical_url, url_sha1
from .operators.dedup import drop_seen, purge_seen, record_seen
from .operators.items import Field, Job, extract_html_items, extract_json_items, store_columns
from .operators.links import LinkRule, extract_links, next_page_links
from .operators.seeds import bind_keywords, seed_urls
from .operators.walk import walk
from .sinks.write import media_manifest, message_payload, upsert_rows, write_items
from .sources.pages import read_pages

__all__ = [
    "Field", "Job", "LinkRule", "Macros", "bind_keywords", "canonical_url", "drop_seen", "extract_html_items",
    "extract_json_items", "extract_links", "job_macros", "media_manifest", "message_payload", "next_page_links",
    "parse_array", "parse_date", "parse_value", "purge_seen", "read_pages", "record_seen", "register_parser",
    "seed_urls", "store_columns", "upsert_rows", "url_sha1", "walk", "write_items",
]
