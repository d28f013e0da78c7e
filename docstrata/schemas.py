"""Explicit schemas of the engine's inputs and results; nothing is inferred."""

RAW_SPANS = (
    "doc_id bigint, page_number int, page_width double, page_height double, line_seq int, span_seq int, text string, font string, "
    "flags int, size double, x0 double, top double, x1 double, bottom double, line_x0 double, line_top double, line_x1 double, line_bottom double"
)
RAW_PAGES = "doc_id bigint, page_number int, width double, height double, image_count int, table_count int, character_count int"
LINES = "doc_id bigint, line_index int, page_number int, text string, max_font_size double, is_bold boolean, is_column_start boolean"
SECTION_TEXTS = "doc_id bigint, section_ord int, kind string, text string"
UPLOADS = "path string, content_type string, length bigint, content binary"
SURFACES = "surface string, skill_id string, name string, category string, strict boolean, n_words int, cand_ord int"
HEADING_ALIASES = "alias string, kind string"
EXPECTED_SECTIONS = "ord int, kind string"
SECTION_ADVICE = "kind string, severity string, title string, detail string"
ROLE_SKILLS = "role string, skill_id string"
RUBRIC = "check_ord int, check_id string, label string, weight double, severity string, passed_text string, failed_text string, fix_title string, fix_detail string"
ERRORS = "code string, status int, message string, remediation string"

# Kinds, severities and versions.
SECTION_KINDS = (
    "contact", "summary", "education", "experience", "skills", "projects", "certifications",
    "awards", "publications", "languages", "interests", "references", "other",
)
SEVERITIES = ("critical", "high", "medium", "low")
SCHEMA_VERSION = "1.0.0"
RUBRIC_VERSION = "2026.09.1"
MODEL_VERSION = "fixture"
