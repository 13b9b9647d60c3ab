"""The tables of comment analysis. Offsets are bytes; source text is always binary."""

SOURCES = "path string, content binary, size long, language string, dialect string, detected_by string"
SKIPPED = "path string, reason string, error boolean"
COMMENTS = "path string, idx int, span_start long, span_end long, lexical_kind string, raw binary"
DIAGNOSTICS = "path string, code string, severity string, span_start long, span_end long"
EDITS = "path string, span_start long, span_end long, replacement binary"
SOURCE_MAP = "path string, original_start long, original_end long, output_start long, output_end long, exact boolean"

KINDS = ("line", "block", "doc-line", "doc-block", "license", "directive", "load-bearing", "html-comment", "shebang", "encoding", "optimizer-hint", "version-comment")
POLICIES = ("none", "conservative", "standard", "all")
LAYOUTS = ("lines", "columns", "compact")
