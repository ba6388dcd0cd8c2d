"""Errors of the wire format, each with a stable code."""

from __future__ import annotations

#: Codes by family.
GENERIC = (
    "missing_header", "missing_profile", "unknown_profile", "duplicate_header_field", "malformed_header_field", "invalid_missing", "invalid_attachment_marker", "unterminated_quote",
    "trailing_characters", "invalid_escape", "invalid_surrogate", "invalid_indent", "tab_indentation", "duplicate_key", "duplicate_field_name", "row_width_mismatch", "count_mismatch",
    "invalid_count", "orphan_attachment", "orphan_inline_attachment", "invalid_line", "missing_attachment", "duplicate_attachment", "invalid_item_id", "invalid_field_declaration",
    "invalid_json", "out_of_range",
)
GRAPH = ("missing_header", "invalid_symbol_id", "invalid_node_line", "invalid_score", "invalid_edge_syntax", "unknown_edge_reference", "malformed_delta", "count_mismatch")
DELTA = ("missing_header", "missing_profile", "malformed_delta", "delta_invalid", "base_mismatch", "root_mismatch", "count_mismatch")
CODES = frozenset((*GENERIC, *GRAPH, *DELTA))


class WireError(ValueError):
    """`code` is one of CODES; the message is the code and a detail."""

    def __init__(self, code: str, detail: object = ""):
        if code not in CODES:
            raise AssertionError(code)
        self.code = code
        super().__init__(f"{code}: {detail}" if detail != "" else code)
