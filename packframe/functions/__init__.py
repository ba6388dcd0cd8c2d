"""Column functions of the scalar grammar."""

from packframe.functions.scalar import (
    abbreviate_kind,
    canonical_cell,
    count_value,
    expand_kind,
    format_scalar,
    lenient_cell,
    needs_quote,
    number_text,
    parse_scalar,
    quote_string,
    savings_text,
    score_text,
    split_cells,
    typed_cell,
    unquote_string,
    wire_bytes,
)

__all__ = [
    "abbreviate_kind", "canonical_cell", "count_value", "expand_kind", "format_scalar", "lenient_cell", "needs_quote", "number_text", "parse_scalar", "quote_string", "savings_text", "score_text",
    "split_cells", "typed_cell", "unquote_string", "wire_bytes",
]
