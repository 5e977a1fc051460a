"""Column expressions that inspect SQL text without running it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabquest import fixed_values as fv
from tabquest.functions.names import strip

# The patterns that decide what a query reads.
_FROM_CLAUSE = (
    r"(?siU)\bfrom\b(.*?)(?:\bwhere\b|\bgroup\s+by\b|\border\s+by\b|\blimit\b|\bhaving\b|$)"
)
_FROM_TARGET = r'(?iU)\bfrom\s+(?:"([^"]+)"|([a-zA-Z_][a-zA-Z0-9_]*))'
_SINGLE_QUOTED = "'[^']*'"
_QUOTE_PAIRS = "(?:'')+"
_ANY_QUOTED = r"""'[^']*(?:'|\z)|"[^"]*(?:"|\z)"""


def normalize_sql(sql: Column) -> Column:
    """Text without outer white space and trailing semicolons."""
    return strip(F.regexp_replace(strip(sql), r";+\z", ""))


def strip_quoted_content(sql: Column) -> Column:
    """Empty every single-quoted literal; double-quoted identifiers stay.

    A doubled quote inside a literal first looks like two literals side by side.
    Both steps work without nested repetition, which Java evaluates recursively.
    """
    emptied = F.regexp_replace(sql, _SINGLE_QUOTED, "''")
    return F.regexp_replace(emptied, _QUOTE_PAIRS, "''")


def has_multiple_statements(sql: Column) -> Column:
    """A semicolon outside quotes that is followed by more text.

    Quoted stretches become a letter, not nothing, so that a quoted tail still
    counts as text; an unterminated quote swallows the rest.
    """
    return F.regexp_replace(strip(sql), _ANY_QUOTED, "q").rlike(r"(?U);[\s\x1c-\x1f]*[^\s\x1c-\x1f]")


def from_clause(sql: Column) -> Column:
    return strip(F.regexp_extract(sql, _FROM_CLAUSE, 1))


def from_tables(sql: Column) -> Column:
    """Names that directly follow FROM, in order, repeats included."""
    targets = F.regexp_extract_all(sql, F.lit(_FROM_TARGET), F.lit(0))
    return F.transform(
        targets, lambda t: F.regexp_replace(t, r'(?iU)^from\s+"?|"$', "")
    )


def forbidden_keywords(lowered: Column) -> Column:
    """Forbidden words present, in the fixed order.  One pass over the text finds them all."""
    found = F.regexp_extract_all(
        lowered, F.lit(r"(?iU)\b(" + "|".join(fv.FORBIDDEN_KEYWORDS) + r")\b"), F.lit(1)
    )
    return F.array_intersect(F.array(*[F.lit(k) for k in fv.FORBIDDEN_KEYWORDS]), found)
