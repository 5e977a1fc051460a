"""Word lists, defaults, patterns, messages and text layouts.

Everything in this module is a fixed value.  The texts and word lists are part
of the results users compare, so they are stated here as they are, in one
place, and used everywhere else by name.
"""

# ---- fixed values: defaults ------------------------------------------------
DEFAULT_SAMPLE_ROWS = 3
DEFAULT_TOP_K = 3
DEFAULT_SQL_CANDIDATES = 2
DEFAULT_TOP_COLUMNS = 25
DEFAULT_ROW_LIMIT = 20
PREVIEW_COLUMNS = 15
EXACT_TOKEN_WEIGHT = 25.0
PARTIAL_TOKEN_WEIGHT = 1.0

# ---- fixed values: words ignored when text is tokenised --------------------
STOPWORDS = (
    "a", "an", "and", "are", "can", "columns", "find", "for", "help", "how",
    "in", "is", "of", "or", "related", "show", "that", "the", "to", "what",
    "which", "with",
)

# ---- fixed values: phrases that decide the query mode ----------------------
BROAD_PROFILE_HINTS = (
    "all symptoms", "all side effects", "all columns", "full profile",
    "complete profile", "complete record", "entire record", "all information",
    "full information", "full record",
)
AGGREGATE_HINTS = (
    "how many", "count", "number of", "average", "avg", "probability",
    "probabilities", "prevalence", "rate", "rates", "distribution", "minimum",
    "maximum", "sum", "percentage", "percent", "group by",
)
MODE_FOCUSED = "focused_filter"
MODE_BROAD = "broad_profile"
MODE_AGGREGATE = "aggregate"
MODE_BROAD_AGGREGATE = "broad_aggregate"

# ---- fixed values: normalised names that identify a record -----------------
IDENTIFIER_COLUMN_NAMES = (
    "id", "record_id", "dataset_name", "disease", "diseases", "drug",
    "drug_1", "drug_2", "drug1", "drug2",
)

# ---- fixed values: words a read-only query may not contain -----------------
FORBIDDEN_KEYWORDS = (
    "insert", "update", "delete", "drop", "alter", "create", "copy", "attach",
    "detach", "pragma", "truncate", "merge", "replace", "grant", "revoke",
    "call",
)

# ---- fixed values: audit messages ------------------------------------------
MSG_EMPTY = "SQL query is empty."
MSG_COMMENTS = "SQL comments are not allowed."
MSG_MULTIPLE = "Multiple SQL statements are not allowed."
MSG_NOT_SELECT = "Only SELECT queries are allowed."
MSG_KEYWORD = "Forbidden SQL keyword detected: "
MSG_JOIN = "JOIN queries are not allowed in the current phase."
MSG_COMMA_FROM = "Multiple tables in FROM are not allowed."
MSG_ONE_TABLE = "Exactly one table must appear in the FROM clause."
MSG_UNEXPECTED_TABLE = "Query references unexpected table '%s', expected '%s'."
MSG_SANITY_SELECT = "Generated SQL is not a SELECT query."
MSG_SANITY_TABLE = "Generated SQL does not reference the expected table."
MSG_INDEX = "Generated candidate index is not allowed: "
MSG_TABLE = "Generated table name does not match the chosen candidate table: "
MSG_NO_QUESTION = "Question is required."
MSG_NOT_IN_MANIFEST = "Retrieved dataset was not found in the manifest: "
MSG_NO_TABLE = "Table not found: "

# ---- fixed values: stages timed in a metrics record ------------------------
TIMING_STAGES = (
    "retrieval", "context_enrichment", "sql_context_preparation",
    "sql_generation", "sql_validation", "sql_execution", "total",
)

# ---- fixed values: defaults and sentences of a dataset description ----------
DEFAULT_SOURCE = "local CSV file"
DEFAULT_DOMAIN = "healthcare"
DESCRIPTION_FALLBACK = "%s is a healthcare dataset."
STRUCTURE_SENTENCE = "It contains %s rows and %s columns in CSV format."
RETRIEVAL_SENTENCE = (
    "Use this dataset for retrieval, metadata search, and question answering "
    "over local healthcare data."
)
NOTES_LABEL = "Data interpretation notes: "

# ---- fixed values: lines of the text handed to a SQL writer -----------------
PROMPT_MANY_HEADER = (
    "Generate a single read-only DuckDB SQL query from these retrieved dataset candidates."
)
PROMPT_DIALECT = "DuckDB"
PROMPT_ONE_HEADER = "Generate a single read-only DuckDB SQL query from this context."
PROMPT_REQUIREMENTS = (
    "Requirements:",
    "- Use exactly one SELECT query.",
    "- Use only one candidate dataset and only that candidate's table and columns.",
    '- Always use double quotes around table names and column names, for example: SELECT "treatment" FROM "mental_health_survey".',
    "- Decide whether the suggested candidate and suggested mode are correct. You may keep them or replace them with a better candidate and final mode.",
    "- Solve both parts of the request: which rows should match, and which columns should be returned.",
    "- If the user asks for a specific field such as side effects, warnings, treatment, country, or one aggregate, return only that field or those fields unless the question explicitly asks for the full record.",
    "- In focused_filter mode, avoid SELECT * unless the user explicitly asks for all information, a full profile, or all columns.",
    "- If data interpretation notes describe special matching behavior, follow them. For example, if a field combines a name with a dose, prefer matching the name appropriately rather than requiring an exact full-value match unless the user supplied the exact full value.",
    "- Return all necessary matching rows by default. Use LIMIT only when the user explicitly asks for a preview, sample, first N rows, or top N results.",
    "- Do not silently truncate healthcare-relevant results.",
    "- For aggregate questions, use COUNT, AVG, MIN, MAX, SUM, or GROUP BY only when appropriate.",
    "- For broad_aggregate questions, combine broad schema coverage with aggregate expressions such as AVG(...) across the available columns.",
    "- Prefer direct column matches from the schema over indirect inference from loosely related columns.",
    "- For broad profile questions, prefer returning the matching full profile from the same table.",
    "- Assume boolean symptom columns use 1/0 or true/false matching as needed in DuckDB.",
    "- Return chosen_candidate_index as the candidate number you selected.",
    "- Return chosen_dataset_name for the candidate you selected.",
    "- Fill selected_columns_used with the columns actually referenced in the SQL.",
    "- Set scope to focused_schema, broad_schema, or full_schema depending on how much schema coverage the query needs.",
)
