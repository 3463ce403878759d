"""Token counts by the public word-or-symbol rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rule \w+|[^\w\s]+ spelled out by Unicode category, so that it
# means the same in every regex engine.
WORD = r"\p{L}\p{N}_"
SPACE = r"\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}"
TOKEN = rf"[{WORD}]+|[^{WORD}{SPACE}]+"
TOKEN_RE2 = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]+"


def token_count(text: Column) -> Column:
    """Runs of letters, digits or underscores, and runs of other characters without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")
