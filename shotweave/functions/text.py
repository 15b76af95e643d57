"""String rules shared by the augmentation, scoring and diversity operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The English stop-word list used by the word-edit augmenter
# (synonym replacement skips these words). It must equal the list the
# reference uses, in its natural order, including the trailing empty string.
# ---------------------------------------------------------------------------
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your",
    "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she",
    "her", "hers", "herself", "it", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of",
    "at", "by", "for", "with", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "to", "from", "up", "down",
    "in", "out", "on", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "any",
    "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can",
    "will", "just", "don", "should", "now", "",
]

# Characters the cleaner deletes, and those it turns into a space
# before the a-z filter.
DELETED_CHARS = "’'"
SPACED_CHARS = "-\t\n"
TOKEN_LIMIT = 50  # scorer token truncation


def clean_chars(text: Column) -> Column:
    """Lower-case a-z and single spaces; one leading space dropped, a trailing one kept.

    Same result as the five-step rule (delete ``’'``; ``-``/tab/newline to space;
    lower; other non a-z to space; collapse spaces): every maximal run of
    characters outside a-z becomes one space, so one pass does steps 2, 4 and 5.
    """
    s = F.regexp_replace(F.lower(F.translate(text, "’'", "")), "[^a-z]+", " ")
    return F.regexp_replace(s, "^ ", "")


def words_of(cleaned: Column) -> Column:
    """Non-empty space-separated words of an already cleaned string."""
    return F.filter(F.split(cleaned, " "), lambda w: w != "")


def regex_tokens(text: Column, limit: int = TOKEN_LIMIT) -> Column:
    """Lower-cased a-z runs, first ``limit`` of them (scorer tokens)."""
    toks = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)
    return F.slice(toks, 1, limit) if limit else toks


def stop_words_col() -> Column:
    return F.array(*[F.lit(w) for w in STOP_WORDS])


# SQL text of the same rules, used by the DuckDB oracles.
CLEAN_SQL = ("regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace("
             "regexp_replace({x}, '[’'']', '', 'g'), '[-\\t\\n]', ' ', 'g')), "
             "'[^a-z ]', ' ', 'g'), ' +', ' ', 'g'), '^ ', '')")

# The ASCII whitespace a Python-style strip removes.
STRIPPED = " \t\n\r\f\v"
_WS = "[ \\t\\n\\r\\f\\x0B]"


def py_strip(text: Column) -> Column:
    """Strip leading/trailing ASCII whitespace (Spark ``trim`` only removes spaces)."""
    return F.regexp_replace(text, f"^{_WS}+|{_WS}+$", "")


STRIP_SQL = "regexp_replace({x}, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g')"
