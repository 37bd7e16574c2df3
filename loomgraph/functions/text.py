"""Column expressions on text that behave alike on every engine and for every script.

White space follows the Unicode property (Java's ``\\s`` and ``trim`` only know ASCII).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space plus the ASCII separators FS..US, as in Python's ``str.isspace``.
SPACE = r"\s\p{Z}\x{85}\x1c-\x1f"
WORD = r"[\p{L}\p{N}_]+"
#: What names are joined by: runs of ASCII letters and digits, and any other letter or digit alone, so
#: that names in scripts without blanks are found as well.
TOKEN = r"[a-z0-9]+|[\p{L}\p{N}&&[^\x00-\x7F]]"
SENTENCE_GAP = rf"(?<=[.!?])[{SPACE}]+"
#: Line ends of ``str.splitlines``.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(col: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def squeeze(col: Column) -> Column:
    """Runs of white space as one blank."""
    return F.regexp_replace(col, rf"[{SPACE}]+", " ")


def key(col: Column) -> Column:
    """A key as it is compared: stripped, lower case; blank becomes null."""
    clean = F.lower(strip(col))
    return F.when(clean != "", clean)


def slug(col: Column, glue: str = "_") -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as ``glue``, none at the ends."""
    body = F.regexp_replace(F.lower(col), "[^a-z0-9]+", glue)
    return F.regexp_replace(body, f"^{glue}+|{glue}+$", "")


def sentences(col: Column) -> Column:
    """Sentences in order, stripped, without blank ones."""
    return F.filter(F.transform(F.split(col, SENTENCE_GAP), strip), lambda s: s != "")


def words(col: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(col, rf"[{SPACE}]+"), lambda s: s != "")


def tokens(col: Column) -> Column:
    """Tokens of a text in lower case, as array<string>."""
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN), F.lit(0))


def token_runs(tokens_col: Column, lengths: list[int]) -> Column:
    """Distinct runs of so many tokens, one blank apart. ``tokens_col`` should be a plain column:
    inside a lambda an expression is computed for each element."""
    at = F.sequence(F.lit(1), F.greatest(F.size(tokens_col), F.lit(1)))
    runs = F.flatten(F.transform(at, lambda i: F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.array_join(F.slice(tokens_col, i, n), " "))))
    return F.array_distinct(runs)


def literal_regex(col: Column) -> Column:
    """A column of literals as Java regexes; a blank stands for any white space."""
    escaped = F.regexp_replace(col, r"([^\p{L}\p{N}\s_])", r"\\$1")
    return F.regexp_replace(escaped, r"\s+", r"\\s+")


def bounded(literal_regex: str) -> str:
    """A regex that must not touch ASCII letters or digits on either side."""
    return rf"(?<![a-zA-Z0-9])(?:{literal_regex})(?![a-zA-Z0-9])"


def quote(literal: str) -> str:
    """``literal`` as a regex for Java, Python and RE2 alike."""
    return "".join(c if c.isalnum() or c in "_ " or ord(c) > 127 else "\\" + c for c in literal)


def title_words(col: Column) -> Column:
    """Every run of letters capitalised, as ``str.title`` does for ASCII."""
    lowered = F.lower(col)
    parts = F.regexp_extract_all(lowered, F.lit(r"([a-z]+|[^a-z]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.initcap(p)), "")
