"""Redaction of private text by ordered patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (name, pattern); the patterns hold in Java and in RE2.
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("social", r"https?://(?:www\.)?(?:facebook|instagram|linkedin|twitter)\.com/[^\s)]*"),
    ("ip", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("po_box", r"(?i)\bP\.?\s?O\.?\s?Box\s+[0-9]+"),
    ("street", r"\b[0-9]{1,5} [A-Z][a-z]+ (?:Street|St|Road|Rd|Avenue|Ave|Lane|Drive)\b"),
    ("phone", r"\+?[0-9]{1,3}[ -]?\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}\b"),
    ("long_number", r"\b[0-9]{13,19}\b"),
)


def placeholders(text: Column, patterns=PATTERNS) -> Column:
    """Each match as [name]."""
    for name, pattern in patterns:
        text = F.regexp_replace(text, pattern, f"[{name}]")
    return text


def deleted(text: Column, patterns=PATTERNS) -> Column:
    """Matches gone, and blanks left over with them."""
    for _, pattern in patterns:
        text = F.regexp_replace(text, pattern, "")
    return F.trim(F.regexp_replace(text, "[ \t]+", " "))


def for_living(text: Column, is_living: Column, patterns=PATTERNS) -> Column:
    """Everything for those who may be living; the rest keep streets."""
    return F.when(is_living, placeholders(text, patterns)).otherwise(placeholders(text, [p for p in patterns if p[0] != "street"]))


def names_scrubbed(text: Column, names: list[str], phrase: str = "a private person") -> Column:
    """names: a parameter list of the withheld, as one pattern in which longer names go first."""
    known = sorted({n for n in names if n}, key=lambda n: (-len(n), n))
    return F.regexp_replace(text, "|".join("\\Q" + n.replace("\\E", "") + "\\E" for n in known), phrase) if known else text


def counts(text: Column, patterns=PATTERNS) -> list[Column]:
    return [F.regexp_count(text, F.lit(p)).cast("long").alias(f"n_{name}") for name, p in patterns]
