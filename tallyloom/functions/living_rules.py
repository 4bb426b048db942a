"""Lines that tell where a living person lives, works or can be reached."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules in order, the first that a line meets counts; lines that are let through; names of notes whose person has died; names that are looked at all the same.
RULES = [
    ("RESIDENCE-FIELD", r"(?i)^\*\*(?:Residence|Location)\s*:"),
    ("EMPLOYER-FIELD", r"(?i)^\*\*(?:Occupation|Employer|Work|Employment)\s*:"),
    ("SCHOOL-FIELD", r"(?i)^\*\*(?:Education|School|Schooling)\s*:"),
    ("SOCIAL-FIELD", r"(?i)^\*\*(?:Facebook|LinkedIn|Instagram)\s*:"),
    ("SOCIAL-URL", r"(?i)(?:facebook|instagram|linkedin)\.com"),
    ("SOCIAL-PROSE", r"(?i)\b(?:per Facebook|on Facebook|joined Facebook|Facebook profile|relationship status)\b"),
    ("FB-SECTION", r"(?i)^##\s*Source — Facebook Lead"),
    ("ADDRESS-LABEL", r"(?i)^\*\*Address\s*:"),
    ("STREET-ADDR", r"\b\d{1,4}[A-Za-z]?\s+[A-Z][a-z]+(?:\s[A-Z][a-z]+)?\s+(?:Rd|Road|St|Street|Ave|Avenue|Dr|Drive|Ct|Court|Cres|Pde|Parade|Ln|Way|Tce|Hwy|Pl)\b"),
    ("POSTCODE", r"\b(?:QLD|NSW|VIC|SA|WA|TAS|NT|ACT)\s?\d{4}\b"),
    ("RESIDENCE-PROSE", r"\b(?:lives?|resides?|residing)\s+in\s+[A-Z][a-z]+"),
    ("WORKS-PROSE", r"\bworks?\s+(?:for|at)\s+[A-Z]"),
    ("PHONE", r"\b(?:\+61|0[45])\d[\d\s\-]{7,}\b"),
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("CONTACT-LABEL", r"(?i)^\*\*(?:Email|Contact|Phone|Mobile|Tel)\s*:"),
]
ALLOWED = [
    r"m\.\s*\d{1,2}\s+\w+\s+\d{4}",
    r"(?i)Married (?:at|on)",
    r"(?i)Baptized|Baptised",
    r"(?i)Reg(?:istered)?\.?\s*No",
    r"(?i)(?:Church of Christ|Baptist Church|Church of England|St Mary|Chapel|Cathedral|Cemetery)",
    r"^\*\*Born\b|^\*\*Birthplace\b|^\*\*Spouse",
    r"(?i)^#+\s*(?:Marriage|Baptism|Birth)",
    r"(?i)Postcode.*(?:source|record|certificate)",
    r"https?://",
    r"(?i)^\s*-\s*\*\*Source\b",
]
DIED = [
    r"\(\s*~?\d{3,4}\s*[–\-—]\s*~?\d{3,4}\s*\)",
    r"\(\s*~?\d{3,4}\s*\)\s*\.md$",
    r"(?i)\(b\.\s*~?\d{3,4}",
    r"\(\s*of\s+[A-Z]",
    r"\b(?:18|19)\d{2}\s*[–\-—]\s*[A-Z]",
]
FORCED = r"(?i)\(\d{4}[–\-—]\?\)|\(\?–living\)|\?–living"

LET_THROUGH = "|".join(f"(?:{p})" for p in ALLOWED)
DEAD_NAME = "|".join(f"(?:{p})" for p in DIED)


def to_check(file_name: Column) -> Column:
    """Whether a note is of someone who may be living, as far as its name tells."""
    return ~F.coalesce(file_name.rlike(DEAD_NAME), F.lit(False)) | F.coalesce(file_name.rlike(FORCED), F.lit(False))
