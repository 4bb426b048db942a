"""Private text about the living, minors and the withheld. Headings and labels that nothing allows go."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import notes as N
from . import text as T

#: Patterns that deletion takes out, in order; streets only of the living.
MAIL = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"
MOBILE = r"(?:\+?61[ .-]?)?0?4[ .-]?[0-9]{2}[ .-]?[0-9]{3}[ .-]?[0-9]{3}\b"
LANDLINE = r"(?:\+?61[ .-]?)?0[23578][ .-]?[0-9]{4}[ .-]?[0-9]{4}\b"
HEALTH_ID = r"\b[2-6][0-9]{3} ?[0-9]{5} ?[0-9]\b"
PO_BOX = r"(?i)(?:PO|Post Office) *Box +[0-9]+"
STREET = r"\b[0-9]{1,4} [A-Z][A-Za-z']+(?: [A-Z][A-Za-z']+)* (?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Crescent|Cres|Highway|Hwy|Close|Way)\b"
LABELS = r"(?i)^\s*(?:- )?\*\*(?:Email|Phone|Mobile|Telephone|Fax|Contact|Address|(?:Postal|Street|Residential) Address):\*\*[`()\s,;:]*$"
#: Headings that stand for themselves, those that a dash and more may follow, labels of private lines, and platforms.
KEPT_HEADINGS = r"(?i)^(?:family|families|relationships?|photos?|gallery|media|(?:marriage|divorce)(?: certificate)?(?:\s*[—–:-].*)?|(?:baptism|christening|wedding)(?:\s*[—–:-].*)?)\s*$"
FIELDS = r"(?i)^\s*(?:- )?(?:\*\*\s*)?(?:residence|resides|lives?|lived|location|(?:postal )?address|education|school|college|occupation|employer|workplace|health|nickname|contact|phone|mobile|e-?mail|website|facebook|instagram|linkedin|twitter)\b[^:|]*:"
MINOR_LINES = r"(?i)^\s*(?:[-*+] )?\*\*\s*(?:school|college|occupation|job|work|employer|workplace|residence|resides|lives|address)\b|\b(?:attends|studies|works)\b.*\b(?:school|college|university)\b"
ADDRESS_LINES = r"(?i)^\s*(?:[-*+] )?(?:\*\*\s*(?:postal )?address\b|address\s*:)"
PLATFORMS = "TikTok|Facebook|Instagram|Twitter|LinkedIn|Snapchat|Reddit|Pinterest"
SOCIAL_URL = rf"(?i)https?://[^\s)]*(?:{PLATFORMS})\.[^\s)]*"
HANDLE = r"(?<![A-Za-z0-9._-])@[A-Za-z0-9._]{3,}\b"
CREDIT = rf"(?i)\b(?:source|via|posted on|post by)\b:?[^.]*\b(?:{PLATFORMS})\b[^.]*\.?"


def deleted(text: Column, streets: Column) -> Column:
    """text without private values, labels that then stand alone, comments and the white space left over; streets: whether they go, too."""
    out = text
    for pattern in (MAIL, MOBILE, LANDLINE, HEALTH_ID, PO_BOX):
        out = F.regexp_replace(out, pattern, "")
    out = F.when(streets, F.regexp_replace(out, STREET, "")).otherwise(out)
    out = F.array_join(F.filter(F.split(out, "\n"), lambda x: ~x.rlike(LABELS)), "\n")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->\s*\n?", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+(\n|$)", "$1"), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def without_credit(line: Column) -> Column:
    """A line without what credits a social account; a line without any stays as it is, to the byte."""
    some = line.rlike(SOCIAL_URL) | line.rlike(HANDLE) | line.rlike(CREDIT)
    out = F.regexp_replace(line, rf"(?i)\[[^\]]*\]\({SOCIAL_URL[4:]}\)", "")
    for pattern in (SOCIAL_URL, CREDIT, rf"(?i)\([^)]*\b(?:{PLATFORMS})\b[^)]*\)", HANDLE):
        out = F.regexp_replace(out, pattern, "")
    tidy = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"\(\s*\)", ""), r"[ \t]{2,}", " "), r"\s+([.,;])", "$1"))
    return F.when(some, tidy).otherwise(line)


def living_body(text: Column, allowed: Column | None = None) -> Column:
    """What may be shown of somebody who may be living: the text before the first section and the sections of KEPT_HEADINGS, or of allowed (an array of headings) for this row, without field lines and credits."""
    parts = F.split(text, r"(?m)^## ")
    title = lambda p: F.trim(F.regexp_extract(p, r"^([^\n]*)", 1))
    extra = (lambda p: F.array_contains(allowed, title(p))) if allowed is not None else (lambda p: F.lit(False))
    kept = F.filter(F.slice(parts, 2, F.size(parts)), lambda p: title(p).rlike(KEPT_HEADINGS) | extra(p))
    whole = F.concat(parts[0], F.array_join(F.transform(kept, lambda p: F.concat(F.lit("## "), p)), ""))
    rows = F.transform(F.filter(F.split(whole, "\n"), lambda x: ~x.rlike(FIELDS)), without_credit)
    return F.regexp_replace(F.regexp_replace(F.array_join(rows, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def guarded_minor(text: Column, birth: Column, as_of: Column, age: int = 18) -> Column:
    """Of those under age in the year as_of: without lines on schools, work and homes."""
    return F.when(as_of - birth < age, T.without_lines(text, MINOR_LINES)).otherwise(text)


def guarded_address(text: Column, is_living: Column) -> Column:
    return F.when(is_living, T.without_lines(text, ADDRESS_LINES)).otherwise(text)


def with_public_role(shown: Column, text: Column, allowed: Column) -> Column:
    """shown, and after it the section '## Public Role' of text where allowed says so; refused whole if it has a private field or a handle."""
    own = N.section(text, "Public Role")
    safe = (own != "") & ~own.rlike("(?im)" + FIELDS[4:]) & ~own.rlike(HANDLE)
    return F.when(allowed & safe, F.concat(shown, F.lit("\n\n## Public Role\n"), F.trim(own))).otherwise(shown)


def without_sections(text: Column, titles: list[str]) -> Column:
    """text without the sections of these titles."""
    parts = F.split(text, r"(?m)^## ")
    kept = F.filter(F.slice(parts, 2, F.size(parts)), lambda p: ~F.lower(F.trim(F.regexp_extract(p, r"^([^\n]*)", 1))).isin([t.lower() for t in titles]))
    return F.concat(parts[0], F.array_join(F.transform(kept, lambda p: F.concat(F.lit("## "), p)), ""))


def rewritten(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Patterns in order, each replaced by its words."""
    for pattern, words in rules:
        text = F.regexp_replace(text, pattern, words)
    return text


def audited(text: Column, benign: list[str], patterns: list[tuple[str, str]]) -> Column:
    """Names of the patterns that text still has once benign shapes are masked."""
    masked = text
    for p in benign:
        masked = F.regexp_replace(masked, p, " ")
    return F.array_compact(F.array(*[F.when(masked.rlike(p), F.lit(name)) for name, p in patterns]))


def _quoted(words: list[str]) -> str:
    return "|".join("\\Q" + w.replace("\\E", "") + "\\E" for w in sorted(set(words), key=lambda w: (-len(w), w)))


def names_withheld(text: Column, names: list[str], phrase: str = "a relative whose own record is withheld") -> Column:
    """text without the names in a parameter list: full names, whatever stands between first and last, and runs of two or more of their first names; a lone first name stays."""
    parts = [n.split() for n in names if len(n.split()) >= 2]
    if not parts:
        return text
    first = _quoted([p[0] for p in parts])
    runs = rf"\b(?:{first})\b(?:\s*(?:,|&|\band\b)\s*(?:{first})\b)+"
    full = "|".join(rf"\Q{a}\E(?:\s+[A-Z][\w'’-]*)*?\s+\Q{b}\E" for a, b in sorted({(p[0], p[-1]) for p in parts}))
    out = F.regexp_replace(F.regexp_replace(text, runs, phrase), rf"\b(?:{full})\b", phrase)
    return F.trim(F.regexp_replace(F.regexp_replace(out, rf"{phrase}(?:,? (?:and |& )?{phrase})+", phrase), r"[ \t]{2,}", " "))


def shown_reference(name: Column, slug: Column, withheld: Column, relation: Column) -> Column:
    """(slug, plain_name, withheld) of a reference: withheld ones and those that lead nowhere are names alone, a spouse without a row says so."""
    plain = F.when(withheld, name).when(slug.isNull(), F.when(relation == "spouse", F.concat(name, F.lit(" (no profile)"))).otherwise(name))
    return F.struct(F.when(~withheld, slug).alias("slug"), plain.alias("plain_name"), withheld.alias("withheld"))
