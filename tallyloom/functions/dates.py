"""Years, dates, lifespans, and the plausibility of relations. A missing date is no evidence: it never fails a test."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_of(text: Column) -> Column:
    """'~1890', 'c. 1890', 'approx 1890', '1890' as an int; whatever isn't a number is null."""
    return F.regexp_replace(F.lower(F.trim(text)), r"^(~|c\.|ca\.|circa|approx\.?|about)\s*", "").try_cast("int")


def is_approximate(text: Column) -> Column:
    return F.lower(F.trim(text)).rlike(r"^(~|c\.|ca\.|circa|approx|about)")


def date_of(text: Column) -> Column:
    """ISO dates and '5 March 1890' as dates; anything else, impossible days included, is null."""
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    spoken = F.when(text.rlike(r"^\d{1,2} [A-Z][a-z]+ \d{4}$"), F.try_to_timestamp(text, F.lit("d MMMM yyyy")))
    return F.coalesce(iso, spoken).cast("date")


def span_years(ref: Column) -> Column:
    """(birth, death) from '(1850–1900)', '(b. 1850)', '(bap. 1850)', '(d. 1900)', '(1850)'; '(m. 1870)' is neither."""
    get = lambda p: F.nullif(F.regexp_extract(ref, p, 1), F.lit("")).try_cast("int")
    birth = F.coalesce(get(r"\((\d{4})\s*[–-]"), get(r"(?i)\b(?:b|bap|bapt)\.\s*(\d{4})"), get(r"\((\d{4})\)"))
    death = F.coalesce(get(r"[–-]\s*(\d{4})\)"), get(r"(?i)\bd\.\s*(\d{4})"))
    return F.struct(birth.alias("birth"), death.alias("death"))


def ref_years(ref: Column) -> Column:
    """(birth, death, marriage) as a reference states them: '(m. 1870)' is a marriage and nothing else; then '(b. & d. 1882)', a lifespan, a baptism, a single year, approximate or not."""
    get = lambda p, k=1: F.nullif(F.regexp_extract(ref, p, k), F.lit("")).try_cast("int")
    about = r"\(\s*(?:(?:b|c|ca|abt)\.?\s*|about\s*|~\s*)*"
    span = about + r"([0-9]{4})\s*[–-]\s*([0-9]{4}|living|\?)"
    marriage = get(r"(?i)\(\s*m\.?\s*([0-9]{4})")
    both = get(r"(?i)\(\s*b\.?\s*&\s*d\.?\s*([0-9]{4})\s*\)")
    birth = F.coalesce(both, get("(?i)" + span), get(r"(?i)\(\s*(?:bap|bapt|baptised|baptized)\.?\s*(?:~|c\.)?\s*([0-9]{4})\b"), get("(?i)" + about + r"([0-9]{4})\b"))
    death = F.coalesce(both, get("(?i)" + span, 2))
    return F.struct(F.when(marriage.isNull(), birth).alias("birth"), F.when(marriage.isNull(), death).alias("death"), marriage.alias("marriage"))


def without_lifespan(name: Column) -> Column:
    """Brackets that hold a lifespan or '(fl. 1998)' go; other brackets stay."""
    out = F.regexp_replace(name, r"(?i)\s*\(~?[0-9]{4}\s*[–-]\s*(?:[0-9]{4}|living|\?)?\s*\)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?i)\s*\(fl\.?\s*[0-9]{3,4}\)", " "), r"\s+", " "))


def bare_name(ref: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(ref, r"\([^)]*\)", " "), r"\s+", " "))


def lifespan(birth: Column, death: Column, is_living: Column) -> Column:
    text = lambda c: c.cast("string")
    return F.when(is_living & birth.isNotNull(), F.concat(F.lit("b. "), text(birth))).when(birth.isNull() & (death.isNull() | is_living), "Dates unknown").when(death.isNull(), F.concat(F.lit("b. "), text(birth))).when(birth.isNull(), F.concat(F.lit("d. "), text(death))).otherwise(F.concat(text(birth), F.lit("–"), text(death)))


def decade(year: Column) -> Column:
    return F.when(year.isNull(), "Unknown").when(year < 1800, "Before 1800").otherwise(F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s")))


def generation_by_year(birth: Column, root: int) -> Column:
    """Thirty years a generation, from 1; 99 without a year."""
    return F.when(birth.isNull(), 99).otherwise(F.greatest(F.lit(1), F.round((birth - root) / 30).cast("int") + 1))


@dataclass(frozen=True)
class Gate:
    """Limits of age gaps; None: no limit."""

    parent_least: int | None = 11
    parent_most: int | None = None
    spouse: int | None = 50
    sibling: int | None = 40
    posthumous: int | None = 0
    #: Where a child is judged by other limits than a parent.
    child_least: int | None = None
    child_most: int | None = None
    #: Whether spouses have to have lived at the same time.
    overlap: bool = False


#: One row for each use, since uses differ.
GATES = {
    "shared": Gate(11, 60, 50, 40, 0),
    "edge": Gate(11, 65, 55, None, None),
    "match": Gate(12, None, 50, None, None, -5, 55),
    "slug": Gate(11, 70, 70, None, 0, overlap=True),
    "render": Gate(10, 60, None, None, 1),
    "verify": Gate(-8, 62, None, None, None),
}


def plausible(relation: Column, birth: Column, death: Column, other_birth: Column, other_death: Column, gate: Gate) -> Column:
    """Whether `other` may stand in `relation` to the subject (parent: other is the parent); unknown relations and dates pass."""

    def parent(b, d, child, least=gate.parent_least, most=gate.parent_most) -> Column:
        ok = F.lit(True)
        if least is not None:
            ok &= F.coalesce(child - b >= least, F.lit(True))
        if most is not None:
            ok &= F.coalesce(child - b <= most, F.lit(True))
        if gate.posthumous is not None:
            ok &= F.coalesce(child <= d + gate.posthumous, F.lit(True))
        return ok

    near = lambda most: F.lit(True) if most is None else F.coalesce(F.abs(birth - other_birth) <= most, F.lit(True))
    child = parent(birth, death, other_birth, gate.parent_least if gate.child_least is None else gate.child_least, gate.parent_most if gate.child_most is None else gate.child_most)
    together = F.coalesce(other_birth <= death, F.lit(True)) & F.coalesce(birth <= other_death, F.lit(True)) if gate.overlap else F.lit(True)
    tested = F.when(relation == "parent", parent(other_birth, other_death, birth)).when(relation == "child", child).when(relation == "spouse", near(gate.spouse) & together).when(relation == "sibling", near(gate.sibling))
    return F.coalesce(tested, F.lit(True))


MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def date_shown(text: Column) -> Column:
    """'5 March 1890' from '1890-03-05' or '05 march 1890', for any day from 1 to 31, as notes have such days; approximate dates and bare years are null."""
    t = F.trim(text)
    iso, said = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", r"^([0-9]{1,2})\s+([A-Za-z]+)\s+([0-9]{4})$"
    names = F.array(*map(F.lit, MONTHS))
    part = lambda p, k: F.regexp_extract(t, p, k)
    number = part(iso, 2).try_cast("int")
    month = F.when(t.rlike(iso), F.when(number.between(1, 12), F.element_at(names, F.greatest(F.lit(1), F.least(F.lit(12), F.coalesce(number, F.lit(1))))))).otherwise(F.get(F.filter(names, lambda m: F.lower(m) == F.lower(part(said, 2))), F.lit(0)))
    day = F.when(t.rlike(iso), part(iso, 3)).otherwise(part(said, 1)).try_cast("int")
    year = F.when(t.rlike(iso), part(iso, 1)).otherwise(part(said, 3))
    return F.when((t.rlike(iso) | t.rlike(said)) & day.between(1, 31) & month.isNotNull(), F.concat_ws(" ", day.cast("string"), month, year))


def split_display(text: Column) -> Column:
    """(birth, death) of '1850–1900', 'b. 1850', 'd. 1900' or '1850', as they are written; null where nothing is."""
    get = lambda p: F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit(""))
    return F.struct(F.coalesce(get(r"^\s*([^–-]*[0-9][^–-]*)\s*[–-]"), get(r"(?i)^\s*b\.\s*(\S+)"), get(r"^\s*(~?[0-9]{4})\s*$")).alias("birth"), F.coalesce(get(r"[–-]\s*(.*[0-9].*)$"), get(r"(?i)^\s*d\.\s*(\S+)")).alias("death"))


def birth_of(birth: Column, title: Column) -> Column:
    """The recorded birth, else the one in a title: '(b. 1850)' or '(1850–'."""
    return F.coalesce(birth, F.nullif(F.regexp_extract(title, r"(?i)\((?:b\.\s*)?~?([0-9]{4})(?:\s*[–-]|\))", 1), F.lit("")).try_cast("int"))
