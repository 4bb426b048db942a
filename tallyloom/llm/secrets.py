"""Secret scans by a trigram inverted index, in DataFrame operations only.

Each rule's regular expression yields a Boolean query of trigrams that every
match contains. The index, a stored table, holds postings: one row for each
document and each trigram that some query names. A rule's candidates are the documents whose
postings meet one of the ANDs of its query; those are verified with the
expression itself. Rules without a mandatory trigram are run over all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, typed, written
from .trigram_query import ANY, Query, trigram_query


@dataclass(frozen=True)
class Rule:
    """pattern is Java's and Python's; a match counts if its group (0: all of it) has least characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    def query(self) -> Query:
        return trigram_query(self.pattern)


BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a run that is too short has no longer one inside, so the length may stand in the pattern
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: The public formats of some providers' keys.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES
#: A key from its BEGIN line through its END line or, where that is missing, to the end of the base64 lines.
WHOLE_KEY = Rule("private_key", MORE_RULES[0].pattern + r"(?:[A-Za-z0-9+/=\s\\:,-]*?-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:(?:[\s\\]{1,4}[A-Za-z0-9+/]{16,}={0,2}){1,1000}(?:\r?\n[A-Za-z0-9+/]{1,15}={0,2}(?:\r?\n|$))?)?)")
#: What redact() replaces; the spans that secret_digest() lists have the BEGIN line only.
REDACTED_RULES = tuple(WHOLE_KEY if r.kind == "private_key" else r for r in RULES)
SPANS = "array<struct<start:int,number:int,end:int,kind:string>>"
#: Matches that are put together at a time; runs of so many are then joined, so that a text with many matches isn't copied for each.
TOGETHER = 256


def queries(rules: tuple[Rule, ...]) -> dict[str, list[list[str]]]:
    """kind: the ANDs of its query; rules that need a full scan are left out."""
    return {r.kind: sorted(map(sorted, r.query())) for r in rules if r.query() != ANY}


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id), each once, of the given trigrams in the lower-cased texts of docs (doc_id, text). Written once, they answer for all rules whose trigrams are among those."""
    low = typed(docs, ("doc_id", "long"), ("text", "string")).select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams]))).alias("trigram")).distinct()


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, mask): bit i is set if the document's postings meet the query of rules[i]."""
    asked = queries(rules)
    rows = [(i, n, t, len(all_of)) for i, r in enumerate(rules) for n, all_of in enumerate(asked.get(r.kind, [])) for t in all_of]
    terms = index.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(n).alias("term"), F.lit(t).alias("trigram"), F.lit(k).alias("needs")) for i, n, t, k in rows])))
    # the terms are those of the rules, a few dozen rows
    met = index.join(F.broadcast(terms), "trigram").groupBy("doc_id", "rule", "term", "needs").agg(F.count("*").alias("n")).where("n = needs")
    return met.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("mask"))


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, end, kind) of the rule's matches in text, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    steps = F.zip_with(F.zip_with(found, group, lambda m, g: F.struct(F.length(m).alias("size"), F.length(g).alias("inner"))), F.slice(between, 1, F.size(found)), lambda m, b: F.struct(F.length(b).alias("skip"), m.size.alias("size"), m.inner.alias("inner")))
    none = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        first = acc.at + x.skip
        this = F.struct(first.alias("start"), F.lit(number).alias("number"), (first + x["size"]).alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct((first + x["size"]).alias("at"), F.when(x.inner >= rule.least, F.concat(acc.out, F.array(this))).otherwise(acc.out).alias("out"))

    def run(acc: Column, part: Column) -> Column:
        own = F.aggregate(part, F.struct(acc.at.alias("at"), none.alias("out")), step)
        return F.struct(own.at.alias("at"), F.concat(acc.out, F.array(own.out)).alias("out"))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / TOGETHER).cast("int")), lambda i: F.slice(steps, i * TOGETHER + 1, TOGETHER))
    whole = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out")), run, lambda acc: F.flatten(acc.out))
    return F.when(text.rlike(rule.pattern), whole).otherwise(none)


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, whole_rows: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, text, found, an array of (start, number, end, kind) by start, then in the order of rules; with whole_rows also row, a struct of all its columns as they are.

    Null texts count as empty: found is empty. Rows that repeat a doc_id are
    verified each by itself; a null doc_id is as good as any. An empty table
    gives an empty result. Matches of a rule don't overlap; those of different
    rules may. Columns beyond those two aren't looked at, whatever their names.

    The postings and the candidates are written. Texts are verified where they
    are read as long as the candidates' table is small enough for Spark to
    broadcast (spark.sql.autoBroadcastJoinThreshold); beyond that the texts are
    dealt by doc_id, once.
    """
    asked = queries(rules)
    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.coalesce(F.col("`text`").cast("string"), F.lit("")).alias("text"), *([F.struct("*").alias("row")] if whole_rows else []))
    mask = F.lit(0).cast("long")
    if asked:
        with released(docs.sparkSession):
            trigrams = sorted({t for ands in asked.values() for a in ands for t in a})
            met = written(candidates(written(build_index(docs, trigrams), "postings"), rules), "candidates", kept=True)
        met = met.toDF("of", "mask")
        rows = rows.join(met, rows.doc_id.eqNullSafe(met.of), "left").drop("of")
        mask = F.coalesce("mask", mask)
    text = F.col("text")
    arrays = []
    for i, r in enumerate(rules):
        spans = spans_of(text, r, i)
        arrays.append(F.when(mask.bitwiseAND(1 << i) != 0, spans).otherwise(F.array().cast(SPANS)) if r.kind in asked else spans)
    return rows.select("doc_id", "text", *(["row"] if whole_rows else []), F.array_sort(F.concat(*arrays)).alias("found"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    out = secret_spans(docs).select("doc_id", "found")
    base = F.filter("found", lambda x: x.number < len(BASE_RULES))
    count = lambda kind: F.size(F.filter("found", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = REDACTED_RULES) -> DataFrame:
    """docs with every span of text replaced by [kind]; overlapping spans go together, under the first one's kind.

    All other columns stay as they are, whatever their names and types, except
    n_chars, which is counted anew where text changes. Null and empty texts stay
    null and empty, and an empty table empty; rows that repeat a doc_id, or have
    none, are redacted each by itself.
    """
    out = secret_spans(docs, rules, whole_rows=True)

    def step(acc: Column, x: Column) -> Column:
        apart = x.start >= acc.at
        piece = F.concat(F.substring("text", acc.at + 1, x.start - acc.at), F.lit("["), x.kind, F.lit("]"))
        return F.struct(F.greatest(acc.at, x.end).alias("at"), F.when(apart, F.concat(acc.out, F.array(piece))).otherwise(acc.out).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate("found", start, step, lambda acc: F.concat(F.array_join(acc.out, ""), F.substring("text", acc.at + 1, F.length("text"))))
    out = out.select("row", "found", F.when(F.size("found") > 0, clean).alias("clean"))
    value = {"text": F.coalesce("clean", F.col("row.text")), "n_chars": F.coalesce(F.length("clean"), F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[(value[c].cast(docs.schema[c].dataType) if c in value else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
