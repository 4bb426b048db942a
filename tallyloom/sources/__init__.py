"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import versions


def _plain(name: Column) -> Column:
    """A path as it is written; Spark's metadata has it with codes."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """(file, raw, fields, body) of a folder of markdown notes; index files are left out."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select(_plain(F.col("_metadata.file_name")).alias("file"), F.col("value").alias("raw"))
    return raw.where(~F.lower("file").isin("index.md", "readme.md")).select("file", "raw", T.front_matter(F.col("raw")).alias("fields"), T.body(F.col("raw")).alias("body"))


def json_rows(spark: SparkSession, path: str, schema: str, wrappers: tuple[str, ...] = ("people", "profiles")) -> DataFrame:
    """Rows of a JSON file that is an array, or an object with the array under one of the wrappers; a file without rows is an error."""
    raw = spark.read.text(path, wholetext=True)
    array = f"array<struct<{schema}>>"
    wrapped = F.from_json("value", f"struct<{', '.join(f'{w}: {array}' for w in wrappers)}>")
    plain = F.when(F.ltrim("value").startswith("["), F.from_json("value", array))
    rows = raw.select(F.coalesce(*[wrapped[w] for w in wrappers], plain).alias("rows")).select(F.inline("rows"))
    if rows.isEmpty():
        raise ValueError(f"{path} has no rows")
    return rows


def sitemap(spark: SparkSession, path: str, most_levels: int = 5) -> DataFrame:
    """(loc, lastmod) of sitemap files, each place once, with its latest date; the files that an index names are read in its place."""
    tag = lambda name: F.trim(F.regexp_extract("u", rf"(?s)<{name}>(.*?)</{name}>", 1))
    found, paths = None, [path]
    for _ in range(most_levels):
        raw = spark.read.text(paths, wholetext=True)
        own = raw.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))).alias("u")).select(tag("loc").alias("loc"), F.try_to_timestamp(F.nullif(tag("lastmod"), F.lit(""))).alias("lastmod"))
        found = own if found is None else found.unionByName(own)
        # an index names files, a few thousand at most by the format's own limit
        paths = sorted({r.loc for r in raw.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<sitemap>(.*?)</sitemap>"), F.lit(1))).alias("u")).select(tag("loc").alias("loc")).collect()})
        if not paths:
            return found.groupBy("loc").agg(F.max("lastmod").alias("lastmod"))
    raise ValueError(f"{path} leads through more than {most_levels} indexes")


def version_log(spark: SparkSession, path: str, mark: str = "commit ") -> DataFrame:
    """(file, first_date) from a log whose records begin with mark, then a date, and name files in the lines after it; each file with its earliest date."""
    records = spark.read.text(path, lineSep=mark).select(F.split("value", r"\r?\n").alias("lines"))
    rows = records.select(F.expr("try_to_timestamp(regexp_extract(lines[0], '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1))").cast("date").alias("date"), F.explode(F.slice("lines", 2, F.size("lines"))).alias("file"))
    return rows.where("date is not null and trim(file) <> ''").groupBy(F.trim("file").alias("file")).agg(F.min("date").alias("first_date"))


def trees(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(id, title, body, lines, people_refs) of the tree documents of these names."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select(F.regexp_replace(_plain(F.col("_metadata.file_name")), r"\.md$", "").alias("id"), F.col("value").alias("raw"))
    rows = raw.where(F.col("id").isin(names)).withColumn("body", T.body(F.col("raw")))
    title = F.coalesce(F.nullif(F.regexp_extract("body", r"(?m)^# (.*)$", 1), F.lit("")), F.col("id"))
    return rows.select("id", title.alias("title"), "body", F.split("body", r"\r?\n").alias("lines"), F.array_distinct(T.wikilinks(F.col("body"))).alias("people_refs"))


def note_titles(spark: SparkSession, folder: str, public: list[str], skipped: str) -> DataFrame:
    """(title) of the notes in the public folders of a vault, without those that match skipped; a folder that isn't listed is private."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select(_plain(F.col("_metadata.file_path")).alias("path"))
    inner = F.regexp_replace("path", rf"^.*\Q{folder.rstrip('/').split('://')[-1]}\E/", "")
    rows = rows.select(inner.alias("inner"))
    return rows.where(F.regexp_extract("inner", "^([^/]+)/", 1).isin(public) & ~F.col("inner").rlike(skipped)).select(F.regexp_extract("inner", r"([^/]+)\.md$", 1).alias("title"))


def version_at(spark: SparkSession, base: str, version: str) -> DataFrame:
    """A table as it was: base has a folder for each version."""
    return spark.read.parquet(f"{base.rstrip('/')}/{version}")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, sha256, md5, size) of binary files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return raw.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"), F.col("length").alias("size"))


def first_of(*sources: DataFrame) -> DataFrame:
    """The first source that has rows; none is an error, so that a check never passes blind."""
    for s in sources:
        if not s.isEmpty():
            return s
    raise ValueError("no source has rows")


def write(df: DataFrame, path: str, apply: bool = False, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> int:
    """Rows written and found again, or with apply=False those that would be. That fewer or more are found than were to be written is an error."""
    wanted = df.count()
    if not apply:
        return wanted
    before = 0
    if mode == "append":
        try:
            before = df.sparkSession.read.parquet(path).count()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    found = df.sparkSession.read.parquet(path).count() - before
    if found != wanted:
        raise ValueError(f"{path}: {wanted} rows were to be written, {found} are there")
    return found


def write_version(df: DataFrame, base: str, version: str, apply: bool = False) -> int:
    """A new version beside the earlier ones, which are its backup; an existing one is never written over."""
    return write(df, f"{base.rstrip('/')}/{version}", apply, mode="errorifexists")


def write_public(rows: DataFrame, columns: list[str], counts: dict[str, Column], path: str, apply: bool = False) -> DataFrame:
    """The listed columns of rows as a table, and one row of counts (name to condition) with the total beside it; returns the counts."""
    public = rows.select(*[c for c in columns if c in rows.columns])
    meta = rows.agg(F.count("*").alias("total"), *[F.count_if(c).alias(name) for name, c in counts.items()])
    if apply:
        write(public, f"{path.rstrip('/')}/rows", True)
        write(meta, f"{path.rstrip('/')}/meta", True)
    return meta


def write_journal(removed: DataFrame, path: str, apply: bool = False) -> int:
    """Removed edges, with the reason of each, so that they can be put back."""
    return write(removed, path, apply, mode="append")


def append_to_ledger(entry: DataFrame, path: str, apply: bool = False) -> int:
    return write(entry, path, apply, mode="append")


def state_after(state: DataFrame, accepted: DataFrame, key: str, stamp: str, base: str, version: str, apply: bool = False) -> DataFrame:
    """The state with what was accepted, written as a new version."""
    out = versions.advanced(state, accepted, key, stamp)
    write_version(out, base, version, apply)
    return out


def changed(df: DataFrame, mark: str | None) -> tuple[bool, str]:
    """(whether df differs from what had that mark, its own mark), whatever the order of rows; to notify, or to write, only then."""
    row = df.agg(versions.fingerprint(df).alias("f"), F.count("*").alias("n")).first()
    own = f"{row.n}-{row.f}"
    return own != mark, own


def new_tickets(failures: DataFrame, filed: DataFrame) -> DataFrame:
    """(ticket, gate, log) of failures (gate, log) that haven't been filed (ticket); digits and white space in a log don't make another ticket."""
    same = F.lower(T.squeeze(F.regexp_replace("log", r"[0-9]+", "0")))
    rows = failures.select(T.fingerprint([F.col("gate"), same]).alias("ticket"), "gate", "log")
    return rows.groupBy("ticket").agg(F.min("gate").alias("gate"), F.min("log").alias("log")).join(filed.select("ticket"), "ticket", "left_anti")
