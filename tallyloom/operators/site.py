"""Gates and texts over built pages: links in bodies and cells, photos, presentation, sitemaps, a corpus file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .gates import issues, united
from .pages import NOINDEX, visible

IMG = r'(?is)<img\b[^>]*\bsrc="([^"]*)"'


def body_links(notes: DataFrame, key: str, text: str, titles: DataFrame, exempt: list[str]) -> DataFrame:
    """(key, target, verdict) of wikilinks without a page: subset if one title has all their words and the same last word, exempt by a pattern, else broken. titles: title."""
    links = notes.select(key, F.explode(F.array_distinct(T.wikilinks(F.col(text)))).alias("target"))
    own = titles.select("title").distinct()
    lost = links.join(own, F.lower(links.target) == F.lower(own.title), "left_anti")
    words = lambda c: F.filter(F.split(F.lower(F.regexp_replace(c, r"\([^)]*\)", " ")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    asked = lost.select("target").distinct().withColumn("_w", words(F.col("target"))).withColumn("_last", F.try_element_at("_w", F.lit(-1)))
    has = own.withColumn("_t", words(F.col("title"))).withColumn("_last", F.try_element_at("_t", F.lit(-1)))
    near = asked.join(has, "_last").where(F.size(F.array_except("_w", "_t")) == 0).groupBy("target").agg(F.count("*").alias("_n"))
    out = lost.join(near, "target", "left")
    let = F.lit(False)
    for p in exempt:
        let = let | F.col("target").rlike(p)
    return out.select(key, "target", F.when(let, "exempt").when(F.col("_n") == 1, "subset").otherwise("broken").alias("verdict"))


def unlinked_cells(cells: DataFrame, matches: DataFrame) -> DataFrame:
    """cells (cell, text) without a link though their name has a match (cell, slug, verdict)."""
    return cells.where(~F.col("text").contains("[[")).join(matches.where("verdict = 'match'").select("cell", "slug"), "cell").select("cell", "slug")


def source_parity(notes: DataFrame, rows: DataFrame, file: str) -> DataFrame:
    """Issues of notes that no row comes from, rows whose note is gone, and notes that several rows come from."""
    n, r = notes.select(file).distinct(), rows.select(file).where(F.col(file).isNotNull())
    return united([
        issues(n.join(r, file, "left_anti"), "unpublished", F.col(file), F.lit(""), "medium"),
        issues(r.distinct().join(n, file, "left_anti"), "orphan", F.col(file), F.lit(""), "high"),
        issues(r.groupBy(file).agg(F.count("*").alias("_n")).where("_n > 1"), "repeated_file", F.col(file), F.col("_n"), "high"),
    ])


def photo_parity(public: DataFrame, source: DataFrame) -> DataFrame:
    """(file, state) of public photos (file, sha256): known under that content in source (file, sha256) or unknown, and names whose content differs."""
    known = source.select("sha256").distinct().withColumn("_known", F.lit(True))
    named = source.select(F.lower(F.element_at(F.split("file", "/"), -1)).alias("_name"), F.col("sha256").alias("_sha"))
    same_name = public.withColumn("_name", F.lower(F.element_at(F.split("file", "/"), -1))).join(named, "_name").groupBy("file").agg(F.bool_or(F.col("sha256") == F.col("_sha")).alias("_same"))
    out = public.join(known, "sha256", "left").join(same_name, "file", "left")
    return out.select("file", F.when(F.col("_known"), "known").when(F.col("_same").isNotNull(), "differs").otherwise("unknown").alias("state"))


def identical_files(files: DataFrame, used: DataFrame) -> DataFrame:
    """(md5, files, dead): groups of files (file, md5) of the same content; dead are those that nothing uses (used: file) while another is used."""
    rows = files.join(used.select("file").distinct().withColumn("_used", F.lit(True)), "file", "left")
    out = rows.groupBy("md5").agg(F.array_sort(F.collect_set("file")).alias("files"), F.array_sort(F.collect_set(F.when(F.col("_used").isNull(), F.col("file")))).alias("_idle"), F.count("_used").alias("_n")).where("size(files) > 1")
    return out.select("md5", "files", F.when(F.col("_n") > 0, F.col("_idle")).otherwise(F.array().cast("array<string>")).alias("dead"))


def photos_not_shown(rows: DataFrame, key: str, images: str, pages: DataFrame, html: str, avatar: str = r"avatar") -> DataFrame:
    """(key, image): attached images that the row's page doesn't show in full size; an img whose tag matches avatar doesn't count."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))
    name = lambda c: F.lower(F.element_at(F.split(c, "/"), -1))
    shown = pages.select(key, F.explode(tags).alias("_tag")).where(~F.col("_tag").rlike(avatar)).select(key, name(F.regexp_extract("_tag", IMG, 1)).alias("_name")).distinct()
    return rows.select(key, F.explode(images).alias("image")).withColumn("_name", name(F.col("image"))).join(shown, [key, "_name"], "left_anti").select(key, "image")


def presentation(pages: DataFrame, key: str, html: str, banned: list[str], required: list[str]) -> DataFrame:
    """Issues of built pages: links repeated in the navigation, banned words shown, required anchors missing, cells of nothing but a dash."""
    page = F.col(html)
    nav = T.hrefs(F.regexp_extract(page, r"(?is)<nav\b[^>]*>(.*?)</nav>", 1))
    twice = F.array_distinct(F.filter(nav, lambda x, i: F.exists(F.slice(nav, i + 2, F.size(nav)), lambda y: y == x)))
    rows = pages.select(F.col(key).alias("_k"), twice.alias("_twice"), visible(page).alias("_text"), page.alias("_html"))
    parts = [issues(rows.select("_k", F.explode("_twice").alias("_x")), "repeated_nav_link", F.col("_k"), F.col("_x"), "low"), issues(rows.where(F.col("_html").rlike(r"(?is)<td[^>]*>\s*(?:—|–|-|&mdash;)\s*</td>")), "dash_cell", F.col("_k"), F.lit(""), "low")]
    parts += [issues(rows.where(F.col("_text").contains(b)), "banned_label", F.col("_k"), F.lit(b), "medium") for b in banned]
    parts += [issues(rows.where(~F.col("_html").contains(f'id="{r}"')), "missing_anchor", F.col("_k"), F.lit(r), "medium") for r in required]
    return united(parts)


def unfenced(pages: DataFrame, key: str, html: str, claim: str) -> DataFrame:
    """(key): pages that claim to be excluded and lack noindex."""
    return pages.where(F.col(html).rlike(claim) & ~F.col(html).rlike(NOINDEX)).select(key)


def corpus(pages: DataFrame, url: str, html: str, excluded: DataFrame) -> DataFrame:
    """(url, title, text) of what pages show, without redirect stubs, pages that aren't to be indexed, and excluded ones (url)."""
    page = F.col(html)
    rows = pages.where(~page.rlike(r'(?i)http-equiv="refresh"') & ~page.rlike(NOINDEX)).join(excluded.select(url), url, "left_anti")
    return rows.select(url, T.html_title(page).alias("title"), T.html_to_text(page).alias("text")).where("text <> ''")


def indexable(pages: DataFrame, url: str, relations: Column) -> DataFrame:
    """pages without those that show a withheld relation; relations: an array of struct with withheld."""
    return pages.where(~F.coalesce(F.exists(relations, lambda r: F.coalesce(r.withheld, F.lit(False))), F.lit(False)))


def sitemap_rows(pages: DataFrame, url: str, excluded: str, lastmod: DataFrame, images: DataFrame) -> DataFrame:
    """(url, lastmod, images) of the pages to announce: none that matches excluded; dates and images (url, image) as far as there are some."""
    rows = pages.where(~F.col(url).rlike(excluded)).select(url).distinct()
    own = images.groupBy(url).agg(F.array_sort(F.collect_set("image")).alias("images"))
    return rows.join(lastmod.select(url, "lastmod"), url, "left").join(own, url, "left").select(url, "lastmod", F.coalesce("images", F.array().cast("array<string>")).alias("images"))


def sitemap_xml(rows: DataFrame, url: str) -> DataFrame:
    """(entry): one <url> element for each row of sitemap_rows, to be written as text."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    date = F.when(F.col("lastmod").isNotNull(), F.concat(F.lit("<lastmod>"), F.date_format("lastmod", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</lastmod>"))).otherwise("")
    image = F.array_join(F.transform("images", lambda i: F.concat(F.lit("<image:image><image:loc>"), safe(i), F.lit("</image:loc></image:image>"))), "")
    return rows.select(F.concat(F.lit("<url><loc>"), safe(F.col(url)), F.lit("</loc>"), date, image, F.lit("</url>")).alias("entry"))


def healed_count(texts: DataFrame, text: str, pattern: str, count: DataFrame) -> DataFrame:
    """texts with the number in what pattern matches (its first group is what stands before the number) set to the one value in count (n)."""
    n = count.select(F.col("n").cast("string")).scalar()
    return texts.withColumn(text, F.regexp_replace(F.col(text), F.lit(pattern + "[0-9][0-9,]*"), F.concat(F.lit("$1"), n)))


def classified_status(rows: DataFrame, url: str, status: str, dead: tuple[int, ...] = (404, 410)) -> DataFrame:
    """(url, status, verdict): dead for those codes, ok below 400, unchecked for all others and where there was no answer."""
    s = F.col(status)
    return rows.select(url, status, F.when(s.isin(*dead), "dead").when(s < 400, "ok").otherwise("unchecked").alias("verdict"))


def pipeline_run(spark: SparkSession, stages: list[tuple[str, bool, Callable[[], DataFrame | None]]]) -> DataFrame:
    """(place, stage, state, n_issues): stages (name, blocks, function) in order, each giving its issues or none; all run, whatever one before has found or whether it failed, and publish, the last row, is blocked if one that blocks failed or has issues."""
    rows, blocked = [], False
    for place, (name, blocks, run) in enumerate(stages):
        try:
            found = run()
            n, state = (0, "passed") if found is None else ((c := found.count()), "passed" if c == 0 else "issues")
        except Exception:
            n, state = -1, "failed"
        blocked |= blocks and state != "passed"
        rows.append((place, name, state, n))
    rows.append((len(stages), "publish", "blocked" if blocked else "allowed", 0))
    return spark.createDataFrame(rows, "place int, stage string, state string, n_issues long")
