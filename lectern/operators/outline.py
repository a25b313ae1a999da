"""Outlines from text: unit headings, numbered sections, printed contents, pasted trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Roman numerals of units, as scanners may also write them.
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12, "l": 1, "ll": 2, "lll": 3, "lv": 4, "1": 1, "2": 2, "3": 3, "4": 4, "5": 5, "6": 6, "7": 7, "8": 8, "9": 9, "10": 10}
UNIT_LINE = r"^\s*(?i:unit|chapter|module)\s*[-–—:.]?\s*((?i:[ivxl]+)|\d{1,2})\b\s*[-–—:.]*\s*(.*?)\s*$"
SECTION_LINE = r"^\s*(\d{1,2})\.(\d{1,2})\s+(\p{L}.*?)\s*$"
CONTENTS_LINE = r"^\s*(.*\p{L}.*?)\s*(?:\.{2,}|…|\s{3,}|\t)\s*(\d{1,4})\s*$"


def roman_number(token: Column) -> Column:
    """1..12 of a Roman or Arabic numeral, misread letters included; null for others."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in ROMAN.items() for x in pair)), F.lower(token))


def page_lines(pages: DataFrame) -> DataFrame:
    """(document_id, page, line_no, line) of pages (document_id, page, text)."""
    return pages.where(F.col("text").isNotNull()).select("document_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def unit_headings(pages: DataFrame) -> DataFrame:
    """(document_id, page, line_no, unit_no, title) of the lines that name a unit."""
    lines = page_lines(pages).where(F.col("line").rlike(UNIT_LINE))
    found = lines.select("document_id", "page", "line_no", roman_number(F.regexp_extract("line", UNIT_LINE, 1)).alias("unit_no"), F.regexp_extract("line", UNIT_LINE, 2).alias("title"))
    return found.where(F.col("unit_no").isNotNull())


def section_headings(pages: DataFrame) -> DataFrame:
    """(document_id, page, line_no, major, minor, title) of the lines numbered major.minor."""
    lines = page_lines(pages).where(F.col("line").rlike(SECTION_LINE))
    part = lambda i: F.regexp_extract("line", SECTION_LINE, i)
    return lines.select("document_id", "page", "line_no", part(1).cast("int").alias("major"), part(2).cast("int").alias("minor"), part(3).alias("title"))


def contents(pages: DataFrame, least: int = 4) -> DataFrame:
    """(document_id, page, line_no, title, start_page) of dotted contents lines, on pages with ``least`` of them."""
    lines = page_lines(pages).where(F.col("line").rlike(CONTENTS_LINE))
    entries = lines.select("document_id", "page", "line_no", F.regexp_extract("line", CONTENTS_LINE, 1).alias("title"), F.regexp_extract("line", CONTENTS_LINE, 2).cast("int").alias("start_page"))
    many = entries.groupBy("document_id", "page").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("document_id", "page")
    return entries.join(many, ["document_id", "page"], "left_semi")


def section_spans(headings: DataFrame, last_page: DataFrame) -> DataFrame:
    """(document_id, major, minor, title, page_start, page_end): first appearance of each number, to the page before the next."""
    first = headings.groupBy("document_id", "major", "minor").agg(F.min_by(F.struct("page", "line_no", "title"), F.struct("page", "line_no")).alias("h"))
    rows = first.select("document_id", "major", "minor", "h.title", F.col("h.page").alias("page_start")).join(last_page, "document_id")
    window = Window.partitionBy("document_id").orderBy("page_start", "major", "minor")
    end = F.coalesce(F.lead("page_start").over(window) - 1, F.col("last_page"))
    return rows.select("document_id", "major", "minor", "title", "page_start", F.greatest("page_start", end).alias("page_end"))


def unit_ranges(spans: DataFrame) -> DataFrame:
    """(document_id, major, page_start, page_end, n_sections) over a unit's sections."""
    return spans.groupBy("document_id", "major").agg(F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.count(F.lit(1)).alias("n_sections"))


def outline_json(spans: DataFrame) -> DataFrame:
    """(document_id, outline): each document's units with their sections, as JSON."""
    unit = spans.groupBy("document_id", "major").agg(
        F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.array_sort(F.collect_list(F.struct("minor", "title", "page_start", "page_end"))).alias("sections")
    )
    return unit.groupBy("document_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("major", "page_start", "page_end", "sections")))).alias("outline"))


# What an outline of chapters has, and titles of mere page ranges.
LEAST_UNITS, MOST_UNITS, MOST_SECTIONS, LEAST_SPAN = 3, 12, 30, 3
BUCKET_TITLE = r"(?i)^.+\s+pages\s+\d+\s*[–-]\s*\d+$"


def outline_checks(sections: DataFrame) -> DataFrame:
    """One row per document of ``sections`` (document_id, unit_id, title, page_start, page_end): n_units, n_sections,
    is_bucket (all titles are page ranges), valid (two sections and no buckets), granularity and quality.

    Quality is low for buckets and fewer than three sections, high for 3 to 12 units whose sections have three
    pages on average, else medium.
    """
    span = F.col("page_end") - F.col("page_start") + 1
    found = sections.groupBy("document_id").agg(
        F.count_distinct("unit_id").alias("n_units"), F.count(F.lit(1)).alias("n_sections"), F.coalesce(F.every(F.col("title").rlike(BUCKET_TITLE)), F.lit(False)).alias("is_bucket"), F.avg(span).alias("span")
    )
    chapters = F.col("n_units").between(LEAST_UNITS, MOST_UNITS)
    quality = F.when(F.col("is_bucket") | (F.col("n_sections") < LEAST_UNITS), "low").when(chapters & (F.col("span") >= LEAST_SPAN), "high").otherwise("medium")
    return found.select(
        "document_id", "n_units", "n_sections", "is_bucket", ((F.col("n_sections") >= 2) & ~F.col("is_bucket")).alias("valid"),
        F.when(chapters, "chapter").otherwise("section").alias("granularity"), quality.alias("quality"),
        ((F.col("n_sections") > MOST_SECTIONS) & (F.col("n_units") > MOST_UNITS)).alias("too_granular"),
    )


def merge_short(sections: DataFrame, least: int = LEAST_SPAN) -> DataFrame:
    """``sections`` (document_id, unit_id, title, page_start, page_end) of which those under ``least`` pages went into the one before, within their unit.

    A numbered section (1.1) and the first of a unit stay; a section takes in all short ones behind it.
    """
    window = Window.partitionBy("document_id", "unit_id").orderBy("page_start", "page_end", "title")
    short = (F.col("page_end") - F.col("page_start") + 1 < least) & ~F.col("title").rlike(SECTION_LINE)
    opens = (F.row_number().over(window) == 1) | ~short
    runs = sections.withColumn("_opens", opens).withColumn("_run", F.sum(F.col("_opens").cast("int")).over(window))
    return runs.groupBy("document_id", "unit_id", "_run").agg(F.max(F.when(F.col("_opens"), F.col("title"))).alias("title"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end")).drop("_run")


# How chapters are marked.
CHAPTER, NUMBERED_CHAPTER, SUBUNIT = r"(?i)^(chapter|unit|module|part)\s+([0-9]+|[IVXLCDM]+)\b", r"^(\d+)[.\s]\s+\S", r"(?i)^unit\s+(\d+)\.(\d+)\b"
CHAPTER_PREFIX = r"(?i)^(chapter|unit|module|part)\s+([0-9]+|[IVXLCDM]+)\s*[:.\-–]?\s*"
MAJOR_UNIT, NUMBERED_SECTION = r"(?i)^unit\s+(\d+)([^.\d]|$)", r"^(\d{1,2})\.(\d{1,2})\s+(.+)$"
MATH, FORMULA = r"(?i)\d+\s*[x×]\s*\d+|[\d.]+\s*[+\-*/]\s*[\d.]+", r"^[\d.\[\]\s]+$|^0\.\d+[^A-Za-z\s]"


def is_chapter(title: Column) -> Column:
    """Whether a title names or numbers a chapter, and no sub-unit."""
    clean = F.trim(title)
    return ~clean.rlike(SUBUNIT) & (clean.rlike(CHAPTER) | clean.rlike(NUMBERED_CHAPTER))


def chapter_title(title: Column) -> Column:
    """A chapter's title without its mark; the whole one where nothing else is left."""
    clean = F.trim(title)
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(clean, CHAPTER_PREFIX, "")), F.lit("")), clean)


def major_unit(title: Column) -> Column:
    """The unit's number that a title begins with: of a sub-unit, a numbered section or a unit; else null."""
    clean = F.trim(title)
    first = lambda pattern: F.nullif(F.regexp_extract(clean, pattern, 1), F.lit("")).cast("int")
    return F.coalesce(first(SUBUNIT), first(NUMBERED_SECTION), first(MAJOR_UNIT))


def is_section_title(title: Column) -> Column:
    """Whether a title is one and not a formula: 3 to 120 characters, three letters, few digits."""
    clean = F.trim(title)
    n, digits, letters = F.length(clean), F.length(F.regexp_replace(clean, r"\P{Nd}", "")), F.length(F.regexp_replace(clean, r"\P{L}", ""))
    return n.between(3, 120) & ~clean.rlike(MATH) & ~clean.rlike(FORMULA) & (digits <= n * 0.35) & (letters >= 3)


def page_buckets(documents: DataFrame, width: int = 10) -> DataFrame:
    """(document_id, page_start, page_end): ranges of ``width`` pages for documents without an outline."""
    known = documents.where(F.col("page_count") > 0)
    starts = known.select("document_id", "page_count", F.explode(F.sequence(F.lit(1), F.col("page_count"), F.lit(width))).alias("page_start"))
    return starts.select("document_id", "page_start", F.least("page_count", F.col("page_start") + width - 1).alias("page_end"))


# A topic runs to the next comma, semicolon or full stop that stands outside brackets (nested once at most).
_TOPIC = r"(?:[^,;.()\[\]{}]|\((?:[^()]|\([^()]*\))*\)|\[[^\[\]]*\]|\{[^{}]*\}|\.(?=\S)|[()\[\]{}])+"


def split_topics(text: Column) -> Column:
    """Topics between commas, semicolons and sentence ends, those inside brackets kept together, blanks made single."""
    found = F.regexp_extract_all(text, F.lit(_TOPIC), F.lit(0))
    return F.filter(F.transform(found, lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: t != "")


def pasted_tree(texts: DataFrame) -> DataFrame:
    """(id, node_no, level, title, parent_no) of the lines of indented lists, ``texts`` (id, text).

    No indent begins a unit (level 0), up to three blanks a part (1), more a subtopic (2); a tab counts as
    four blanks, bullets are left out. A subtopic hangs on the last part of its unit, without one on the unit;
    what stands before any unit hangs on nothing.
    """
    lines = texts.where(F.col("text").isNotNull()).select("id", F.posexplode(F.split("text", "\n")).alias("node_no", "line"))
    shown = F.regexp_replace("line", "\t", "    ")
    indent = F.length(F.regexp_extract(shown, r"^( *)", 1))
    title = F.trim(F.regexp_replace(F.trim(F.regexp_replace("line", r"[\s]", " ")), r"^[-*•]\s*", ""))
    nodes = lines.select("id", "node_no", F.when(indent == 0, 0).when(indent < 4, 1).otherwise(2).alias("level"), title.alias("title")).where(F.col("title") != "")
    before = Window.partitionBy("id").orderBy("node_no").rowsBetween(Window.unboundedPreceding, -1)
    unit = F.max(F.when(F.col("level") == 0, F.col("node_no"))).over(before)
    part = F.max(F.when(F.col("level") == 1, F.col("node_no"))).over(before)
    placed = nodes.withColumns({"_unit": unit, "_part": part})
    own = F.when(F.col("_part") > F.coalesce("_unit", F.lit(-1)), F.col("_part")).otherwise(F.col("_unit"))
    return placed.select("id", "node_no", "level", "title", F.when(F.col("level") == 1, F.col("_unit")).when(F.col("level") == 2, own).alias("parent_no"))


def capped(sizes: DataFrame, most: int = MOST_UNITS) -> DataFrame:
    """(document_id, ordinal, group) of units (document_id, ordinal, size): neighbours of least size together, the
    first of equal ones, go into one group until ``most`` are left.

    Only documents with more units go through Python, one row a document.
    """
    listed = sizes.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "size"))).alias("units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], []]
            for document, units in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for unit, group in zip(units, merge_to_most([u["size"] for u in units], most)):
                    for column, value in zip(out, (document, unit["ordinal"], group)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.int32()))], names=["document_id", "ordinal", "group"])

    many = listed.where(F.size("units") > most).select("document_id", F.transform("units", lambda u: F.struct(u["ordinal"].cast("int").alias("ordinal"), u["size"].cast("long").alias("size"))).alias("units"))
    few = listed.where(F.size("units") <= most).select("document_id", F.posexplode("units").alias("group", "u")).select("document_id", F.col("u.ordinal").cast("int").alias("ordinal"), "group")
    return few.unionByName(many.mapInArrow(run, "document_id string, ordinal int, group int"))


def merge_to_most(sizes: Sequence[int], most: int) -> list[int]:
    """The group of each of ``sizes``, see ``capped``; a heap of neighbour pairs keeps it n log n."""
    n = len(sizes)
    weight, after, before, alive = list(sizes), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    pairs = [(weight[i] + weight[i + 1], i, i + 1) for i in range(n - 1)]
    heapq.heapify(pairs)
    left = n
    while left > max(1, most):
        total, i, j = heapq.heappop(pairs)
        if not (alive[i] and after[i] == j and total == weight[i] + weight[j]):
            continue
        weight[i], alive[j], after[i], left = total, False, after[j], left - 1
        if after[i] < n:
            before[after[i]] = i
            heapq.heappush(pairs, (weight[i] + weight[after[i]], i, after[i]))
        if before[i] >= 0:
            heapq.heappush(pairs, (weight[before[i]] + weight[i], before[i], i))
    out, group = [], -1
    for kept in alive:
        group += kept
        out.append(group)
    return out


def join_wrapped(text: Column) -> Column:
    """The lines of a text put together that were wrapped: a line goes on in one that begins in lower case, or
    after a comma; a hyphen before a lower-case letter goes. Empty lines are left out."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s", " "))), lambda x: x != "")

    def step(out: Column, line: Column) -> Column:
        last, low = F.element_at(out, -1), line.rlike(r"^\p{Ll}")
        cut = last.endswith("-") & low
        put = F.when(cut, F.concat(last.substr(F.lit(1), F.length(last) - 1), line)).otherwise(F.concat_ws(" ", last, line))
        joins = (F.size(out) > 0) & (low | last.endswith(","))
        return F.when(joins, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(put))).otherwise(F.concat(out, F.array(line)))

    return F.aggregate(lines, F.array().cast("array<string>"), lambda out, line: F.when(F.size(out) == 0, F.array(line)).otherwise(step(out, line)))
