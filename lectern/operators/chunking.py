"""Page text to parents and children: budget grouping and sliding word windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import token_count, without_line, words

# Words of a child, words of a parent and overlap, by kind of document.
SPECS = (("notes", 700, 1350, 0.12), ("textbook", 800, 1750, 0.12), ("syllabus", 500, 900, 0.10), ("past_paper", 400, 800, 0.12))


def spec(kind: Column, field: int, default: str = "notes") -> Column:
    """Field 1..3 of the kind's spec; other kinds and null count as ``default``."""
    out = F.when(F.lit(False), F.lit(None))
    for row in SPECS:
        out = out.when(kind == row[0], F.lit(row[field]))
    return out.otherwise(F.lit(next(r[field] for r in SPECS if r[0] == default)))


def windows(texts: DataFrame, size: Column, overlap_ratio: Column) -> DataFrame:
    """(id, window, text, token_count): windows of ``size`` words that share max(1, int(size * ratio)).

    ``texts`` has (id, text). A text that fits is one window, only stripped; the last window is the
    first that reaches the end; blank and null texts give none.
    """
    listed = texts.select("id", "text", words(F.col("text")).alias("words"), size.cast("int").alias("size"), overlap_ratio.alias("ratio")).where(F.size("words") > 0)
    overlap = F.greatest(F.lit(1), F.floor(F.col("size") * F.col("ratio")).cast("int"))
    listed = listed.withColumn("step", F.greatest(F.lit(1), F.col("size") - overlap)).withColumn("n", F.size("words"))
    count = 1 + F.ceil(F.greatest(F.lit(0), F.col("n") - F.col("size")) / F.col("step")).cast("int")
    spread = listed.withColumn("window", F.explode(F.sequence(F.lit(0), count - 1)))
    part = F.slice("words", F.col("window") * F.col("step") + 1, F.col("size"))
    whole = F.col("n") <= F.col("size")
    text = F.when(whole, F.regexp_replace("text", r"^\s+|\s+$", "")).otherwise(F.array_join(part, " "))
    return spread.select("id", F.col("window").cast("int").alias("window"), text.alias("text"), F.when(whole, F.col("n")).otherwise(F.size(part)).alias("token_count"))


def parent_groups(pages: DataFrame, budget: Column) -> DataFrame:
    """(document_id, page, group_no): pages put together in order while their words stay in the budget.

    ``pages`` has (document_id, page, text). A page over the budget stands alone; pages without text are
    dropped. The fold runs over the pages' sizes, so a document is one narrow array, not its text.
    """
    sized = pages.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).select("document_id", "page", token_count(F.col("text")).alias("tokens"), budget.cast("int").alias("budget"))
    folded = sized.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", "tokens"))).alias("pages"), F.max("budget").alias("budget"))
    start = F.struct(F.lit(0).alias("used"), F.lit(-1).alias("group"), F.array().cast("array<int>").alias("groups"))

    def put(state: Column, page: Column) -> Column:
        fresh = (state["group"] < 0) | ((state["used"] > 0) & (state["used"] + page["tokens"] > F.col("budget")))
        group = F.when(fresh, state["group"] + 1).otherwise(state["group"])
        return F.struct(F.when(fresh, page["tokens"]).otherwise(state["used"] + page["tokens"]).alias("used"), group.alias("group"), F.concat(state["groups"], F.array(group)).alias("groups"))

    groups = F.aggregate("pages", start, put, lambda state: state["groups"])
    spread = folded.select("document_id", F.explode(F.arrays_zip(F.col("pages.page").alias("page"), groups.alias("group_no"))).alias("p"))
    return spread.select("document_id", "p.page", "p.group_no")


def parents(pages: DataFrame, groups: DataFrame, header: Column | None = None) -> DataFrame:
    """(document_id, group_no, page_start, page_end, text): the grouped pages joined by a blank line."""
    text = F.col("text") if header is None else without_line(F.col("text"), header)
    joined = pages.select("document_id", "page", text.alias("text")).join(groups, ["document_id", "page"])
    ordered = joined.groupBy("document_id", "group_no").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.array_sort(F.collect_list(F.struct("page", "text"))).alias("parts"))
    return ordered.select("document_id", "group_no", "page_start", "page_end", F.array_join("parts.text", "\n\n").alias("text"))


def reassemble(chunks: DataFrame) -> DataFrame:
    """(document_id, page, text): a page's chunks in order, joined by newline; a repeated chunk once."""
    once = chunks.groupBy("document_id", "page", "chunk_id").agg(F.min("chunk_index").alias("chunk_index"), F.min("text").alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text")))
    return once.groupBy("document_id", "page").agg(F.array_join(parts["text"], "\n").alias("text"))


def longer_source(native: DataFrame, stored: DataFrame) -> DataFrame:
    """(document_id, page, text, source): per page the longer of two texts, the native one on equality."""
    a = native.select("document_id", "page", F.col("text").alias("a"))
    b = stored.select("document_id", "page", F.col("text").alias("b"))
    keep = F.coalesce(F.length("a"), F.lit(-1)) >= F.coalesce(F.length("b"), F.lit(-1))
    joined = a.join(b, ["document_id", "page"], "full_outer")
    return joined.select("document_id", "page", F.when(keep, F.col("a")).otherwise(F.col("b")).alias("text"), F.when(keep, "native").otherwise("stored").alias("source"))


def merge_metadata(first: Column, then: Column) -> Column:
    """One map of both; a later value that isn't null wins."""
    clean = F.map_filter(F.coalesce(then, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    base = F.map_filter(F.coalesce(first, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(clean), k))
    return F.map_concat(base, clean)
