"""What happens to fused hits: boosts, the confidence gate, the context budget and page estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import normalise
from lectern.operators.running import running_sum


def logistic(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


def term_hits(body: Column, wanted: Column) -> Column:
    """How many of the wanted terms the body contains."""
    text = normalise(body)
    return F.size(F.filter(wanted, lambda t: F.contains(text, F.lower(t))))


# What the bonuses add and where they end.
_HIT, _SHARE, _NEARLY_ALL, _MOST = 0.05, 0.10, 0.05, 0.18
_UNTITLED, _TITLE, _TITLE_SHARE, _UNIT, _UNIT_STEP = 0.08, 0.03, 0.04, 0.03, 0.01
_PAGE_BODY, _PAGE_UNIT, _PAGE_LOW, _LOW_SCORE = 0.06, 0.04, 0.03, 0.42
_FAR, _FARTHER, _OTHER_UNIT, _NEAR_PAGES, _FAR_PAGES = 0.05, 0.08, 0.06, 2, 8


def lexical_bonus(body: Column, wanted: Column, parent: Column | None = None) -> Column:
    """.05 and a tenth of the share of terms found in body and parent, .05 more with a parent when all but one are; .18 at most."""
    hay = body if parent is None else F.concat_ws(" ", body, parent)
    hits, n = term_hits(hay, wanted), F.size(wanted)
    nearly = hits >= F.greatest(F.lit(2), n - 1)
    nearly = nearly if parent is None else nearly & (F.coalesce(F.length(parent), F.lit(0)) > 0)
    bonus = F.when(hits == 0, 0.0).otherwise(_HIT + _SHARE * hits / n + F.when(nearly, _NEARLY_ALL).otherwise(0.0))
    return F.least(F.lit(_MOST), F.when(n > 0, bonus).otherwise(0.0))


def phrase_bonus(question: Column, body: Column, phrases: dict[str, float]) -> Column:
    """The largest weight of the phrases that both the question and the body hold."""
    q, hay = F.lower(question), F.lower(body)
    weights = [F.when(F.contains(q, F.lit(p)) & F.contains(hay, F.lit(p)), w).otherwise(0.0) for p, w in phrases.items()]
    return F.array_max(F.array(F.lit(0.0), *weights))


def rescue_bonus(score: Column, question: Column, body: Column, rules: list[tuple[list[str], list[str], float]], least: float = 0.35) -> Column:
    """The bonus of the first rule (words of the question, words of the body, bonus) that holds, for scores below ``least``."""
    q, hay = F.lower(question), F.lower(body)
    bonus = F.lit(0.0)
    for asked, held, gives in reversed(rules):
        every = F.lit(True)
        for text, words in ((q, asked), (hay, held)):
            for word in words:
                every = every & F.contains(text, F.lit(word))
        bonus = F.when(every, gives).otherwise(bonus)
    return F.when(score >= least, 0.0).otherwise(bonus)


def in_ranges(page: Column, ranges: Column) -> Column:
    return F.coalesce(F.exists(ranges, lambda r: page.between(r["page_start"], r["page_end"])), F.lit(False))


def metadata_bonus(score: Column, wanted: Column, page: Column, unit: Column, section: Column, toc: Column, body_hits: Column, units: Column, ranges: Column) -> Column:
    """What a chunk's titles, unit and page add: terms in the titles, the unit among the hinted ``units`` (less
    for later ones), the page in a hinted range; off for chunks without a unit, front matter and the first pages where there are hints; .18 at most."""
    titles = F.trim(F.concat_ws(" ", F.lower(section), F.lower(toc)))
    n = F.size(wanted)
    hits = F.size(F.filter(wanted, lambda t: F.contains(titles, t)))
    hinted = (F.coalesce(F.size(units), F.lit(0)) > 0) | (F.coalesce(F.size(ranges), F.lit(0)) > 0)
    front = unit.isNull() | (F.coalesce(F.lower(toc), F.lit("")) == "front matter") | (page <= 2)
    place = F.coalesce(F.array_position(units, unit), F.lit(0))
    paged = F.when((body_hits > 0) | (hits > 0), _PAGE_BODY).when(place > 0, _PAGE_UNIT).otherwise(0.0) + F.when(score < _LOW_SCORE, _PAGE_LOW).otherwise(0.0)
    total = (
        F.when(hinted & front, -_UNTITLED).otherwise(0.0)
        + F.when((n > 0) & (hits > 0), _TITLE + _TITLE_SHARE * hits / n).otherwise(0.0)
        + F.when(place > 0, _UNIT - _UNIT_STEP * (place - 1)).otherwise(0.0)
        + F.when(in_ranges(page, ranges), paged).otherwise(0.0)
    )
    return F.least(F.lit(_MOST), total)


def section_demotion(page: Column, unit: Column, units: Column, ranges: Column) -> Column:
    """What a chunk outside all hinted ranges loses: by its distance, and for a unit that isn't hinted at."""
    away = F.array_min(F.transform(ranges, lambda r: F.least(F.abs(page - r["page_start"]), F.abs(page - r["page_end"]))))
    far = F.when(away > _FAR_PAGES, _FARTHER).when(away > _NEAR_PAGES, _FAR).otherwise(0.0)
    other = (F.coalesce(F.size(units), F.lit(0)) > 0) & unit.isNotNull() & ~F.coalesce(F.array_contains(units, unit), F.lit(False))
    outside = (F.coalesce(F.size(ranges), F.lit(0)) > 0) & ~in_ranges(page, ranges)
    return F.when(outside, F.greatest(far, F.when(other, _OTHER_UNIT).otherwise(0.0))).otherwise(0.0)


#: Characters of the parent that a reranker reads, alone and beside the chunk.
PARENT_ALONE, PARENT_BESIDE = 2000, 1500


def rerank_text(body: Column, parent: Column) -> Column:
    """What a reranker reads of a chunk: the parent's begin where it holds the chunk, the chunk where it holds
    the parent, else both."""
    b, p = F.trim(F.coalesce(body, F.lit(""))), F.trim(F.coalesce(parent, F.lit("")))
    both = F.concat(b, F.lit("\n\n"), F.substring(p, 1, PARENT_BESIDE))
    return F.when(p == "", b).when(F.contains(p, b), F.substring(p, 1, PARENT_ALONE)).when(F.contains(b, p), F.substring(b, 1, PARENT_ALONE)).otherwise(both)


# The least score of the best hit, of study and of exam questions.
GATES = {"study": 0.35, "exam": 0.25}


def gate_threshold(mode: Column) -> Column:
    """The least score of the best hit in a mode; that of study for others and null."""
    return F.when(mode == "exam", GATES["exam"]).otherwise(GATES["study"])


def page_window_bonus(page: Column, low: Column, high: Column, bonus: float = 0.06, per_page: float = 0.01, most: float = 0.12) -> Column:
    """A bonus inside the hinted pages, outside a penalty that grows with the distance; 0 without a hint."""
    away = F.greatest(low - page, page - high, F.lit(0))
    return F.when(low.isNull() | high.isNull() | page.isNull(), 0.0).when(away == 0, bonus).otherwise(-F.least(F.lit(most), away * per_page))


def boosted(score: Column, *bonuses: Column) -> Column:
    total = score
    for bonus in bonuses:
        total = total + bonus
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def confidence_gate(hits: DataFrame, threshold: float, key: str = "query_id") -> DataFrame:
    """All hits of a query whose best-ranked one reaches the threshold, none of the others.

    ``hits`` has (key, rank, score); the first rank decides, a null score refuses, equality passes.
    """
    top = hits.groupBy(key).agg(F.min_by("score", "rank").alias("_top")).where(F.col("_top") >= threshold)
    return hits.join(top.select(key), key, "left_semi")


def gate_status(queries: DataFrame, hits: DataFrame, threshold: float, key: str = "query_id") -> DataFrame:
    """(key, status, reason) of every query: ok, or not_in_materials for empty_corpus or below_threshold."""
    top = hits.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min_by("score", "rank").alias("_top"))
    passed = F.coalesce(F.col("_top") >= threshold, F.lit(False))
    return queries.select(key).distinct().join(top, key, "left").select(
        key,
        F.when(passed, "ok").otherwise("not_in_materials").alias("status"),
        F.when(F.col("_n").isNull(), "empty_corpus").when(~passed, "below_threshold").alias("reason"),
    )


def context_budget(hits: DataFrame, max_tokens: int = 4000, key: str = "query_id", text: str = "text") -> DataFrame:
    """``hits`` (key, rank, id, text) with ``kept``: how many characters of the text fit, in rank order,
    into 4 * max_tokens; the text that overflows is cut, later ones become empty."""
    budget = 4 * max_tokens
    size = F.coalesce(F.length(text), F.lit(0))
    used = running_sum(hits, [key], F.col("rank") / 4096, ["rank", "id"], size, "_used")
    kept = F.greatest(F.lit(0), F.least(size, F.lit(budget) - F.col("_used")))
    return used.withColumn("kept", kept.cast("int")).withColumn(text, F.col(text).substr(F.lit(1), F.col("kept"))).drop("_used")


def estimate_page(text: Column, wanted: Column, page_start: Column, page_end: Column, page: Column | None = None, ranges: Column | None = None) -> Column:
    """The page of the first wanted term that the text has, by its share of the text's length.

    Of a parent on one page, or without any term, ``page`` is kept (its first page without one). With
    ``ranges`` the estimate is moved into the first hinted range that meets the parent's pages.
    """
    lowered = F.lower(text)
    first = F.try_element_at(F.filter(wanted, lambda t: F.contains(lowered, F.lower(t))), F.lit(1))
    place = F.instr(lowered, F.lower(first)) - 1
    share = place / F.greatest(F.lit(1), F.length(text))
    raw = page_start + F.bround(share * (page_end - page_start)).cast("int")
    estimate = F.least(page_end, F.greatest(page_start, raw))
    if ranges is not None:
        meets = F.try_element_at(F.filter(ranges, lambda r: (page_start <= r["page_end"]) & (page_end >= r["page_start"])), F.lit(1))
        estimate = F.when(meets.isNull(), estimate).otherwise(F.greatest(F.greatest(page_start, meets["page_start"]), F.least(F.least(page_end, meets["page_end"]), estimate)))
    return F.when((page_start < page_end) & first.isNotNull() & (F.length(text) >= 2), estimate).otherwise(page_start if page is None else page)


def coverage(documents: DataFrame, hits: DataFrame) -> DataFrame:
    """Every document with whether it was hit, how often, and its best score."""
    best = hits.groupBy("document_id").agg(F.max("score").alias("best_score"), F.count(F.lit(1)).alias("n_hits"))
    return documents.join(best, "document_id", "left").withColumns({"n_hits": F.coalesce("n_hits", F.lit(0)), "hit": F.col("best_score").isNotNull()})


def marks_budget(marks: Column) -> Column:
    return F.when(marks >= 8, "long").when(marks >= 4, "medium").otherwise("short")


def promote(hits: DataFrame, target: Column, key: str = "query_id") -> DataFrame:
    """New ranks with the targets first, the order kept within both."""
    window = Window.partitionBy(key).orderBy(target.cast("int").desc(), "rank")
    return hits.withColumn("rank", F.row_number().over(window))
