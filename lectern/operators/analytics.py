"""Aggregates over questions and their concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import is_subpart, main_number, year_of

LONG_MARKS = 8
# Weights of the prediction score, and where its reasons begin.
WEIGHT_SHARE, WEIGHT_RECURRENCE, WEIGHT_TREND = 0.45, 0.35, 0.20
REASON_WEIGHT, REASON_RECURRENCE = 0.6, 0.5


def rounded(value: Column, digits: int) -> Column:
    """Half up on the decimal digits that the double shows, so that no engine's binary rounding matters."""
    return F.round(value.cast("decimal(28,10)"), digits).cast("double")


def marks_of(marks: Column) -> Column:
    return F.coalesce(marks, F.lit(1)).cast("int")


def concept_facts(questions: DataFrame, links: DataFrame) -> DataFrame:
    """One row per (scope, concept) with its weighted counts, marks, reach and trend.

    ``questions`` (question_id, scope, marks, paper_label), ``links`` (question_id, concept, weight
    decimal), one link per pair: repeated links count once by their largest weight. Weights are decimals,
    so that sums don't depend on their order. Totals are those of the scope, over all its questions.
    """
    q = questions.select("question_id", "scope", marks_of(F.col("marks")).alias("m"), F.nullif(F.trim("paper_label"), F.lit("")).alias("paper"))
    q = q.withColumn("year", year_of(F.col("paper")))
    totals = q.groupBy("scope").agg(F.sum("m").alias("t"), F.count(F.lit(1)).alias("n"), F.greatest(F.lit(1), F.count_distinct("paper")).alias("p"))
    w = links.groupBy("question_id", "concept").agg(F.max("weight").alias("w"))
    met = w.join(q, "question_id")
    facts = met.groupBy("scope", "concept").agg(
        F.sum("w").alias("sw"),
        F.count(F.lit(1)).alias("unique_questions"),
        F.sum(F.col("m") * F.col("w")).alias("smw"),
        F.count_if(F.col("m") >= LONG_MARKS).alias("long_count"),
        F.count_if(F.col("m") < LONG_MARKS).alias("short_count"),
        F.count_distinct("paper").alias("paper_reach"),
        F.max("year").alias("last_year"),
    )
    per_year = met.where(F.col("year").isNotNull()).groupBy("scope", "concept", "year").agg(F.count(F.lit(1)).alias("links"))
    slope = per_year.groupBy("scope", "concept").agg(F.round(F.regr_slope("links", "year"), 4).alias("trend_slope"))
    joined = facts.join(totals, "scope").join(slope, ["scope", "concept"], "left")
    d = lambda c: F.col(c).cast("double")
    return joined.select(
        "scope",
        "concept",
        rounded(d("sw"), 4).alias("question_count"),
        "unique_questions",
        rounded(d("smw"), 2).alias("marks_total"),
        rounded(100 * d("smw") / d("t"), 2).alias("weightage_pct"),
        rounded(100 * d("unique_questions") / d("n"), 2).alias("count_pct"),
        "long_count",
        "short_count",
        "paper_reach",
        rounded(d("paper_reach") / d("p"), 4).alias("recurrence_rate"),
        F.when(d("sw") > 0, rounded(d("smw") / d("sw"), 2)).alias("avg_marks"),
        "last_year",
        "trend_slope",
    )


# The orders a page of facts may have; the concept ends each.
ORDERS = {
    "weightage_desc": [F.desc, "weightage_pct", F.desc, "unique_questions"],
    "count_desc": [F.desc, "unique_questions", F.desc, "weightage_pct"],
    "label_asc": [],
}


def ranked_page(facts: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """Rows offset + 1 .. offset + limit of each scope in the order, with their rank."""
    steps = ORDERS[order]
    columns = [make(name) for make, name in zip(steps[::2], steps[1::2])]
    window = Window.partitionBy("scope").orderBy(*columns, F.lower("concept"), "concept")
    return facts.withColumn("rank", F.row_number().over(window)).where(F.col("rank").between(offset + 1, offset + limit))


def predictions(features: DataFrame, top_n: int = 10) -> DataFrame:
    """(scope, label, score, reasons, rank) from (scope, label, weightage_pct, recurrence_rate, trend_slope).

    Weightage is divided by the scope's largest (0 when that isn't positive), the slope is put between
    the scope's smallest and largest (null counts 0, equal slopes count 1). The largest and smallest
    come by an aggregate that's joined back, not by a window over the whole scope.
    """
    ends = features.groupBy("scope").agg(F.max("weightage_pct").alias("top"), F.min("trend_slope").alias("low"), F.max("trend_slope").alias("high"))
    rows = features.join(ends, "scope")
    share = F.when(F.col("top") > 0, F.col("weightage_pct") / F.col("top")).otherwise(0.0)
    trend = F.when(F.col("trend_slope").isNull(), 0.0).when(F.col("high") == F.col("low"), 1.0).otherwise((F.col("trend_slope") - F.col("low")) / (F.col("high") - F.col("low")))
    score = rounded(WEIGHT_SHARE * share + WEIGHT_RECURRENCE * F.coalesce("recurrence_rate", F.lit(0.0)) + WEIGHT_TREND * trend, 4)
    reasons = F.filter(
        F.array(
            F.when(share >= REASON_WEIGHT, F.lit("high_weightage")),
            F.when(F.col("recurrence_rate") >= REASON_RECURRENCE, F.lit("recurs_across_papers")),
            F.when(F.col("trend_slope") > 0, F.lit("rising_trend")),
        ),
        lambda x: x.isNotNull(),
    )
    window = Window.partitionBy("scope").orderBy(F.desc("score"), F.lower("label"), "label")
    scored = rows.select("scope", "label", score.alias("score"), reasons.alias("reasons"))
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= max(1, top_n))


def ordinal_slope(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slope) of (keys, year, n) over the index of the sorted years; null under two years."""
    window = Window.partitionBy(*keys).orderBy("year")
    indexed = counts.where(F.col("year").isNotNull()).withColumn("x", F.row_number().over(window) - 1)
    return indexed.groupBy(*keys).agg(F.round(F.regr_slope("n", "x"), 4).alias("slope"))


def unclassified_only(questions: DataFrame, links: DataFrame, unclassified: str) -> DataFrame:
    """Per scope the questions whose only links are to the unclassified concept, with their share."""
    kinds = links.groupBy("question_id").agg(F.max(F.col("concept") == unclassified).alias("without"), F.max(F.col("concept") != unclassified).alias("with_one"))
    flagged = questions.join(kinds, "question_id", "left").withColumn("alone", F.coalesce(F.col("without") & ~F.col("with_one"), F.lit(False)))
    out = flagged.groupBy("scope").agg(F.count(F.lit(1)).alias("n_questions"), F.count_if("alone").alias("unclassified_only"))
    return out.withColumn("unclassified_pct", rounded(100.0 * F.col("unclassified_only") / F.col("n_questions"), 2))


def counted_rows(questions: DataFrame) -> DataFrame:
    """Sub-part rows of a scope where it has any, else all its rows."""
    flagged = questions.withColumn("sub", is_subpart(F.col("question_number")))
    any_sub = flagged.groupBy("scope").agg(F.max("sub").alias("any_sub"))
    return flagged.join(any_sub, "scope").where(F.col("sub") | ~F.col("any_sub")).drop("any_sub")


def unit_frequency(questions: DataFrame) -> DataFrame:
    """(scope, unit, n_rows, rows_pct, n_mains, mains_pct): how often each unit is asked.

    A main question is (paper, leading digits); the unit of its first row (page, number, id) has it.
    """
    rows = counted_rows(questions).withColumn("unit", F.coalesce("unit", F.lit("Unmapped")))
    per_unit = rows.groupBy("scope", "unit").agg(F.count(F.lit(1)).alias("n_rows"))
    keyed = rows.withColumns({"paper": F.coalesce("paper_label", F.lit("Unknown")), "main": main_number(F.col("question_number"))}).where(F.col("main").isNotNull())
    mains = keyed.groupBy("scope", "paper", "main").agg(F.min_by("unit", F.struct("page", "question_number", "question_id")).alias("unit"))
    per_main = mains.groupBy("scope", "unit").agg(F.count(F.lit(1)).alias("n_mains"))
    all_rows = per_unit.groupBy("scope").agg(F.sum("n_rows").alias("all_rows"))
    all_mains = per_main.groupBy("scope").agg(F.sum("n_mains").alias("all_mains"))
    joined = per_unit.join(per_main, ["scope", "unit"], "left").join(all_rows, "scope").join(all_mains, "scope", "left")
    n_mains = F.coalesce("n_mains", F.lit(0))
    return joined.select(
        "scope", "unit", "n_rows", rounded(100.0 * F.col("n_rows") / F.col("all_rows"), 1).alias("rows_pct"),
        n_mains.alias("n_mains"), rounded(100.0 * n_mains / F.greatest(F.coalesce("all_mains", F.lit(0)), F.lit(1)), 1).alias("mains_pct"),
    )


def top_topics(questions: DataFrame, most: int = 10) -> DataFrame:
    """(scope, topic, n, rank): the most asked section titles of a scope, ties by title."""
    counts = counted_rows(questions).where(F.col("section_title").isNotNull()).groupBy("scope", F.col("section_title").alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    window = Window.partitionBy("scope").orderBy(F.desc("n"), "topic")
    return counts.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= most)


def year_unit_matrix(questions: DataFrame, units: list[str]) -> DataFrame:
    """(year, one column per unit, other): counts of the rows with a year; other has those of other units and of none."""
    rows = questions.withColumn("year", year_of(F.col("paper_label"))).where(F.col("year").isNotNull())
    named = rows.withColumn("unit", F.when(F.col("unit").isin(units), F.col("unit")).otherwise("other"))
    return named.groupBy("year").pivot("unit", [*units, "other"]).agg(F.count(F.lit(1))).fillna(0, [*units, "other"])


# Units that are none.
NO_UNITS = ("unmapped", "unclassified")


def unit_features(questions: DataFrame) -> DataFrame:
    """(scope, label, weightage_pct, recurrence_rate, trend_slope) of each unit, for ``predictions``.

    Weightage is the unit's share of the rows, recurrence the share of the scope's years that ask for it (1
    in a scope without years), the trend its slope over the order of its own years. Unmapped units are left out.
    """
    shares = unit_frequency(questions).where(~F.lower("unit").isin(*NO_UNITS)).select("scope", F.col("unit").alias("label"), F.col("rows_pct").alias("weightage_pct"))
    dated = counted_rows(questions).withColumn("year", year_of(F.col("paper_label"))).where(F.col("year").isNotNull())
    counts = dated.groupBy("scope", F.col("unit").alias("label"), "year").agg(F.count(F.lit(1)).alias("n"))
    years = counts.groupBy("scope").agg(F.count_distinct("year").alias("years"))
    own = counts.where(F.col("label").isNotNull()).groupBy("scope", "label").agg(F.count(F.lit(1)).alias("present"))
    slopes = ordinal_slope(counts.where(F.col("label").isNotNull()), ["scope", "label"]).withColumnRenamed("slope", "trend_slope")
    rows = shares.join(years, "scope", "left").join(own, ["scope", "label"], "left").join(slopes, ["scope", "label"], "left")
    recurrence = F.when(F.col("years").isNull(), 1.0).otherwise(rounded(F.coalesce("present", F.lit(0)) / F.col("years"), 4))
    return rows.select("scope", "label", "weightage_pct", recurrence.alias("recurrence_rate"), "trend_slope")


def topic_features(topics: DataFrame) -> DataFrame:
    """The same of (scope, topic, n): counts against the scope's largest, without a trend."""
    peak = topics.groupBy("scope").agg(F.max("n").alias("peak"))
    share = F.col("n") / F.col("peak")
    rows = topics.where(F.trim("topic") != "").join(peak, "scope")
    return rows.select("scope", F.col("topic").alias("label"), rounded(100.0 * share, 4).alias("weightage_pct"), rounded(share, 4).alias("recurrence_rate"), F.lit(None).cast("double").alias("trend_slope"))


def all_predictions(concepts: DataFrame, units: DataFrame, topics: DataFrame, structure_units: DataFrame | None = None, top_n: int = 10, top_units: int = 5, top_topics_n: int = 5) -> DataFrame:
    """(kind, scope, label, score, reasons, rank) of concepts, units and topics, each by ``predictions``.

    A scope with ``structure_units`` is predicted by these, others by ``units``.
    """
    if structure_units is not None:
        units = structure_units.unionByName(units.join(structure_units.select("scope").distinct(), "scope", "left_anti"))
    parts = (("concept", concepts, top_n), ("unit", units, top_units), ("topic", topics, top_topics_n))
    made = [predictions(rows, n).select(F.lit(kind).alias("kind"), "*") for kind, rows, n in parts]
    return made[0].unionByName(made[1]).unionByName(made[2])


def topic_frequency(questions: DataFrame, fallback_unit: str = "general") -> DataFrame:
    """(scope, unit, section, n, level): counts by unit and by unit and section, in one pass of grouping sets."""
    rows = questions.select("scope", F.coalesce("unit", F.lit(fallback_unit)).alias("unit"), F.coalesce("section_title", F.lit("Unclassified")).alias("section"))
    sets = rows.groupingSets([("scope", "unit"), ("scope", "unit", "section")], "scope", "unit", "section").agg(F.count(F.lit(1)).alias("n"), F.grouping("section").alias("_whole"))
    return sets.select("scope", "unit", "section", "n", F.when(F.col("_whole") == 1, "unit").otherwise("section").alias("level"))


def with_outline(outline: DataFrame, counts: DataFrame) -> DataFrame:
    """All units of the outline with their counts, 0 where there are none, and counted units it lacks."""
    return outline.join(counts, ["scope", "unit"], "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))


def source_stats(documents: DataFrame, chunks: DataFrame, readable: int = 100) -> DataFrame:
    """(document_id, n_chunks, readable_pages): chunks of each document, and its pages with a readable chunk, sorted."""
    once = chunks.select("chunk_id", "document_id", "page", "text").dropDuplicates(["chunk_id"])
    page = F.when(F.length(F.trim("text")) >= readable, F.col("page"))
    stats = once.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.array_sort(F.collect_set(page)).alias("readable_pages"))
    joined = documents.select("document_id").join(stats, "document_id", "left")
    return joined.select("document_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("readable_pages", F.array().cast("array<int>")).alias("readable_pages"))


def readiness(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, questions: DataFrame) -> DataFrame:
    """Per scope: ready documents, chunks, chunks with a vector, questions, and whether it can be asked about."""
    docs = documents.select("document_id", "scope").where(F.col("scope").isNotNull())
    held = chunks.select("chunk_id", "document_id").dropDuplicates(["chunk_id"])
    vectors = embeddings.where(F.col("embedding").isNotNull()).select("chunk_id").distinct().withColumn("embedded", F.lit(1))
    per_doc = held.join(vectors, "chunk_id", "left").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count("embedded").alias("e"))
    asked = questions.select("question_id", "document_id").dropDuplicates(["question_id"]).groupBy("document_id").agg(F.count(F.lit(1)).alias("q"))
    joined = docs.join(per_doc, "document_id", "left").join(asked, "document_id", "left").groupBy("scope").agg(
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("e"), F.lit(0)).alias("embedded"), F.coalesce(F.sum("q"), F.lit(0)).alias("questions")
    )
    return joined.withColumns({"can_search": F.col("embedded") > 0, "can_analyse": F.col("questions") > 0})


def best_prompt(questions: DataFrame, links: DataFrame) -> DataFrame:
    """(scope, concept, question_id): the linked question with most marks, then the longest prompt, then the smallest id."""
    met = links.join(questions, "question_id")
    key = F.struct(-F.coalesce("marks", F.lit(0)), -F.length(F.coalesce("prompt_text", F.lit(""))), F.col("question_id"))
    return met.groupBy("scope", "concept").agg(F.min_by("question_id", key).alias("question_id"))


def drop_reasons(rows: DataFrame) -> DataFrame:
    """(reason, n) over (prompt_text, marks, question_number, page): why a row would be left out."""
    blank = F.length(F.trim(F.coalesce("prompt_text", F.lit("")))) == 0
    reasons = F.filter(
        F.array(
            F.when(blank, F.lit("empty")),
            F.when(~blank & (F.length("prompt_text") < 12), F.lit("too_short")),
            F.when(F.col("marks").isNull(), F.lit("no_marks")),
            F.when(main_number(F.col("question_number")).isNull(), F.lit("no_number")),
            F.when(F.col("page").isNull(), F.lit("no_page")),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
