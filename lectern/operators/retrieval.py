"""Hybrid retrieval as one plan: scoped lists, fusion, parents, boosts, gate and budget.

Questions are a table (query_id, scope, text, vector); every step keeps query_id, so many questions of many
courses go through one plan. No list is wider than its top k, so all that follows the lists is small.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import focus_terms, query_terms, terms
from lectern.operators import hints as hinting
from lectern.operators import lookup, ranking, scope, search


@dataclass(frozen=True)
class Settings:
    """The sizes of the lists and the weights of their fusion."""

    list_size: int = 40
    k: int = 60
    fused: int = 24
    kept: int = 6
    focus: float = 1.1
    metadata: float = 0.8
    questions: float = 1.35
    phrases: dict[str, float] = field(default_factory=dict)
    rescues: tuple[tuple[list[str], list[str], float], ...] = ()


def scoped_chunks(chunks: DataFrame, documents: DataFrame, kinds: tuple[str, ...], only: DataFrame | None = None) -> DataFrame:
    """(id, scope, document_id, filename, doc_kind, parent_id, chunk_index, page, text, unit, section, toc): each chunk of the
    ready documents of the kinds once, its document's course as scope; with ``only`` (document_id) of these documents."""
    docs = scope.lane(documents, kinds).where(F.col("course_id").isNotNull()).select("document_id", F.col("course_id").alias("scope"), "filename", "doc_kind")
    if only is not None:
        docs = scope.within(docs, only)
    named = lambda key: F.try_element_at("metadata", F.lit(key))
    once = chunks.where(F.col("chunk_id").isNotNull()).groupBy(F.col("chunk_id").alias("id")).agg(
        *(F.min(c).alias(c) for c in ("document_id", "parent_id", "chunk_index", "page", "text")), F.min(named("unit")).alias("unit"), F.min(named("section_title")).alias("section"), F.min(named("toc_path")).alias("toc")
    )
    return once.join(docs, "document_id")


def hybrid(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, settings: Settings = Settings(), more: DataFrame | None = None) -> DataFrame:
    """(query_id, id, fused, n_lists, rank, vector_score): the fused lists of each question.

    ``chunks`` as ``scoped_chunks`` gives them, ``vectors`` (id, vector). The lists: cosine; all terms of the
    question, by cover density; any focus term in the text, and in the titles; and ``more`` (query_id, id,
    rank), weighted like ranked questions. Weights follow ``search.list_weights``.
    """
    index = vectors.join(chunks.select("id", "scope"), "id")
    near = search.scoped_topk(questions, index, settings.list_size)
    ask = lambda words: questions.select("query_id", "scope", F.explode(words).alias("term"))
    focus = ask(query_terms(focus_terms(F.col("text"))))
    texts = chunks.select("id", "scope", "text")
    titles = chunks.where(F.coalesce("section", "toc").isNotNull()).select("id", "scope", F.concat_ws(" ", "section", "toc").alias("text"))
    full = search.cover_density(ask(F.array_distinct(terms(F.col("text")))), texts, settings.list_size)
    any_text, any_title = (search.any_density(focus, t, settings.list_size) for t in (texts, titles))
    weights = search.list_weights(questions.select("query_id", "text"))
    weigh = lambda df, column, factor=1.0: df.join(weights, "query_id").select("query_id", "id", "rank", (F.col(column) * factor).alias("weight"))
    lists = [weigh(near, "vector_weight"), weigh(full, "lexical_weight"), weigh(any_text, "lexical_weight", settings.focus), weigh(any_title, "lexical_weight", settings.metadata)]
    if more is not None:
        lists.append(more.select("query_id", "id", "rank", F.lit(settings.questions).alias("weight")))
    fused = search.fuse_weighted(lists, settings.k, settings.fused)
    return fused.join(near.select("query_id", "id", F.col("score").alias("vector_score")), ["query_id", "id"], "left")


def question_list(questions: DataFrame, asked: DataFrame, chunks: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, id, rank): the first chunk of the page of each of the ``k`` best exam questions, by any focus term.

    ``asked`` has (question_id, scope, document_id, page, prompt_text) of exam questions, each once.
    """
    focus = questions.select("query_id", "scope", F.explode(query_terms(focus_terms(F.col("text")))).alias("term"))
    hits = search.any_density(focus, asked.select(F.col("question_id").alias("id"), "scope", F.col("prompt_text").alias("text")), k)
    placed = hits.join(asked.select(F.col("question_id").alias("id"), "document_id", "page"), "id").select("query_id", "document_id", "page", "score", F.col("id").alias("question_id"))
    first = lookup.first_per_key(chunks.where(F.col("page").isNotNull()).select("document_id", "page", "chunk_index", "id"), ["document_id", "page"], F.col("chunk_index").asc_nulls_last(), F.col("id")).drop("chunk_index")
    best = placed.join(first, ["document_id", "page"]).groupBy("query_id", "id").agg(F.min_by(F.struct("score", "question_id"), F.struct(-F.col("score"), F.col("question_id"))).alias("b"))
    window = Window.partitionBy("query_id").orderBy(F.desc("b.score"), "b.question_id")
    return best.select("query_id", "id", F.row_number().over(window).alias("rank"))


def with_parents(hits: DataFrame, chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """``hits`` with their chunk's columns and, where it has one, its parent's text and pages."""
    once = parents.groupBy("parent_id").agg(F.min("text").alias("parent_text"), F.min("page_start").alias("parent_start"), F.max("page_end").alias("parent_end"))
    return hits.join(chunks.drop("scope"), "id").join(once, "parent_id", "left")


def rerank(hits: DataFrame, questions: DataFrame, outline_hints: DataFrame, raw: Column, settings: Settings = Settings()) -> DataFrame:
    """``hits`` of ``with_parents`` with page (moved to where the terms stand), score and rank, the best ``settings.kept``.

    ``raw`` is the reranker's score of each hit (of ``ranking.rerank_text``), a column of the hits: the model
    itself is the caller's. ``outline_hints`` has (query_id, units, ranges).
    """
    wanted = focus_terms(F.col("question"))
    rows = hits.join(questions.select("query_id", F.col("text").alias("question")), "query_id").join(outline_hints, "query_id", "left")
    rows = rows.withColumns({"wanted": wanted, "base": ranking.logistic(raw)})
    moved = ranking.estimate_page(F.col("parent_text"), F.col("wanted"), F.col("parent_start"), F.col("parent_end"), F.col("page"), F.col("ranges"))
    rows = rows.withColumn("page", F.coalesce(moved, "page"))
    hay = F.concat_ws(" ", "text", "parent_text")
    body_hits = ranking.term_hits(hay, F.col("wanted"))
    score = ranking.boosted(
        F.col("base"),
        ranking.lexical_bonus(F.col("text"), F.col("wanted"), F.coalesce("parent_text", F.lit(""))),
        ranking.metadata_bonus(F.col("base"), F.col("wanted"), F.col("page"), F.col("unit"), F.col("section"), F.col("toc"), body_hits, F.col("units"), F.col("ranges")),
        ranking.phrase_bonus(F.col("question"), hay, settings.phrases),
        ranking.rescue_bonus(F.col("base"), F.col("question"), hay, list(settings.rescues)),
        -ranking.section_demotion(F.col("page"), F.col("unit"), F.col("units"), F.col("ranges")),
    )
    scored = rows.withColumn("score", F.round(score, 6)).drop("rank", "question", "wanted", "base", "units", "ranges")
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("fused"), "id")
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= settings.kept)


def answerable(questions: DataFrame, ranked: DataFrame, threshold: float, max_tokens: int = 4000) -> tuple[DataFrame, DataFrame]:
    """(context, status): the ranked hits of the questions whose best one passes the gate, their parents cut
    to the budget in rank order; and the status of every question."""
    passed = ranking.confidence_gate(ranked, threshold)
    return ranking.context_budget(passed, max_tokens, text="parent_text"), ranking.gate_status(questions, ranked, threshold)


def outline_hints(questions: DataFrame, outline: DataFrame) -> DataFrame:
    """(query_id, units, ranges) of the questions (query_id, scope, text), by the outlines of their courses."""
    units = hinting.infer_units(questions, hinting.unit_phrases(outline), hinting.unit_terms(outline))
    return hinting.hint_lists(units, hinting.page_ranges(questions, hinting.page_hints(outline)))
