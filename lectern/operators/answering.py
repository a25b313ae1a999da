"""What goes into and comes out of an answer: excerpts, prompts, sources, the questions asked for concepts.

The language model itself is the caller's; everything around it is a column or a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import normalise

EXCERPT = 400
# Presets and the label of what is asked in each.
LABELS = {"study": "Question", "summary": "Topic / question", "flashcards": "Focus topic", "exam": "Exam question / topic"}
# How many parents go into a prompt, by the size of the answer.
PARENTS = {"budget": 4, "balanced": 5, "quality": 6}
#: Alias terms that go into the question asked for a concept.
ALIASES = 4


def excerpt(text: Column, parent: Column, longest: int = EXCERPT) -> Column:
    """The parent's text, or the chunk's without one, cut to ``longest`` characters with an ellipsis."""
    body = F.coalesce(F.nullif(parent, F.lit("")), text)
    return F.when(F.length(body) <= longest, body).otherwise(F.concat(F.rtrim(F.substring(body, 1, longest - 1)), F.lit("…")))


def is_preset(preset: Column) -> Column:
    return F.coalesce(preset.isin(*LABELS), F.lit(False))


def prompts(questions: DataFrame, hits: DataFrame, tier: str = "balanced") -> DataFrame:
    """(query_id, n_parents, prompt): the excerpts of each question's best hits and the question, as a model reads them.

    ``questions`` has (query_id, text, preset), ``hits`` (query_id, rank, filename, page, text, parent_text). The
    first hits go in, as many as the ``tier`` has; questions of no known preset or without hits give no row.
    """
    known = questions.where(is_preset(F.col("preset")))
    best = hits.where(F.col("rank") <= PARENTS.get(tier, PARENTS["budget"]))
    block = F.concat(F.lit("--- "), "filename", F.lit(" (page "), F.col("page").cast("string"), F.lit(") ---\n"), F.coalesce(F.nullif("parent_text", F.lit("")), "text", F.lit("")))
    blocks = best.select("query_id", F.struct("rank", block.alias("block")).alias("b")).groupBy("query_id").agg(F.array_sort(F.collect_list("b")).alias("blocks"))
    label = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))[F.col("preset")]
    prompt = F.concat(F.lit("Excerpts:\n\n"), F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n"), F.lit("\n\n"), label, F.lit(": "), "text")
    return known.join(blocks, "query_id").select("query_id", F.size("blocks").alias("n_parents"), prompt.alias("prompt"))


def sources(hits: DataFrame) -> DataFrame:
    """(query_id, rank, id, document_id, filename, page, excerpt, score) of the hits that an answer cites."""
    return hits.select("query_id", "rank", "id", "document_id", "filename", "page", excerpt(F.col("text"), F.col("parent_text")).alias("excerpt"), "score")


def ordered_terms(label: Column, terms: Column, aliases: Column) -> Column:
    """The label, terms and aliases of a concept with single blanks, each once whatever its case, in this order."""
    clean = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    every = F.transform(F.concat(F.array(label), F.coalesce(terms, F.array().cast("array<string>")), F.coalesce(aliases, F.array().cast("array<string>"))), clean)
    full = F.filter(every, lambda t: t.isNotNull() & (t != ""))
    keys = F.transform(full, F.lower)
    return F.filter(full, lambda t, i: F.array_position(keys, F.lower(t)) == i + 1)


def concept_question(label: Column, terms: Column, aliases: Column, suffix: str = "Use course notes and syllabus.") -> Column:
    """What is asked for a concept: its label and up to four other terms, then the suffix; of none "this topic"."""
    words = ordered_terms(label, terms, aliases)
    others = F.slice(words, 2, ALIASES)
    hint = F.when(F.size(others) > 0, F.concat(F.lit(" (also: "), F.array_join(others, ", "), F.lit(")"))).otherwise("")
    return F.concat(F.lit("Explain "), F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("this topic")), hint, F.lit(". " + suffix))


def answer_tier(has_documents: Column, has_structure: Column) -> Column:
    """1 without study documents, 3 where the course has a structure, else 2."""
    return F.when(~F.coalesce(has_documents, F.lit(False)), 1).when(F.coalesce(has_structure, F.lit(False)), 3).otherwise(2)


def answer_length(marks: Column) -> Column:
    """(tier, length) of an answer by its marks: quality and long from 8, balanced and medium from 4, else budget and short."""
    pair = lambda a, b: F.struct(F.lit(a).alias("tier"), F.lit(b).alias("length"))
    return F.when(marks >= 8, pair("quality", "long")).when(marks >= 4, pair("balanced", "medium")).otherwise(pair("budget", "short"))


def match_topics(topics: DataFrame, units: DataFrame) -> DataFrame:
    """(scope, topic_id, unit_no): the unit of each topic; ``topics`` (scope, topic_id, ordinal, title), ``units`` (scope, unit_no, title), numbered from 0.

    Where a scope has as many topics as units they match by position; else a topic takes the first unit whose
    title holds its title or is held by it.
    """
    placed = topics.withColumn("place", F.row_number().over(Window.partitionBy("scope").orderBy("ordinal", "title", "topic_id")) - 1)
    sizes = topics.groupBy("scope").agg(F.count(F.lit(1)).alias("n_topics")).join(units.groupBy("scope").agg(F.count(F.lit(1)).alias("n_units")), "scope")
    same = sizes.withColumn("positional", F.col("n_topics") == F.col("n_units")).select("scope", "positional")
    met = placed.join(same, "scope").join(units.withColumnRenamed("title", "unit_title"), "scope")
    a, b = F.lower("title"), F.lower("unit_title")
    fits = F.when(F.col("positional"), F.col("place") == F.col("unit_no")).otherwise(F.contains(a, b) | F.contains(b, a))
    return met.where(fits).groupBy("scope", "topic_id").agg(F.min("unit_no").alias("unit_no"))


def unit_documents(matched: DataFrame, documents: DataFrame, syllabus: DataFrame) -> DataFrame:
    """(scope, unit_no, document_ids): the documents of each unit's topics but for the syllabus, by id; ``documents`` (document_id, topic_id)."""
    own = documents.where(F.col("topic_id").isNotNull()).join(syllabus.select("document_id"), "document_id", "left_anti")
    return matched.join(own, "topic_id").groupBy("scope", "unit_no").agg(F.array_sort(F.collect_set("document_id")).alias("document_ids"))


#: Title terms of fewer characters don't count as held; the least score of a match; scores nearer than this go by depth.
LEAST_TERM, ACCEPT, BAND = 3, 0.75, 0.02


def held_score(terms: Column, title: Column) -> Column:
    """1 when the title holds one of the terms or is held by it, else 0."""
    t = normalise(title)
    return F.when(F.exists(terms, lambda x: (F.length(x) >= LEAST_TERM) & (F.contains(t, x) | F.contains(x, t))), 1.0).otherwise(0.0)


def map_to_nodes(concepts: DataFrame, nodes: DataFrame, similarities: DataFrame | None = None) -> DataFrame:
    """(scope, concept, node_id): the node of each concept, null where none fits.

    ``concepts`` (scope, concept, terms) with normalised terms, ``nodes`` (scope, ordinal, node_id, title, depth),
    ``similarities`` (scope, concept, node_id, similarity) of their vectors. A node scores 1 when it holds a term, else
    its similarity; in the nodes' order one replaces the best so far when it is better by more than the band, or
    within it and deeper. The best must reach .75. A scope has some hundred nodes.
    """
    from lectern.operators.concepts import tie_band_match

    met = concepts.join(nodes, "scope")
    if similarities is not None:
        met = met.join(similarities, ["scope", "concept", "node_id"], "left")
    else:
        met = met.withColumn("similarity", F.lit(0.0))
    score = F.greatest(held_score(F.col("terms"), F.col("title")), F.coalesce("similarity", F.lit(0.0)))
    listed = met.groupBy("scope", "concept").agg(F.collect_list(F.struct("ordinal", "node_id", "depth", score.alias("score"))).alias("scores"))
    found = listed.select("scope", "concept", tie_band_match(F.col("scores"), BAND, ACCEPT).alias("node_id"))
    return concepts.select("scope", "concept").join(found, ["scope", "concept"], "left")


def question_terms(text: Column, more: Column) -> Column:
    """The normalised question and further terms, each once."""
    return F.array_distinct(F.filter(F.concat(F.array(normalise(text)), F.transform(F.coalesce(more, F.array().cast("array<string>")), normalise)), lambda t: t != ""))
