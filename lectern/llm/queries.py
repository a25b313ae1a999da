"""The pN_ queries and, where SQL can state the same result, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import boilerplate, mixing, neardup, neighbours, pii, scanned, splitting, tokens
from lectern.session import cut_lineage, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    lines, _ = boilerplate.repeated_lines(table(spark, folder, "chunks"), table(spark, folder, "documents"))
    return lines.select("chunk_id", "line_no").distinct()


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.without_repeated_lines(table(spark, folder, "chunks"), table(spark, folder, "documents"), min_dates=boilerplate.MIN_DATES)


def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.most_similar(table(spark, folder, "chunk_embeddings"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.pairs(p2_neighbours(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return scanned.damaged_lines(table(spark, folder, "page_texts"))


def p3_pages(spark: SparkSession, folder: str) -> DataFrame:
    return scanned.readable_pages(table(spark, folder, "page_texts"))


def p3_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return scanned.readable_chunks(table(spark, folder, "chunks"), table(spark, folder, "page_texts"))


def _p4_tables(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, t) for t in ("chunk_parents", "chunks", "documents", "chunk_limits")]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.oversized_items(*_p4_tables(spark, folder))


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_all(*_p4_tables(spark, folder))


def _p5_records(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "exam_questions").select(F.lit("exam_questions").alias("item_table"), F.col("question_id").alias("id"), F.col("prompt_text").alias("text"))
    return asked.unionByName(table(spark, folder, "chunks").select(F.lit("chunks").alias("item_table"), F.col("chunk_id").alias("id"), "text"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.pairs(*neardup.links(_p5_records(spark, folder)))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.groups(_p5_records(spark, folder))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"))


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    """Counted once and kept, as the mix reads the sizes twice; three narrow columns of each document."""
    return cut_lineage(tokens.count_tokens(table(spark, folder, "documents").select("doc_id", "source", "text")))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_sized(spark, folder), table(spark, folder, "mix_targets"))


def p7_mix_all(spark: SparkSession, folder: str) -> DataFrame:
    """A mix as large as all documents, at which the caps of small sources bind; p7_shares_all reports what each reaches."""
    sized = _sized(spark, folder)
    return mixing.mix(sized, table(spark, folder, "mix_targets"), total=_all_tokens(sized))


def _all_tokens(sized: DataFrame) -> int:
    return int(sized.agg(F.sum("tokens")).first()[0] or 0)


def p7_shares_all(spark: SparkSession, folder: str) -> DataFrame:
    sized, targets = _sized(spark, folder), table(spark, folder, "mix_targets")
    return mixing.shares(sized, targets, mixing.mix(sized, targets, total=_all_tokens(sized)))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    sized, targets = _sized(spark, folder), table(spark, folder, "mix_targets")
    return mixing.shares(sized, targets, mixing.mix(sized, targets))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.found(table(spark, folder, "documents"))


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    return pii.scan(table(spark, folder, "documents"), clean=True).select("doc_id", "text", F.size("spans").alias("n_pieces"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_neighbours, p3_found, p3_pages, p3_chunks, p4_found, p4_pieces, p5_found, p5_groups, p6_ids, p7_mix, p7_shares, p7_mix_all, p7_shares_all, p8_found, p8_clean)}


_LETTERS = r"lower(regexp_replace(line, '\P{L}+', '', 'g'))"

_SQL = {
    "p1_found": rf"""
        WITH lines AS (
          SELECT DISTINCT c.chunk_id, c.document_id, d.source, unnest(range(len(string_split(c.text, chr(10))))) AS line_no, unnest(string_split(c.text, chr(10))) AS line
          FROM chunks c JOIN documents d USING (document_id) WHERE d.source IS NOT NULL),
        forms AS (SELECT chunk_id, document_id, source, line_no, {_LETTERS} AS form FROM lines),
        sizes AS (SELECT d.source, count(DISTINCT c.document_id) AS n FROM chunks c JOIN documents d USING (document_id) WHERE d.source IS NOT NULL GROUP BY d.source),
        found AS (SELECT f.source, f.form FROM forms f JOIN sizes s USING (source) WHERE length(f.form) >= 8
          GROUP BY f.source, f.form, s.n HAVING count(DISTINCT f.document_id) >= 3 AND count(DISTINCT f.document_id) * 10 >= s.n)
        SELECT DISTINCT chunk_id, CAST(line_no AS INTEGER) AS line_no FROM forms JOIN found USING (source, form)""",
    "p4_found": r"""
        WITH kinds AS (SELECT document_id, coalesce(doc_kind, 'notes') AS doc_kind FROM documents),
        items AS (
          SELECT 'chunk_parents' AS item_table, parent_id AS item_id, text, parent_tokens AS words FROM chunk_parents JOIN kinds USING (document_id) JOIN chunk_limits USING (doc_kind)
          UNION ALL
          SELECT 'chunks', chunk_id, text, child_tokens FROM chunks JOIN kinds USING (document_id) JOIN chunk_limits USING (doc_kind))
        SELECT DISTINCT item_table, item_id FROM items WHERE len(regexp_extract_all(text, '[^ \t\r\n\f\x{00A0}]+')) > words""",
    "p5_found": r"""
        WITH records AS (
          SELECT DISTINCT 'exam_questions' AS item_table, question_id AS id, prompt_text AS text FROM exam_questions WHERE prompt_text IS NOT NULL
          UNION SELECT DISTINCT 'chunks', chunk_id, text FROM chunks WHERE text IS NOT NULL),
        listed AS (SELECT item_table, id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w)) AS w FROM records),
        shingles AS (SELECT DISTINCT item_table, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM listed WHERE len(w) >= 15),
        sizes AS (SELECT item_table, id, count(*) AS n FROM shingles GROUP BY ALL),
        shared AS (SELECT a.item_table, a.id AS id_a, b.id AS id_b, count(*) AS k FROM shingles a JOIN shingles b ON a.item_table = b.item_table AND a.s = b.s AND a.id < b.id GROUP BY ALL)
        SELECT k.item_table, id_a, id_b FROM shared k JOIN sizes x ON x.item_table = k.item_table AND x.id = id_a JOIN sizes y ON y.item_table = k.item_table AND y.id = id_b
        WHERE k / (x.n + y.n - k) >= 0.6""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
