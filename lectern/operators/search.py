"""Vector, lexical and metadata search, and the fusion of ranked lists.

Queries are a table; every list keeps query_id, so many questions go through one plan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import LEXICAL_MARKERS, is_lexical_heavy, terms

#: Bytes of query vectors that are broadcast at once; a larger query set goes in blocks.
QUERY_BYTES = 64 << 20


def vector_topk(queries: DataFrame, index: DataFrame, k: int = 40, exclude_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` rows of largest cosine for each query, exactly.

    ``queries`` (query_id, vector) and ``index`` (id, vector). The queries are a stated set; they are
    collected in blocks of bounded size, each task multiplies its rows with a block and keeps its own
    top k, and the tasks' lists are merged. Vectors that are null, of another length, not finite or all
    zero take no part. Score is rounded to 6 decimals, ties go to the smaller id.
    """
    parts = [_vector_block(block, index, k, exclude_self) for block in _query_blocks(queries)]
    if not parts:
        kind = index.schema["id"].dataType
        return queries.select("query_id", F.lit(None).cast(kind).alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where(F.lit(False))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _query_blocks(queries: DataFrame) -> Iterator[tuple[pa.Array, np.ndarray]]:
    ids: list = []
    vectors: list = []
    size = 0
    for row in queries.where(F.col("vector").isNotNull()).orderBy("query_id").toLocalIterator():
        vector = np.array([np.nan if x is None else x for x in row["vector"]], dtype=np.float64)
        norm = np.linalg.norm(vector)
        if not len(vector) or not np.isfinite(norm) or norm == 0 or (vectors and len(vector) != len(vectors[0])):
            continue
        ids.append(row["query_id"])
        vectors.append(vector / norm)
        size += vector.nbytes
        if size >= QUERY_BYTES:
            yield pa.array(ids), np.array(vectors)
            ids, vectors, size = [], [], 0
    if ids:
        yield pa.array(ids), np.array(vectors)


def _vector_block(block: tuple[pa.Array, np.ndarray], index: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(block)
    rows = index.select("id", F.col("vector").cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & (F.size("vector") == block[1].shape[1]))
    id_type = rows.schema["id"].dataType.simpleString()
    query_type = "string" if pa.types.is_string(block[0].type) else "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix = shared.value
        names = query_ids.to_pylist()
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            with np.errstate(all="ignore"):
                units = values / np.linalg.norm(values, axis=1)[:, None]
            good = np.flatnonzero(np.isfinite(units).all(axis=1))
            if not len(good):
                continue
            own = np.array(batch.column(0).to_pylist(), dtype=object)[good]
            scores = np.round(matrix @ units[good].T, 6)
            if exclude_self:
                scores[np.array(names, dtype=object)[:, None] == own[None, :]] = -2
            out: list[list] = [[], [], []]
            most = min(k, len(own))
            for q, line in enumerate(scores):
                least = np.partition(line, len(line) - most)[len(line) - most]
                near = np.flatnonzero((line >= least) & (line >= -1))
                near = near[np.lexsort((own[near], -line[near]))][:most]
                for column, chosen in zip(out, ([names[q]] * len(near), own[near].tolist(), line[near].tolist())):
                    column.extend(chosen)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], block[0].type), pa.array(out[1], batch.column(0).type), pa.array(out[2], pa.float64())], names=["query_id", "id", "score"])

    return rows.mapInArrow(run, f"query_id {query_type}, id {id_type}, score double")


def inverted_index(texts: DataFrame) -> DataFrame:
    """(id, term, tf, positions, length) of ``texts`` (id, text): the postings as a table."""
    listed = texts.where(F.col("text").isNotNull()).select("id", terms(F.col("text")).alias("terms"))
    spread = listed.select("id", F.size("terms").alias("length"), F.posexplode("terms").alias("position", "term"))
    return spread.groupBy("id", "term", "length").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))


def bm25(queries: DataFrame, texts: DataFrame, k: int = 40, require_all: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, matched, rank): Okapi BM25 top ``k`` per query.

    ``queries`` (query_id, term) once per term, ``texts`` (id, text). With ``require_all`` only texts
    that have every term of the query. Ties go to the smaller id. Postings are filtered by the queries'
    terms before they are grouped.
    """
    asked = queries.where(F.col("term").isNotNull()).select("query_id", "term").distinct()
    wanted = asked.select("term").distinct()
    listed = texts.where(F.col("text").isNotNull()).select("id", terms(F.col("text")).alias("terms"))
    sized = listed.select("id", F.size("terms").alias("length"), "terms")
    totals = sized.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("length"), F.lit(1.0)).alias("mean")).first()
    postings = sized.select("id", "length", F.explode("terms").alias("term")).join(wanted, "term", "left_semi").groupBy("term", "id", "length").agg(F.count(F.lit(1)).alias("tf"))
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, mean = float(totals["n"]), float(totals["mean"]) or 1.0
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    counts = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("asked"))
    scored = asked.join(postings, "term").join(frequency, "term").groupBy("query_id", "id").agg(F.round(F.sum(weight), 6).alias("score"), F.count(F.lit(1)).alias("matched"))
    if require_all:
        scored = scored.join(counts, "query_id").where("matched = asked").drop("asked")
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("query_id", "id", "score", "matched", "rank")


def scoped_topk(queries: DataFrame, index: DataFrame, k: int = 40) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` rows of largest cosine among those of each query's scope.

    ``queries`` (query_id, scope, vector), ``index`` (id, scope, vector). A row meets the queries of its own
    scope only; Spark splits the join where a scope is hot, and keeps k rows a query before it shuffles
    them. Vectors as in ``vector_topk``; score is rounded to 6 decimals, ties go to the smaller id.
    """
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", "scope", F.col("vector").cast("array<double>").alias("q"))
    rows = index.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).select("id", "scope", F.col("vector").cast("array<double>").alias("v"))
    met = rows.join(asked, "scope").where(F.size("q") == F.size("v")).select("query_id", "id", "q", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            scores = np.full(batch.num_rows, np.nan)
            q, v = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
            for size in np.unique(sizes[sizes > 0]):
                own = np.flatnonzero(sizes == size)
                begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))[own][:, None] + np.arange(size)
                with np.errstate(all="ignore"):
                    a, b = q[begins], v[begins]
                    scores[own] = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
            good = np.flatnonzero(np.isfinite(scores))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good)), pa.array(np.round(scores[good], 6))], names=["query_id", "id", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in met.schema}
    return _ranked(met.mapInArrow(run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double"), k)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


#: The weight of a matched position in the density ranks.
POSITION = 0.1


def _postings(asked: DataFrame, texts: DataFrame, places: bool) -> DataFrame:
    """(id, scope, term, tf or positions) of the asked terms; texts are split once, other terms leave before any shuffle."""
    wanted = asked.select("term").distinct()
    listed = texts.where(F.col("text").isNotNull() & F.col("id").isNotNull()).select("id", "scope", F.posexplode(terms(F.col("text"))).alias("position", "term"))
    held = F.array_sort(F.collect_list("position")).alias("positions") if places else F.count(F.lit(1)).alias("tf")
    return listed.join(wanted, "term", "left_semi").groupBy("id", "scope", "term").agg(held)


def _asked(queries: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries and texts with a scope; without one all share it."""
    scoped = lambda df: df if "scope" in df.columns else df.withColumn("scope", F.lit(""))
    return scoped(queries).where(F.col("term").isNotNull() & F.col("scope").isNotNull()).select("query_id", "scope", "term").distinct(), scoped(texts)


def any_density(queries: DataFrame, texts: DataFrame, k: int = 40) -> DataFrame:
    """(query_id, id, score, rank) of the texts with any term of the query: .1 for each of their places.

    ``queries`` (query_id, term) and ``texts`` (id, text), both with a scope where searches are scoped. It is
    the cover density of a query whose terms are alternatives, for which each place is a cover of its own.
    """
    asked, texts = _asked(queries, texts)
    found = asked.join(_postings(asked, texts, False), ["scope", "term"]).groupBy("query_id", "id").agg(F.round(F.sum("tf") * POSITION, 6).alias("score"))
    return _ranked(found, k)


def cover_density(queries: DataFrame, texts: DataFrame, k: int = 40) -> DataFrame:
    """(query_id, id, score, rank) of the texts with all terms of the query, by the density of their covers.

    A cover is a shortest stretch that holds every term and no other cover; it adds .1 / (1 + the words in
    it that aren't asked for). ``queries`` and ``texts`` as in ``any_density``. Only texts with all terms are
    gathered, and of each only the positions of the terms.
    """
    asked, texts = _asked(queries, texts)
    need = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    postings = asked.join(_postings(asked, texts, True), ["scope", "term"])
    full = postings.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("have"), F.collect_list(F.struct("term", "positions")).alias("places")).join(need, "query_id").where("have = need")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [round(covers_score([p["positions"] for p in places]), 6) for places in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["query_id", "id", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in full.schema}
    return _ranked(full.select("query_id", "id", "places").mapInArrow(run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double"), k)


def covers_score(lists: Sequence[Sequence[int]]) -> float:
    """The sum over the minimal covers of the sorted position lists, see ``cover_density``."""
    events = sorted((p, i) for i, places in enumerate(lists) for p in places)
    at_least: dict[int, int] = {}
    last: dict[int, int] = {}
    total, begin = 0.0, -1
    for n, (at, which) in enumerate(events):
        last[which] = at
        at_least[at] = n
        if len(last) == len(lists):
            start = min(last.values())
            if start > begin:  # else an inner cover has the same begin and is shorter
                total += POSITION / (1 + (at - start) - (n - at_least[start]))
                begin = start
    return total


def fuse(lists: Sequence[tuple[DataFrame, float]], k: int = 60, top: int = 24) -> DataFrame:
    """Reciprocal rank fusion of (list, weight): (query_id, id, fused, n_lists, rank).

    A list has (query_id, id, rank) with ranks from 1; fused = sum of weight / (k + rank).
    """
    parts = [df.select("query_id", "id", (F.lit(float(w)) / (k + F.col("rank"))).alias("part")) for df, w in lists]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    fused = union.groupBy("query_id", "id").agg(F.round(F.sum("part"), 10).alias("fused"), F.count(F.lit(1)).alias("n_lists"))
    window = Window.partitionBy("query_id").orderBy(F.desc("fused"), "id")
    return fused.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top)


def merge_hits(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """(id, lexical_score, vector_score, match_score) by id; the larger score of an id counts, 0 becomes null."""
    left = lexical.groupBy("id").agg(F.nullif(F.max("score"), F.lit(0.0)).alias("lexical_score"))
    right = vector.groupBy("id").agg(F.nullif(F.max("score"), F.lit(0.0)).alias("vector_score"))
    return left.join(right, "id", "full_outer").withColumn("match_score", F.greatest("lexical_score", "vector_score"))


def list_weights(questions: DataFrame, markers: Sequence[str] = LEXICAL_MARKERS) -> DataFrame:
    """``questions`` (query_id, text) with vector_weight and lexical_weight: .85 and 1.75 for a question
    that holds one of the ``markers`` of lexical questions, else 1 and 1."""
    heavy = is_lexical_heavy(F.col("text"), markers)
    return questions.withColumns({"vector_weight": F.when(heavy, 0.85).otherwise(1.0), "lexical_weight": F.when(heavy, 1.75).otherwise(1.0)})


def fuse_weighted(lists: Sequence[DataFrame], k: int = 60, top: int = 24) -> DataFrame:
    """As ``fuse``, for lists (query_id, id, rank, weight) whose weight differs by query."""
    union = reduce(DataFrame.unionByName, (df.select("query_id", "id", (F.col("weight") / (k + F.col("rank"))).alias("part")) for df in lists))
    fused = union.groupBy("query_id", "id").agg(F.round(F.sum("part"), 10).alias("fused"), F.count(F.lit(1)).alias("n_lists"))
    window = Window.partitionBy("query_id").orderBy(F.desc("fused"), "id")
    return fused.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top)
