"""Problem 2: the most similar vectors of every vector, by randomly rotated one-bit codes (RaBitQ).

A coarse index keeps every vector in its nearest cell (its home) and, as a copy, in others nearly as near.
How near is measured: the exact neighbours of some sampled vectors, searched for among all vectors, tell the
margin at which the wanted share of neighbours have a copy in the home of the vector that asks for them, and
how many cells are cheapest. Cells are coarse centroids, each with all centroids of the residuals, so that
their number grows with the collection while both lists, fitted on a bounded sample, stay small. A cell of
more than BLOCK vectors is cut into blocks that are compared block by block.

In a block, residuals from its mean are normalised, rotated at random and kept as one bit per dimension with
two correction scalars: the residual's length and the inner product of the code with the residual. A query is
quantised to four bits; popcounts of its bit planes with the packed codes estimate all inner products. The
estimate's error bound gives each vector an upper and a lower bound; only those whose upper bound reaches the
k-th largest lower bound are reranked with their exact cosine.

Vectors travel losslessly packed: a block of vectors is a dictionary of its values and small codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import cut_lineage

MODEL = "study-embed-small-v2"
DIMENSIONS = 384
#: Vectors that the centroids are fitted on, about (some 50 MB on the driver).
SAMPLE = 32_768
#: Vectors per cell aimed at; the most coarse and the most residual centroids (12 and 2 MB broadcast). Their
#: product bounds the cells; beyond two billion vectors cells grow and are cut into more blocks.
CELL, MOST_COARSE, MOST_FINE = 512, 8_192, 1_024
#: Vectors of a block, about: a task holds one block of queries and one of members at a time.
BLOCK = 8_192
#: Sampled vectors whose exact neighbours are searched for to choose the margin, and the share of these
#: neighbours that must have a copy where they are asked for. The margin (of squared distance) is MARGIN at least.
ASKED, COVER, MARGIN = 128, 0.985, 0.16
#: Coarse centroids whose residual cells are looked at for copies.
NEAR_COARSE = 16
#: Seconds that a comparison of two codes and the making of one copy take, about; only their ratio matters.
COMPARING, COPYING = 4e-8, 3e-5
#: Standard units of the estimate's error that its bounds allow for.
EPSILON = 3.0
QUERY_BITS = 4
_BUFFER = 20_000


def _matrix(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, float32 matrix) of the vectors of full length with finite values, not all zero."""
    lengths = np.diff(column.offsets.to_numpy())
    full = (lengths == dimensions) & ~np.asarray(column.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    rows = np.flatnonzero(full)
    if not len(rows):
        return rows, np.zeros((0, dimensions), np.float32)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    starts = column.offsets.to_numpy()[rows]
    matrix = values[starts[:, None] + np.arange(dimensions)]
    good = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
    return rows[good], matrix[good]


def _unit(matrix: np.ndarray) -> np.ndarray:
    wide = matrix.astype(np.float64)
    return wide / np.linalg.norm(wide, axis=1)[:, None]


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 5) -> np.ndarray:
    """Unit centroids by spherical k-means; ``cells`` may be lowered to the size of the sample."""
    units = _unit(sample).astype(np.float32)
    random = np.random.default_rng(7)
    cells = max(1, min(cells, len(units)))
    centres = units[random.choice(len(units), cells, replace=False)]
    for _ in range(rounds):
        nearest = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(units, max(1, len(units) // 4096))])
        order = np.argsort(nearest, kind="stable")
        present, begins = np.unique(nearest[order], return_index=True)
        sums = np.add.reduceat(units[order], begins, axis=0)
        norms = np.linalg.norm(sums, axis=1)
        centres[present[norms > 0]] = sums[norms > 0] / norms[norms > 0][:, None]
    return centres


def pack(matrix: np.ndarray) -> tuple[bytes, bytes]:
    """(dictionary, codes), lossless; the dictionary is empty when there are too many different values."""
    codes, values = pd.factorize(matrix.ravel())
    if len(values) > 65_536:
        return b"", matrix.tobytes()
    kind = np.uint8 if len(values) <= 256 else np.uint16
    return values.astype(np.float32).tobytes(), codes.astype(kind).tobytes()


def unpack(dictionary: bytes, codes: bytes, dimensions: int) -> np.ndarray:
    if not dictionary:
        return np.frombuffer(codes, np.float32).reshape(-1, dimensions)
    values = np.frombuffer(dictionary, np.float32)
    return values[np.frombuffer(codes, np.uint8 if len(values) <= 256 else np.uint16)].reshape(-1, dimensions)


_rotations: dict[int, np.ndarray] = {}


def rotation(dimensions: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    if dimensions not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(99).standard_normal((dimensions, dimensions)))
        _rotations[dimensions] = (q * np.sign(np.diag(r))).astype(np.float32)
    return _rotations[dimensions]


class OneBitCodes:
    """Packed codes and correction scalars of the ``members`` (all rows without it) among the vectors of a block."""

    def __init__(self, units: np.ndarray, members: np.ndarray | None = None):
        self.dimensions = units.shape[1]
        self.centre = units.mean(axis=0)
        self.towards = units @ self.centre
        residual = units - self.centre
        self.length = np.linalg.norm(residual, axis=1)
        self.turned = (residual / np.where(self.length > 0, self.length, 1)[:, None]).astype(np.float32) @ rotation(self.dimensions)
        self.members = slice(None) if members is None else members
        turned = self.turned[self.members]
        bits = turned > 0
        width = -(-self.dimensions // 64) * 64
        padded = np.zeros((len(turned), width), dtype=bool)
        padded[:, : self.dimensions] = bits
        self.codes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
        self.ones = bits.sum(axis=1).astype(np.float32)
        agreement = np.abs(turned).sum(axis=1) / np.sqrt(self.dimensions)
        self.agreement = np.where(agreement > 0, agreement, 1.0)
        self.error = EPSILON * np.sqrt(np.maximum(0, 1 - self.agreement**2)) / self.agreement / np.sqrt(max(1, self.dimensions - 1))
        # single precision is enough for bounds that are widened by more than its rounding
        self.towards, self.length, self.agreement, self.error = (x.astype(np.float32) for x in (self.towards, self.length, self.agreement, self.error))
        self.middle = np.float32(self.centre @ self.centre)

    def bounds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) of the cosines of the vectors ``rows``, as queries, with all members."""
        d, q = self.dimensions, self.turned[rows]
        low = q.min(axis=1, keepdims=True)
        step = (q.max(axis=1, keepdims=True) - low) / ((1 << QUERY_BITS) - 1)
        step = np.where(step > 0, step, 1)
        levels = np.rint((q - low) / step).astype(np.uint8)
        width = self.codes.shape[1] * 64
        padded = np.zeros((len(rows), width), dtype=np.uint8)
        padded[:, :d] = levels
        inner = np.zeros((len(rows), len(self.codes)), dtype=np.float32)
        for bit in range(QUERY_BITS):
            plane = np.packbits((padded >> bit) & 1, axis=1, bitorder="little").view(np.uint64)
            count = np.zeros(inner.shape, dtype=np.uint16)
            for word in range(self.codes.shape[1]):
                count += np.bitwise_count(plane[:, word][:, None] & self.codes[None, :, word])
            inner += np.float32(1 << bit) * count
        # <code, query> with code = (2 bit - 1) / sqrt(d) and query = low + step * level
        total = levels.sum(axis=1, dtype=np.float32)[:, None]
        product = (2 * (step * inner + low * self.ones[None, :]) - (step * total + low * d)) * np.float32(1 / np.sqrt(d))
        scale = self.length[rows][:, None] * self.length[self.members][None, :]
        base = self.towards[rows][:, None] + self.towards[self.members][None, :] - self.middle
        estimate = product / self.agreement[None, :] * scale + base
        # the query's own rounding adds an error of up to half a step per dimension, small beside the bound
        slack = (self.error[None, :] + np.float32(EPSILON / np.sqrt(12)) * step / self.agreement[None, :]) * scale + np.float32(1e-5)
        return estimate - slack, estimate + slack


def nearest(ids: np.ndarray, units: np.ndarray, queries: np.ndarray, members: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, rows of its k most similar members, cosines rounded to 6 decimals) of each query row.

    ``queries`` and ``members`` are row numbers, both rising; ``ids`` are sorted, so that ties go to the smaller id.
    """
    n = len(members)
    if not n or not len(queries):
        return
    codes = OneBitCodes(units, members)
    mine = units[members]
    block = max(1, min(64, 2_000_000 // n))
    for at in range(0, len(queries), block):
        rows = queries[at : at + block]
        lower, upper = codes.bounds(rows)
        own = members[None, :] == rows[:, None]
        lower[own] = upper[own] = -np.inf
        kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(rows), -np.inf)
        close = (upper >= kth[:, None]) & ~own
        # where the bounds leave most vectors one product of matrices is cheaper than many of rows
        every = units[rows] @ mine.T if close.sum() * 8 > close.size else None
        for i, row in enumerate(rows):
            near = np.flatnonzero(close[i])
            cosine = np.round(mine[near] @ units[row] if every is None else every[i, near], 6)
            if len(near) > 4 * k:
                kept = cosine >= np.partition(cosine, len(near) - k)[len(near) - k]
                near, cosine = near[kept], cosine[kept]
            first = np.lexsort((near, -cosine))[:k]
            yield row, members[near[first]], cosine[first]


class Cells:
    """Where vectors belong. A cell is a coarse centroid plus one of the residuals' centroids."""

    def __init__(self, coarse: np.ndarray, fine: np.ndarray | None = None):
        self.coarse, self.fine = coarse, fine
        self.wide = 1 if fine is None else len(fine)
        self.half = (coarse**2).sum(axis=1) / 2
        if fine is not None:
            self.half_sums = ((coarse**2).sum(axis=1)[:, None] + 2 * coarse @ fine.T + (fine**2).sum(axis=1)[None, :]) / 2

    def __len__(self) -> int:
        return len(self.coarse) * self.wide

    def scores(self, units: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
        """(cells, scores) of each vector, cells None for all in order; a larger score is a smaller distance."""
        first = units @ self.coarse.T
        if self.fine is None:
            return None, first - self.half
        top = min(NEAR_COARSE, len(self.coarse))
        chosen = np.argpartition(self.half - first, top - 1, axis=1)[:, :top]
        scores = np.take_along_axis(first, chosen, 1)[:, :, None] + (units @ self.fine.T)[:, None, :] - self.half_sums[chosen]
        cells = chosen[:, :, None] * self.wide + np.arange(self.wide)
        return cells.reshape(len(units), -1), scores.reshape(len(units), -1)

    def of(self, units: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, home) of the cells that each vector goes to."""
        parts, rows = [], max(1, 2_000_000 // (len(self) if self.fine is None else NEAR_COARSE * self.wide))
        for at in range(0, len(units), rows):
            cells, scores = self.scores(units[at : at + rows])
            i, j = np.nonzero(scores >= scores.max(axis=1, keepdims=True) - margin / 2)
            parts.append((i + at, j if cells is None else cells[i, j], j == scores.argmax(axis=1)[i]))
        return tuple(np.concatenate(p) for p in zip(*parts))

    def excess(self, asking: np.ndarray, found: np.ndarray) -> np.ndarray:
        """How much margin (of squared distance) gives each found vector a copy in the home of the asking one."""
        out = []
        for at in range(0, len(asking), 64):
            cells, scores = self.scores(asking[at : at + 64])
            home = scores.argmax(axis=1) if cells is None else cells[np.arange(len(scores)), scores.argmax(axis=1)]
            cells, scores = self.scores(found[at : at + 64])
            there = scores[np.arange(len(scores)), home] if cells is None else np.where(cells == home[:, None], scores, -np.inf).max(axis=1)
            out.append(2 * (scores.max(axis=1) - there))
        return np.concatenate(out)


def fit(units: np.ndarray, cells: int) -> Cells:
    """About so many cells, fitted on the sample ``units``."""
    coarse = fit_cells(units, min(cells, MOST_COARSE))
    wide = min(-(-cells // MOST_COARSE), MOST_FINE)
    if wide == 1:
        return Cells(coarse)
    near = np.concatenate([(part @ coarse.T).argmax(axis=1) for part in np.array_split(units, max(1, len(units) // 4096))])
    residual = units - coarse[near]
    random = np.random.default_rng(11)
    fine = residual[random.choice(len(units), min(wide, len(units)), replace=False)]
    for _ in range(5):
        nearest_fine = np.concatenate([(part @ fine.T - (fine**2).sum(axis=1) / 2).argmax(axis=1) for part in np.array_split(residual, max(1, len(units) // 4096))])
        for c in range(len(fine)):
            if (own := nearest_fine == c).any():
                fine[c] = residual[own].mean(axis=0)
    return Cells(coarse, fine)


def choose(sample: np.ndarray, asking: np.ndarray, found: np.ndarray, n: int, cell: int, cover: float) -> tuple[Cells, float]:
    """(cells, margin) of the least expected cost at which ``cover`` of the pairs asking, found meet.

    From n / cell cells on, each next trial has a quarter; with one cell all vectors meet.
    """
    best, cells = None, max(1, n // cell)
    some = sample[:2048]
    while True:
        fitted = fit(sample, cells)
        margin = MARGIN
        if len(asking) and len(fitted) > 1:
            excess = np.sort(fitted.excess(asking, found))
            margin = max(margin, float(excess[min(len(excess) - 1, int(np.ceil(cover * len(excess))) - 1)]) + 1e-6)
        copies = len(fitted.of(some, margin)[0]) / max(1, len(some)) if margin < np.inf else float(len(fitted))
        held = copies * n / len(fitted)
        cost = held * COMPARING + copies * max(1.0, held / BLOCK) * COPYING
        if margin < np.inf and (best is None or cost < best[0]):
            best = (cost, fitted, margin)
        if len(fitted) == 1 or copies <= 4:
            return best[1], best[2]
        cells = len(fitted) // 4 or 1


def usable(embeddings: DataFrame, model: str | None, id_col: str, vector_col: str, model_col: str) -> DataFrame:
    rows = embeddings.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    if model is not None:
        rows = rows.where(F.col(model_col) == model)
    return rows.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))


def most_similar(
    embeddings: DataFrame,
    k: int = 5,
    model: str | None = MODEL,
    dimensions: int = DIMENSIONS,
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
    model_col: str = "embedding_model",
    cell: int = CELL,
    cover: float = COVER,
    sample: int = SAMPLE,
    block: int = BLOCK,
) -> DataFrame:
    """(id, neighbour, similarity): the ``k`` most similar other vectors of each usable vector, fewer
    where the index holds fewer near it.

    Usable are rows of ``model`` (of any with None) with an id and a vector of ``dimensions`` finite
    values that aren't all zero. A repeated row counts once; of an id's different vectors the one of the
    smallest hash counts. Similarity is the cosine rounded to 6 decimals, ties go to the smaller id. Of vectors
    of one direction (so near that their cosine rounds to 1) the k + 1 smallest ids are indexed; the others'
    answer is the best k of the smallest ids among them and of what the first of them finds. Empty tables give no rows.
    """
    rows = usable(embeddings, model, id_col, vector_col, model_col)
    spark = rows.sparkSession
    directions = cut_lineage(_directions(rows, dimensions))
    n = directions.count()
    surplus = _surplus(directions, k)
    extra = surplus.where(F.col("place") > k + 1) if surplus is not None else None
    conflicts = directions.groupBy("id").agg(F.min("same").alias("only"), F.max("same").alias("other")).where("only <> other").select("id", "only")
    marks = conflicts.withColumn("out", F.lit(False)) if not conflicts.isEmpty() else None
    if extra is not None:
        left_out = extra.select("id", F.lit(None).cast("long").alias("only"), F.lit(True).alias("out")).distinct()
        marks = left_out if marks is None else marks.unionByName(left_out).groupBy("id").agg(F.max("only").alias("only"), F.max("out").alias("out"))
    if marks is not None:
        rows = rows.join(cut_lineage(marks), "id", "left").where(F.coalesce(~F.col("out"), F.lit(True))).select("id", "vector", "only")
    else:
        rows = rows.select("id", "vector", F.lit(None).cast("long").alias("only"))
    units = _sampled(rows, dimensions, sample / max(1, n))
    if not len(units):
        return spark.createDataFrame([], "id string, neighbour string, similarity double")
    asking, found = _calibration(rows, units[:ASKED], dimensions, k) if n > 2 * cell else (units[:0], units[:0])
    cells, margin = choose(units, asking, found, n, cell, cover)
    index = spark.sparkContext.broadcast(cells)

    def kept(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
        at, matrix = _matrix(batch.column(1), dimensions)
        only = batch.column(2)
        if len(at) and only.null_count < len(only):
            asked = only.take(pa.array(at)).to_numpy(zero_copy_only=False)
            same = np.isnan(asked.astype(np.float64)) | (asked == direction_hashes(_unit(matrix))) if asked.dtype != np.int64 else asked == direction_hashes(_unit(matrix))
            at, matrix = at[same], matrix[same]
        return batch.column(0).take(pa.array(at)), matrix

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            _, matrix = kept(batch)
            if len(matrix):
                _, cell, home = index.value.of(_unit(matrix).astype(np.float32), margin)
                names, at = np.unique(cell, return_inverse=True)
                for name, both in zip(names.tolist(), np.stack([np.bincount(at), np.bincount(at, home)], axis=1).astype(np.int64)):
                    held[name] = held[name] + both if name in held else both
        both = np.array(list(held.values()), dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["cell", "members", "homes"])

    splits: dict[int, tuple[int, int]] = {}
    if n > block:
        sizes = rows.mapInArrow(count, "cell long, members long, homes long").groupBy("cell").agg(F.sum("members").alias("members"), F.sum("homes").alias("homes")).where(F.col("members") > block)
        # at most copies * n / block rows; they are known before any vector is moved
        splits = {r["cell"]: (-(-r["members"] // block), max(1, -(-r["homes"] // block))) for r in sizes.toLocalIterator()}
    parts = spark.sparkContext.broadcast(splits)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, np.ndarray]] = []
        size = 0
        for batch in batches:
            ids, matrix = kept(batch)
            if len(ids):
                held.append((ids.to_pylist(), matrix))
                size += len(ids)
            if size >= _BUFFER:
                yield _blocks(held, index.value, margin, parts.value)
                held, size = [], 0
        if held:
            yield _blocks(held, index.value, margin, parts.value)

    blocks = rows.mapInArrow(assign, "cell long, part long, ids array<string>, roles array<tinyint>, dictionary binary, codes binary")

    def search(table: pa.Table) -> pa.Table:
        ids = np.array([i for part in table.column("ids").to_pylist() for i in part], dtype=object)
        roles = np.array([r for part in table.column("roles").to_pylist() for r in part], dtype=np.int8)
        matrix = np.concatenate([unpack(d, c, dimensions) for d, c in zip(table.column("dictionary").to_pylist(), table.column("codes").to_pylist())])
        ids, first = np.unique(ids.astype(str), return_index=True)
        all_roles = np.zeros(len(ids), dtype=np.int8)
        np.bitwise_or.at(all_roles, np.searchsorted(ids, np.array([i for part in table.column("ids").to_pylist() for i in part]).astype(str)), roles)
        out: tuple[list, list, list] = ([], [], [])
        for row, near, cosine in nearest(ids, _unit(matrix[first]), np.flatnonzero(all_roles & _QUERY), np.flatnonzero(all_roles & _MEMBER), k):
            out[0].extend([ids[row]] * len(near))
            out[1].extend(ids[near])
            out[2].extend(cosine.tolist())
        return pa.table({"id": pa.array(out[0], pa.string()), "neighbour": pa.array(out[1], pa.string()), "similarity": pa.array(out[2], pa.float64())})

    found = blocks.groupBy("cell", "part").applyInArrow(search, "id string, neighbour string, similarity double")
    best = lambda key: Window.partitionBy(key).orderBy(F.desc("similarity"), "neighbour")
    if splits:
        found = found.withColumn("rank", F.row_number().over(best("id"))).where(F.col("rank") <= k).drop("rank")
    if extra is None:
        return found
    found = cut_lineage(found)
    few = surplus.where(F.col("place") <= k).select("same", F.col("id").alias("neighbour"), F.lit(1.0).alias("similarity"))
    theirs = found.join(surplus.where(F.col("place") == 1).select("same", "id"), "id").select("same", "neighbour", "similarity")
    merged = few.union(theirs).groupBy("same", "neighbour").agg(F.max("similarity").alias("similarity"))
    answer = merged.withColumn("rank", F.row_number().over(best("same"))).where(F.col("rank") <= k).drop("rank")
    return found.unionByName(extra.join(answer, "same").select("id", "neighbour", "similarity"))


#: Sides of a coordinate's grid within which vectors count as one direction: their cosine is over 0.9999999.
_GRID = 40_000
_QUERY, _MEMBER = 1, 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def direction_hashes(units: np.ndarray) -> np.ndarray:
    """int64, equal for vectors of one direction whatever their length (but for those at a side of the grid)."""
    places = np.rint(units * _GRID).astype(np.int64).view(np.uint64)
    factors = np.random.default_rng(5).integers(1, 2**63, units.shape[1], dtype=np.uint64) | np.uint64(1)
    return _mixed((places * factors).sum(axis=1, dtype=np.uint64)).view(np.int64)


def _id_hashes(ids: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(i) for i in ids), np.uint64, len(ids))


def _directions(rows: DataFrame, dimensions: int) -> DataFrame:
    """(id, same) of the good vectors, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, matrix = _matrix(batch.column(1), dimensions)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(direction_hashes(_unit(matrix)))], names=["id", "same"])

    return rows.mapInArrow(run, "id string, same long").distinct()


def _surplus(directions: DataFrame, k: int) -> DataFrame | None:
    """(same, id, place) of the vectors of a direction that stands under more than k + 1 ids; None if there are none.

    Only hashes and ids are shuffled.
    """
    narrow = directions.select("same", "id")
    often = narrow.groupBy("same").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select("same")
    if often.isEmpty():
        return None
    window = Window.partitionBy("same").orderBy("id")
    return narrow.join(often, "same", "left_semi").withColumn("place", F.row_number().over(window))


def _sampled(rows: DataFrame, dimensions: int, share: float) -> np.ndarray:
    """Unit vectors of the ids with the smallest hashes, about that share of all, in an order of their own."""
    bound = int(min(1.0, share) * (2**31 - 1))
    table = rows.where(F.pmod(F.xxhash64("id"), F.lit(2**31 - 1)) <= bound).select("id", "vector").toArrow().sort_by("id")
    matrices = [_matrix(part, dimensions)[1] for part in table.column("vector").chunks]
    matrix = np.concatenate(matrices) if matrices else np.zeros((0, dimensions), np.float32)
    return _unit(matrix[np.random.default_rng(13).permutation(len(matrix))]).astype(np.float32)


def _calibration(rows: DataFrame, asking: np.ndarray, dimensions: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(asking vector, found vector) of each of the k most similar of all vectors to each of ``asking``.

    A fixed number of queries against all rows: a task gives k rows a query.
    """
    shared = rows.sparkSession.sparkContext.broadcast(asking)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        scores = np.full((len(queries), 0), 0, np.float32)
        vectors = np.zeros((0, dimensions), np.float32)
        which = np.zeros((len(queries), 0), np.int64)
        for batch in batches:
            _, matrix = _matrix(batch.column(1), dimensions)
            if not len(matrix):
                continue
            units = _unit(matrix).astype(np.float32)
            new = queries @ units.T
            new[new > 0.999999] = -2  # the vector itself and its copies, which share its cells anyhow
            both, numbers = np.concatenate([scores, new], axis=1), np.concatenate([which, np.tile(np.arange(len(units)) + len(vectors), (len(queries), 1))], axis=1)
            top = np.argpartition(-both, min(k, both.shape[1]) - 1, axis=1)[:, :k]
            scores, which = np.take_along_axis(both, top, 1), np.take_along_axis(numbers, top, 1)
            used, back = np.unique(which, return_inverse=True)
            vectors, which = np.concatenate([vectors, units])[used], back.reshape(which.shape)
        i, j = np.nonzero(scores > -2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(scores[i, j].astype(np.float64)), pa.array([v for v in vectors[which[i, j]]], pa.list_(pa.float32()))], names=["asked", "similarity", "vector"]
        )

    found = rows.mapInArrow(run, "asked int, similarity double, vector array<float>").distinct()
    best = Window.partitionBy("asked").orderBy(F.desc("similarity"), "vector")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).toArrow()
    vectors = np.concatenate([_matrix(part, dimensions)[1] for part in top.column("vector").chunks]) if top.num_rows else asking[:0]
    return asking[top.column("asked").to_numpy()] if top.num_rows else asking[:0], vectors


def _blocks(held: list[tuple[list, np.ndarray]], cells: Cells, margin: float, splits: dict[int, tuple[int, int]]) -> pa.RecordBatch:
    """One row per cell and part: the vectors that it gets from these, and whether they ask, are asked or both.

    ``splits`` has (blocks of members, blocks of queries) of the cells that are cut; part = query block * member blocks + member block.
    """
    ids = np.array([i for part, _ in held for i in part], dtype=object)
    matrix = np.concatenate([m for _, m in held])
    row, cell, home = cells.of(_unit(matrix).astype(np.float32), margin)
    part, role = np.zeros(len(row), np.int64), np.where(home, _QUERY | _MEMBER, _MEMBER).astype(np.int8)
    if splits:
        hashes = _id_hashes(ids.tolist())
        cut = np.isin(cell, np.fromiter(splits, np.int64, len(splits)))
        rows, cells_, parts, roles = [row[~cut]], [cell[~cut]], [part[~cut]], [role[~cut]]
        for c in np.unique(cell[cut]):
            here = np.flatnonzero(cell == c)
            members, queries = splits[int(c)]
            own = (hashes[row[here]] % np.uint64(members)).astype(np.int64)
            for q in range(queries):
                rows.append(row[here]), cells_.append(cell[here]), parts.append(q * members + own), roles.append(np.full(len(here), _MEMBER, np.int8))
            here = here[home[here]]
            own = ((hashes[row[here]] >> np.uint64(20)) % np.uint64(queries)).astype(np.int64)
            for m in range(members):
                rows.append(row[here]), cells_.append(cell[here]), parts.append(own * members + m), roles.append(np.full(len(here), _QUERY, np.int8))
        row, cell, part, role = map(np.concatenate, (rows, cells_, parts, roles))
    order = np.lexsort((part, cell))
    row, cell, part, role = row[order], cell[order], part[order], role[order]
    begins = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])))) if len(row) else np.zeros(0, np.int64)
    out: list[list] = [[], [], [], [], [], []]
    for a, b in zip(begins, [*begins[1:], len(row)]):
        dictionary, codes = pack(matrix[row[a:b]])
        for column, value in zip(out, (int(cell[a]), int(part[a]), ids[row[a:b]].tolist(), role[a:b], dictionary, codes)):
            column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int8()), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=["cell", "part", "ids", "roles", "dictionary", "codes"])


def pairs(found: DataFrame) -> DataFrame:
    """(chunk_id_a, chunk_id_b), the smaller id first, of every pair of which one is among the other's."""
    return found.select(F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")).distinct()
