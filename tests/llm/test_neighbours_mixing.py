"""Problems 2 and 7."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lectern.llm import mixing, neighbours

V = "chunk_id string, embedding array<float>, embedding_model string, dimensions int, id string"


def table(spark, vectors, extra=()):
    rows = [(f"c{i:04}", [float(x) for x in v], "m", len(v), "clash") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows + [(*r, "clash") for r in extra], V)


def exact(vectors, k):
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    scores = np.round(units @ units.T, 6)
    out = set()
    for i in range(len(units)):
        order = [j for j in np.lexsort((np.arange(len(units)), -scores[i])) if j != i][:k]
        out |= {(min(i, j), max(i, j)) for j in order}
    return out


@pytest.mark.parametrize("cell", [10_000, 60])
def test_recall_against_brute_force(spark, cell):
    random = np.random.default_rng(3)
    centres = random.standard_normal((12, 32))
    vectors = np.round(centres[random.integers(0, 12, 500)] + 0.5 * random.standard_normal((500, 32)), 2).astype(np.float32)
    found = neighbours.most_similar(table(spark, vectors), 5, "m", 32, cell=cell)
    got = {(int(r.chunk_id_a[1:]), int(r.chunk_id_b[1:])) for r in neighbours.pairs(found).collect()}
    true = exact(vectors.astype(np.float64), 5)
    assert len(got & true) / len(true) >= (1.0 if cell == 10_000 else 0.95)


def made(kind, n=12_000, d=384):
    random = np.random.default_rng(5)
    if kind == "clusters":
        return random.standard_normal((60, d))[random.integers(0, 60, n)] + 0.4 * random.standard_normal((n, d))
    if kind == "latent":
        return random.standard_normal((n, 32)) @ random.standard_normal((32, d)) + 0.3 * random.standard_normal((n, d))
    return random.standard_normal((n, d)) + 0.5


def recall(spark, vectors, tmp_path, **how):
    table = pa.table({"chunk_id": [f"c{i:05}" for i in range(len(vectors))], "embedding": pa.array(list(vectors), pa.list_(pa.float32())), "embedding_model": ["m"] * len(vectors)})
    pq.write_table(table, f"{tmp_path}/v.parquet", row_group_size=2000)
    near = {}
    for r in neighbours.most_similar(spark.read.parquet(f"{tmp_path}/v.parquet"), 5, "m", vectors.shape[1], **how).toLocalIterator():
        near.setdefault(int(r.id[1:]), set()).add(int(r.neighbour[1:]))
    units = neighbours._unit(vectors).astype(np.float32)
    hits = 0
    for at in range(0, len(units), 500):
        scores = units[at : at + 500] @ units.T
        scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -9
        hits += sum(len(set(top) & near.get(at + i, set())) for i, top in enumerate(np.argpartition(-scores, 5, axis=1)[:, :5].tolist()))
    assert all(len(n) == 5 for n in near.values()) and len(near) == len(units)
    return hits / 5 / len(units)


@pytest.mark.parametrize("kind", ["clusters", "latent", "blob"])
def test_recall_whatever_the_distribution(spark, tmp_path, kind):
    assert recall(spark, made(kind).astype(np.float32), tmp_path) >= 0.95


@pytest.mark.parametrize("kind", ["clusters", "latent"])
def test_cells_of_residuals_and_blocks(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "MOST_COARSE", 6)
    monkeypatch.setattr(neighbours, "COPYING", 0.0)
    assert recall(spark, made(kind, 4000, 64).astype(np.float32), tmp_path, cell=100, block=150) >= 0.95


def test_blocks_hold_no_more_than_stated():
    random = np.random.default_rng(2)
    vectors = random.standard_normal((3000, 16)).astype(np.float32)
    cells = neighbours.Cells(np.eye(16, dtype=np.float32)[:1])
    batch = neighbours._blocks([([f"v{i}" for i in range(3000)], vectors)], cells, 0.16, {0: (6, 6)})
    sizes = [(r["part"], sum(x & 1 for x in r["roles"]), sum(x >> 1 for x in r["roles"])) for r in batch.to_pylist()]
    assert len(sizes) == 36 and all(q < 600 and m < 600 for _, q, m in sizes)
    assert sum(m for p, _, m in sizes if p < 6) == 3000 and sum(q for p, q, _ in sizes if p % 6 == 0) == 3000


def test_an_id_with_two_vectors_counts_once(spark):
    vectors = np.eye(4, dtype=np.float32) + 0.1
    twice = [("c0000", [9.0, 9.0, 9.0, 1.0], "m", 4), ("c0001", [0.2, 2.2, 0.2, 0.2], "m", 4)]
    first, again = ({(r.id, r.neighbour, r.similarity) for r in neighbours.most_similar(table(spark, vectors, twice).repartition(n, "chunk_id", "embedding"), 3, "m", 4).collect()} for n in (1, 4))
    assert first == again and len(first) == 12


def test_unusable_rows_take_no_part(spark):
    vectors = np.eye(4, dtype=np.float32) + 0.1
    bad = [("n", None, "m", 4), ("z", [0.0] * 4, "m", 4), ("s", [1.0], "m", 4), ("x", [float("nan")] * 4, "m", 4), ("i", [float("inf"), 0.0, 0.0, 0.0], "m", 4), ("p", [1.0, None, 0.0, 0.0], "m", 4), ("o", [1.0] * 4, "old", 4), (None, [1.0] * 4, "m", 4), ("c0000", [float(x) for x in vectors[0]], "m", 4)]
    found = neighbours.most_similar(table(spark, vectors, bad), 5, "m", 4).collect()
    assert {r.id for r in found} == {f"c{i:04}" for i in range(4)} and len(found) == 12
    assert neighbours.most_similar(table(spark, vectors).where("false"), 5, "m", 4).count() == 0
    assert neighbours.most_similar(table(spark, vectors[:1]), 5, "m", 4).count() == 0


def test_many_equal_vectors(spark):
    vectors = np.array([[1.0, 2.0, 3.0, 4.0]] * 30 + [[4.0, 3.0, 2.0, 1.0]] * 2, dtype=np.float32)
    found = neighbours.most_similar(table(spark, vectors), 2, "m", 4).collect()
    near = {}
    for r in found:
        near.setdefault(r.id, set()).add(r.neighbour)
    assert near["c0029"] == {"c0000", "c0001"} and near["c0000"] == {"c0001", "c0002"} and len(near) == 32
    assert "c0031" in near["c0030"]


def test_equal_vectors_find_those_of_their_direction(spark):
    vectors = np.array([[2.0, 4.0, 6.0, 8.0]] + [[1.0, 2.0, 3.0, 4.0]] * 9 + [[4.0, 3.0, 2.0, 1.0]] * 2, dtype=np.float32)
    found = neighbours.most_similar(table(spark, vectors), 2, "m", 4)
    near = {}
    for r in found.collect():
        near.setdefault(r.id, []).append(r.neighbour)
    assert set(near["c0009"]) == set(near["c0004"]) == {"c0000", "c0001"} and all(len(n) == 2 for n in near.values())
    assert {(int(r.chunk_id_a[1:]), int(r.chunk_id_b[1:])) for r in neighbours.pairs(found).collect()} == exact(vectors.astype(np.float64), 2)


def test_packing_loses_nothing():
    random = np.random.default_rng(0)
    for matrix in (random.integers(-50, 50, (7, 12)).astype(np.float32) / 8, random.standard_normal((300, 256)).astype(np.float32)):
        assert (neighbours.unpack(*neighbours.pack(matrix), matrix.shape[1]) == matrix).all()


def test_bounds_hold():
    random = np.random.default_rng(1)
    units = neighbours._unit(random.standard_normal((200, 96)) + 0.3)
    lower, upper = neighbours.OneBitCodes(units).bounds(np.arange(50))
    true = units[:50] @ units.T
    inside = (true >= lower) & (true <= upper)
    assert inside.mean() > 0.995


def test_pfair_keeps_every_source_within_a_block():
    blocks = {"a": 37, "b": 5, "c": 58, "d": 1}
    order = mixing.pfair_order(blocks)
    assert sorted(order) == sorted((s, k) for s, n in blocks.items() for k in range(n))
    total, used = sum(blocks.values()), dict.fromkeys(blocks, 0)
    for slot, (source, _) in enumerate(order, 1):
        used[source] += 1
        assert all(abs(used[s] - slot * n / total) < 1 for s, n in blocks.items())


def sized(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, tokens int")


T = "source string, target_weight double, max_repeats int"


def test_mix_meets_weights_and_caps(spark):
    rows = [(i, "a" if i < 400 else "b", 10 + i % 7) for i in range(430)] + [(900, "b", 0), (901, None, 5), (902, "zero", 9), (903, "unlisted", 9)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 4), ("zero", 0.0, 3), ("none", 0.2, 2), ("nulls", None, None)], T)
    frame = sized(spark, rows)
    mixed = mixing.mix(frame, targets)
    out = mixed.collect()
    assert sorted(r.position for r in out) == list(range(len(out)))
    uses = {}
    for r in out:
        uses.setdefault((r.source, r.doc_id), []).append(r.repeat)
    assert {s for s, _ in uses} == {"a", "b"} and max(map(len, uses.values())) <= 4 and all(len(set(v)) == len(v) for v in uses.values())
    shares = {r.source: r for r in mixing.shares(frame, targets, mixed).collect()}
    assert abs(shares["a"].actual_share - 0.5) < 0.02 and shares["b"].most_repeats == 4
    assert shares["none"].note == "no usable documents" and shares["zero"].note == "weight 0" and len(shares) == 5


def test_a_long_mix_repeats_its_schedule(spark):
    rows = [(i, "abc"[i % 3], 7) for i in range(9000)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 1), ("c", 0.2, 1)], T)
    out = mixing.mix(sized(spark, rows), targets, slots=40, block=70).orderBy("position").collect()
    assert len(out) == 6000 and [r.position for r in out] == list(range(6000))
    used = dict.fromkeys("abc", 0)
    for n, r in enumerate(out, 1):
        used[r.source] += 1
        if n % 10 == 0:  # a block has ten documents
            assert all(abs(used[s] - n * w) <= 10 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    assert mixing.period({"a": 5, "b": 3}, 10) == {"a": 5, "b": 3}
    assert mixing.period({"a": 10**9, "b": 10**9 - 1, "c": 1}, 100) == {"a": 50, "b": 49, "c": 1}


def test_the_order_does_not_depend_on_the_slots(spark):
    rows = [(i, "abc"[i % 3], 7) for i in range(3000)]
    weights = {"a": 0.46, "b": 0.317, "c": 0.223}
    targets = spark.createDataFrame([(s, w, 1) for s, w in weights.items()], T)
    mixes = [mixing.mix(sized(spark, rows), targets, slots=n, block=7).orderBy("position").collect() for n in (40, 20_000)]
    assert mixes[0] == mixes[1]
    held = {s: sum(r.source == s for r in mixes[0]) for s in weights}  # a block has one document
    used = dict.fromkeys(weights, 0)
    for n, r in enumerate(mixes[0], 1):
        used[r.source] += 1
        assert all(abs(used[s] - n * held[s] / len(mixes[0])) < 1 for s in weights)


def test_a_given_size_at_which_caps_bind_is_reported_short(spark):
    rows = [(i, "a" if i < 10 else "b", 10) for i in range(400)]
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], T)
    frame = sized(spark, rows)
    shares = {r.source: r for r in mixing.shares(frame, targets, mixing.mix(frame, targets, total=1000)).collect()}
    assert shares["a"].mixed_tokens == 200 and shares["a"].most_repeats == 2 and shares["b"].mixed_tokens == 800
    assert (shares["a"].reachable_share, shares["a"].actual_share) == (0.5, 0.2)


def test_mix_of_a_given_size_shares_out_what_is_missing():
    supply = [dict(source="a", target_weight=0.5, tokens=100, max_repeats=1), dict(source="b", target_weight=0.3, tokens=1000, max_repeats=1), dict(source="c", target_weight=0.2, tokens=1000, max_repeats=1)]
    assert mixing.quotas(supply, 600) == (600, {"a": 100, "b": 300, "c": 200})
    assert mixing.quotas([], 10) == (0, {}) and mixing.quotas(supply)[0] == 200


def test_empty_mix(spark):
    targets = spark.createDataFrame([("a", 0.5, 1)], T)
    frame = sized(spark, [(1, "b", 3)])
    mixed = mixing.mix(frame, targets)
    assert mixed.count() == 0
    assert mixing.shares(frame, targets, mixed).first().actual_share == 0.0
    assert mixing.shares(frame, targets.where("false"), mixed).count() == 0
