"""Problem 5: records that are nearly the same, by HyperMinHash.

A record is the set of its shingles (runs of consecutive words). Records with the same words in order
form one class and only one of them is sketched. A sketch has a compressed register of 16 bits per hash
function: the count of leading zeros of the smallest hash and the mantissa bits after them. (The registers
have hash functions of their own instead of sharing one by buckets, as most records here have fewer
shingles than a sketch has registers and would leave most buckets empty.) Compressed registers are put
together in bands; classes that agree in a band are candidates. The registers of the two give the Jaccard
estimate, corrected for registers that agree by chance, which depends on both sets' sizes; pairs whose
estimate stays under the threshold by more than four standard deviations are dropped, all others are verified
on their words. As a pair may share many bands, the two lowest bits of all registers travel with the keys and
drop, by the same rule, most unlike pairs where they meet, before pairs are shuffled to be made distinct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.components import components
from lectern.session import cut_lineage

#: Registers, and the bands of ROWS of them; registers are dealt out to the bands, and again when all are used.
REGISTERS, ROWS, BANDS = 84, 3, 42
#: Bits of a compressed register: the leading zeros, 63 at most, and the mantissa.
ZEROS, MANTISSA = 6, 10
#: Distinct words and classes that a worker remembers; beyond it the memory is emptied.
REMEMBERED = 500_000
#: Shingles that are hashed together, so that they stay in the processor's cache.
_TOGETHER = 16_384
#: Band keys, and classes with their sketches (or table and id), up to which they are broadcast instead of shuffled: some 30 MB each.
BROADCAST_KEYS, BROADCAST_SKETCHES = 1_000_000, 120_000
#: Classes of one band key that ``groups`` compares pair by pair; larger keys go by way of their smallest class first.
PAIRED = 16
_LANES, _EVEN = 0x0001000100010001, 0x5555555555555555
_NOT_ASCII = None


class _WordCodes(dict):
    """A word's 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word)
        return code


_codes = _WordCodes()
_ascii = re.compile(r"[a-z0-9]+")


def words(text: str | None) -> list[str]:
    """Longest runs of Unicode letters and digits, lower-cased."""
    global _NOT_ASCII
    if not text:
        return []
    if text.isascii():
        return _ascii.findall(text.lower())
    if _NOT_ASCII is None:
        import regex

        _NOT_ASCII = regex.compile(r"[\p{L}\p{N}]+")
    return [word.lower() for word in _NOT_ASCII.findall(text)]


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): of the shingles of records whose word codes lie one after another in ``codes``."""
    mixed = np.zeros(len(codes) - size + 1, dtype=np.uint64)
    for k in range(size):
        mixed = (mixed ^ codes[k : len(codes) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    counts = lengths - size + 1
    inside = np.ones(len(mixed), dtype=bool)
    for k in range(1, size):  # the shingles that reach into the next record
        ends = (starts + lengths - k)[:-1]
        inside[ends[ends < len(mixed)]] = False
    return _stir(mixed[inside]), np.concatenate(([0], np.cumsum(counts)[:-1]))


def registers(hashes: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """[records, count] uint16: leading zeros of the smallest hash, then MANTISSA bits."""
    draws = np.random.default_rng(20240601)
    factors = draws.integers(1, 2**63, count, dtype=np.uint64) | np.uint64(1)
    shifts = draws.integers(0, 2**63, count, dtype=np.uint64)
    smallest = np.empty((count, len(starts)), dtype=np.uint64)
    room = np.empty_like(hashes)
    for j in range(count):
        np.bitwise_xor(hashes, shifts[j], out=room)
        np.multiply(room, factors[j], out=room)
        np.minimum.reduceat(room, starts, out=smallest[j])
    # the exponent of the double tells the leading zeros, its fraction the bits after the first one
    bits = (smallest >> np.uint64(11)).astype(np.float64).view(np.uint64)
    top = np.uint64(1023 + 52)
    zeros = top - np.minimum(bits >> np.uint64(52), top)
    mantissa = (bits >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    return ((np.minimum(zeros, np.uint64((1 << ZEROS) - 1)) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16).T


def band_keys(registered: np.ndarray) -> np.ndarray:
    """[records, BANDS] int64; the band's number is part of its key."""
    random = np.random.default_rng(77)
    rounds = -(-BANDS * ROWS // REGISTERS)
    places = np.concatenate([np.arange(REGISTERS), *(random.permutation(REGISTERS) for _ in range(rounds - 1))])[: BANDS * ROWS].reshape(BANDS, ROWS)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(registered), 1))
    blocks = registered.astype(np.uint64)[:, places]
    for r in range(ROWS):
        keys = _stir((keys ^ blocks[:, :, r]) * np.uint64(0xD6E8FEB86659FD93))
    return keys.view(np.int64)


def low_bits(registered: np.ndarray) -> np.ndarray:
    """[records, longs] int64: the two lowest bits of each register, 32 registers a long."""
    longs = -(-registered.shape[1] // 32)
    low = np.zeros((len(registered), longs * 32), dtype=np.uint64)
    low[:, : registered.shape[1]] = registered & 3
    places = np.uint64(2) * np.arange(32, dtype=np.uint64)
    return np.bitwise_or.reduce(low.reshape(len(registered), longs, 32) << places, axis=2).view(np.int64)


def packed(registered: np.ndarray) -> np.ndarray:
    """[records, REGISTERS / 4] int64: four registers a long."""
    return np.ascontiguousarray(registered).view(np.int64)


def agree_by_chance(sizes: np.ndarray) -> np.ndarray:
    """[sizes, sizes]: the probability that a register of two sets without a common member agrees.

    A register has a value when the smallest hash of its set lies in the value's interval, which for n
    members has probability (1 - low)^n - (1 - high)^n; the sum goes over all values.
    """
    zeros, mantissa = np.arange(1 << ZEROS)[:, None], np.arange(1 << MANTISSA)[None, :]
    low = np.ldexp(1 + mantissa / (1 << MANTISSA), -zeros - 1)
    high = np.ldexp(1 + (mantissa + 1) / (1 << MANTISSA), -zeros - 1)
    survive = lambda x, n: np.exp(n * np.log1p(-np.minimum(x, 1 - 1e-16)))
    each = np.stack([(survive(low, n) - survive(high, n)).ravel() for n in sizes])
    return each @ each.T


def least_agreeing(threshold: float, deviations: float = 4.0) -> list[list[int]]:
    """How many registers two sets of 2^i and 2^j shingles must share for the pair to stay a candidate.

    The corrected estimate of the similarity is (agreeing / REGISTERS - c) / (1 - c), c the chance of ``agree_by_chance``.
    """
    chance = agree_by_chance(2.0 ** np.arange(_SIZES))
    p = threshold + (1 - threshold) * chance
    return np.maximum(1, np.ceil(REGISTERS * p - deviations * np.sqrt(REGISTERS * p * (1 - p)))).astype(int).tolist()


_SIZES = 24


def sketches(records: DataFrame, size: int = 3, least: int = 15) -> DataFrame:
    """(item_table, id, class, keys array<bigint>, bits array<bigint>, sketch array<bigint>) of the records with enough words.

    A class is a hash of the table and the words in order, so equal texts share one. keys (of the bands), bits
    (``low_bits``) and sketch (the registers, then the number of shingles) come with the first record of a
    class in a task and are null on the others: this pre-aggregation keeps a large group of equal records from
    filling its bands again and again.
    """
    source = records.select("item_table", "id", "text").where(F.col("text").isNotNull() & F.col("id").isNotNull() & F.col("item_table").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: set[int] = set()
        for batch in batches:
            for part in range(0, batch.num_rows, 2048):
                tables, ids, texts = (batch.column(i).slice(part, 2048).to_pylist() for i in range(3))
                found = [(t, i, w) for t, i, text in zip(tables, ids, texts) if len(w := words(text)) >= max(least, size)]
                if not found:
                    continue
                coded = [np.fromiter(map(_codes.__getitem__, w), np.uint64, len(w)) for _, _, w in found]
                classes = [xxhash.xxh64_intdigest(c.tobytes(), seed=xxhash.xxh32_intdigest(t)) for (t, _, _), c in zip(found, coded)]
                new = []
                if len(seen) > REMEMBERED:
                    seen.clear()
                for j, own in enumerate(classes):
                    if own not in seen:
                        seen.add(own)
                        new.append(j)
                made: list[list] = [[None] * len(found) for _ in range(3)]
                for some in _runs(new, coded):
                    lengths = np.array([len(coded[j]) for j in some])
                    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                    hashes, begins = shingle_hashes(np.concatenate([coded[j] for j in some]), starts, lengths, size)
                    own = registers(hashes, begins, REGISTERS)
                    apart = np.array([xxhash.xxh64_intdigest(found[j][0]) for j in some], dtype=np.uint64).view(np.int64)
                    members = np.diff(np.append(begins, len(hashes)))
                    for column, values in zip(made, (band_keys(own) ^ apart[:, None], low_bits(own), np.column_stack([packed(own), members]))):
                        for j, value in zip(some, values):
                            column[j] = value
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t for t, _, _ in found]), pa.array([i for _, i, _ in found]), pa.array(np.array(classes, dtype=np.uint64).view(np.int64)), *(pa.array(m, pa.list_(pa.int64())) for m in made)],
                    names=["item_table", "id", "class", "keys", "bits", "sketch"],
                )

    return source.mapInArrow(run, "item_table string, id string, class long, keys array<long>, bits array<long>, sketch array<long>")


def _runs(chosen: list[int], coded: list[np.ndarray]) -> Iterator[list[int]]:
    """``chosen`` in runs of about _TOGETHER words."""
    some, size = [], 0
    for j in chosen:
        some.append(j)
        size += len(coded[j])
        if size >= _TOGETHER:
            yield some
            some, size = [], 0
    if some:
        yield some


_BITS = [f"bits_{k}" for k in range(-(-REGISTERS // 32))]


def shared_keys(sketched: DataFrame) -> DataFrame:
    """(key, class, bits_0, ...) of the keys that more than one sketch has.

    Keys are counted by an aggregate, so a hot key is one row a task before it is shuffled; only the rows of
    the keys that are left meet them, by a broadcast where they were counted to be few.
    """
    full = sketched.where(F.col("keys").isNotNull())
    often = cut_lineage(full.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    banded = full.select("class", *(F.col("bits")[k].alias(b) for k, b in enumerate(_BITS)), F.explode("keys").alias("key"))
    return banded.join(F.broadcast(often) if often.count() <= BROADCAST_KEYS else often, "key")


def most_different(threshold: float, deviations: float = 4.0) -> int:
    """In how many of the registers' two lowest bits a pair may differ; by chance they agree with a quarter."""
    p = threshold + (1 - threshold) / 4
    return int(np.floor(REGISTERS * (1 - p) + deviations * np.sqrt(REGISTERS * p * (1 - p))))


def bits_differ() -> Column:
    """In how many registers the two lowest bits of a pair differ."""
    differ = F.lit(0)
    for b in _BITS:
        x = F.col(b).bitwiseXOR(F.col(f"{b}_b"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_EVEN)))
    return differ


def may_be_similar(threshold: float) -> Column:
    """Whether the estimate of two sketches, a and b, may reach the threshold."""
    def differ(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for shift in (8, 4, 2, 1):  # the lowest bit of each lane becomes the OR of the lane
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(z.bitwiseAND(F.lit(_LANES)))

    # a fold over the arrays: spelled out, the lanes make more code than the JVM compiles
    held = lambda c: F.slice(c, 1, REGISTERS // 4)
    agree = REGISTERS - F.aggregate(F.zip_with(held("a"), held("b"), differ), F.lit(0), lambda total, x: total + x)
    least = F.array(*(F.array(*map(F.lit, row)) for row in least_agreeing(threshold)))
    rank = lambda n: F.least(F.lit(_SIZES - 1), F.round(F.log2(n)).cast("int"))
    return agree >= least[rank(F.col("a")[REGISTERS // 4])][rank(F.col("b")[REGISTERS // 4])]


class Records:
    """Sketched records: (item_table, id, text) of a table of records, see ``links``."""

    def __init__(self, records: DataFrame, size: int = 3, least: int = 15):
        self.size = size
        self.texts = records.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("item_table", "id", "text")
        self.sketched = sketches(records, size, least).persist(StorageLevel.MEMORY_AND_DISK)
        self.membership = cut_lineage(self.sketched.select("item_table", "id", "class").distinct())
        self.shared = shared_keys(self.sketched)

    def estimated(self, pairs: DataFrame, threshold: float) -> DataFrame:
        """Of ``pairs`` (class_a, class_b, class_a below class_b) those whose estimate may reach the threshold, each once."""
        once = cut_lineage(pairs.distinct())
        asked = once.select(F.explode(F.array("class_a", "class_b")).alias("class")).distinct()
        held = self.sketched.where(F.col("sketch").isNotNull()).select("class", "sketch").join(asked, "class", "left_semi")
        held = held.groupBy("class").agg(F.first("sketch").alias("sketch"))
        few = asked.count() <= BROADCAST_SKETCHES
        side = lambda name: (F.broadcast if few else lambda x: x)(held.select(F.col("class").alias(f"class_{name}"), F.col("sketch").alias(name)))
        return once.join(side("a"), "class_a").join(side("b"), "class_b").where(may_be_similar(threshold)).select("class_a", "class_b")

    def verified(self, pairs: DataFrame, threshold: float) -> DataFrame:
        """(class_a, class_b, similarity) of the estimated ``pairs`` whose similarity, taken over the words, reaches the threshold."""
        candidates = cut_lineage(self.estimated(pairs, threshold))
        asked = candidates.select(F.explode(F.array("class_a", "class_b")).alias("class")).distinct()
        few = asked.count() <= BROADCAST_SKETCHES
        first = self.membership.join(F.broadcast(asked) if few else asked, "class", "left_semi").groupBy("class").agg(F.min(F.struct("item_table", "id")).alias("at"))
        first = first.select("class", "at.item_table", "at.id")
        bodies = self.texts.join(F.broadcast(first) if few else first, ["item_table", "id"]).groupBy("class").agg(F.min("text").alias("text"))
        left = candidates.join(bodies.withColumnsRenamed({"class": "class_a", "text": "text_a"}), "class_a")
        both = left.join(bodies.withColumnsRenamed({"class": "class_b", "text": "text_b"}), "class_b")
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, text_a, text_b = (batch.column(i) for i in range(4))
                similar = [jaccard(x, y, size) for x, y in zip(text_a.to_pylist(), text_b.to_pylist())]
                yield pa.RecordBatch.from_arrays([a, b, pa.array(similar, pa.float64())], names=["class_a", "class_b", "similarity"])

        checked = both.select("class_a", "class_b", "text_a", "text_b").mapInArrow(run, "class_a long, class_b long, similarity double")
        return checked.where(F.col("similarity") >= threshold)


def _pairs_of_keys(shared: DataFrame, threshold: float, apart: bool = False) -> DataFrame:
    """(class_a, class_b) of the classes of a key whose lowest bits may be those of similar sets, with ``apart``
    only of those with different labels."""
    more = ["label"] if apart else []
    other = shared.select("key", *(F.col(c).alias(f"{c}_b") for c in ("class", *_BITS, *more)))
    alike = (F.col("class") < F.col("class_b")) & (bits_differ() <= most_different(threshold))
    met = shared.join(other, "key").where(alike & (F.col("label") != F.col("label_b")) if apart else alike)
    return met.select(F.col("class").alias("class_a"), "class_b")


def links(records: DataFrame, threshold: float = 0.6, size: int = 3, least: int = 15) -> tuple[DataFrame, DataFrame]:
    """(membership, links): (item_table, id, class) of every record, and (class_a, class_b, similarity)
    of every pair of different classes whose Jaccard similarity, taken over the shingles themselves,
    reaches the threshold.

    ``records`` has (item_table, id, text). Null ids and texts, and texts of fewer than ``least`` words,
    take no part; a repeated id counts once by the texts it has. Records of different tables don't meet.
    At similarity 0.6 a pair is missed with probability 0.0002. The sketches, read several times, are
    persisted; they are recomputed should an executor be lost.
    """
    held = Records(records, size, least)
    linked = cut_lineage(held.verified(_pairs_of_keys(held.shared, threshold), threshold))
    held.sketched.unpersist()
    return held.membership, linked


def groups(records: DataFrame, threshold: float = 0.6, size: int = 3, least: int = 15, paired: int = PAIRED) -> DataFrame:
    """(item_table, id, class, group_id): each record once with its class and the smallest class that can be
    reached over links (see ``links``), without going through all pairs of a large group.

    Classes of a key with ``paired`` classes at most are compared pair by pair, those of a larger one with
    its smallest class. Connected components of what is linked then give labels, and only classes of a large
    key whose labels still differ are compared with each other, so no link between texts is lost.
    """
    held = Records(records, size, least)
    shared = cut_lineage(held.shared.distinct())
    ends = shared.groupBy("key").agg(F.min("class").alias("low"), F.count(F.lit(1)).alias("n"))
    small, large = ends.where((F.col("n") > 1) & (F.col("n") <= paired)).select("key"), ends.where(F.col("n") > paired)
    star = shared.join(large, "key").where(F.col("class") > F.col("low")).select(F.col("low").alias("class_a"), F.col("class").alias("class_b"))
    edge = lambda linked: cut_lineage(linked.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    edges = edge(held.verified(_pairs_of_keys(shared.join(small, "key", "left_semi"), threshold).union(star), threshold))
    labels = components(edges)
    rest = shared.join(large.select("key"), "key", "left_semi").join(labels.withColumnRenamed("node", "class"), "class", "left").select("key", "class", *_BITS, F.coalesce("label", "class").alias("label"))
    split = rest.groupBy("key").agg(F.min("label").alias("one"), F.max("label").alias("other")).where("one <> other").select("key")
    rest = cut_lineage(rest.join(split, "key", "left_semi"))
    if not rest.isEmpty():
        later = edge(held.verified(_pairs_of_keys(rest, threshold, apart=True), threshold))
        if not later.isEmpty():
            labels = components(edges.union(later))
    held.sketched.unpersist()
    named = held.membership.join(labels.withColumnRenamed("node", "class"), "class", "left")
    return named.select("item_table", "id", "class", F.coalesce("label", "class").alias("group_id"))


def jaccard(a: str, b: str, size: int = 3) -> float:
    """Of the sets of runs of ``size`` consecutive words; 0 when either has none."""
    sets = []
    for text in (a, b):
        tokens = words(text)
        sets.append(set(zip(*(tokens[k:] for k in range(size)))))
    union = len(sets[0] | sets[1])
    return len(sets[0] & sets[1]) / union if union else 0.0


def pairs(membership: DataFrame, linked: DataFrame) -> DataFrame:
    """(item_table, id_a, id_b): every pair of records within a class and across linked classes, the
    smaller id first. It is as large as its result; ``groups`` states the same without spelling it out.
    """
    a, b = membership.withColumnRenamed("id", "id_a"), membership.select("class", F.col("id").alias("id_b"))
    same = linked.select("class_a", "class_b").unionByName(membership.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("class").alias("class_a"), F.col("class").alias("class_b")))
    met = same.join(a.withColumnRenamed("class", "class_a"), "class_a").join(b.withColumnRenamed("class", "class_b"), "class_b")
    met = met.where((F.col("id_a") < F.col("id_b")) | ((F.col("class_a") != F.col("class_b")) & (F.col("id_a") != F.col("id_b"))))
    return met.select("item_table", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
