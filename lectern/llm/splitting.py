"""Problem 4: cutting texts that are too large at natural boundaries.

The strength of the boundary before each word is put into a sparse table of range maxima. A piece ends
at the strongest boundary of its permissible window, the rightmost of equals, found with one look-up;
the next piece begins the overlap before that end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.running import running_sum
from lectern.session import cut_lineage

#: A word is a longest run of characters other than these.
_BLANKS = " \t\r\n\f\u00a0"
_WORD = re.compile(f"[^{_BLANKS}]+")
WORD_PATTERN = r"[^ \t\r\n\f\u00A0]+"
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’)\]]*\r?$")
_CLAUSE = re.compile(r"[,;:—][\"'”’)\]]*$")
_ITEM = re.compile(r"^(?:[-*•»]|\d+[.)]|\([a-z0-9]\))$")
PARAGRAPH, SENTENCE_LINE, SENTENCE, LINE, CLAUSE = 5, 4, 3, 2, 1


def strengths(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Of the boundary before each word; at 0 of the text's begin."""
    out = np.zeros(len(spans), dtype=np.int64)
    for i in range(1, len(spans)):
        end, start = spans[i - 1][1], spans[i][0]
        gap = text[end:start]
        lines = gap.count("\n")
        last = text[spans[i - 1][0] : end]
        sentence = _SENTENCE.search(last) is not None
        if lines > 1 or "\f" in gap:
            out[i] = PARAGRAPH
        elif lines:
            out[i] = SENTENCE_LINE if sentence or _ITEM.match(text[start : spans[i][1]]) else LINE
        elif sentence:
            out[i] = SENTENCE
        elif _CLAUSE.search(last):
            out[i] = CLAUSE
    return out


class RangeMaximum:
    """The index of the largest value of any range, the rightmost of equals, in constant time."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.keys = [values.astype(np.int64) * (n + 1) + np.arange(n)]
        self.n = n
        width = 1
        while 2 * width <= n:
            below = self.keys[-1]
            self.keys.append(np.maximum(below[:-width], below[width:]))
            width *= 2

    def best(self, low: int, high: int) -> int:
        """Over low..high, both inclusive."""
        level = (high - low + 1).bit_length() - 1
        row = self.keys[level]
        return int(max(row[low], row[high - (1 << level) + 1])) % (self.n + 1)


def cut_points(strength: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Word ranges (start, end) that cover all words, each of at most ``limit`` words."""
    n = len(strength)
    if n <= limit:
        return [(0, n)]
    overlap = max(0, min(overlap, limit // 2 - 1))
    least = max(overlap + 1, -(-limit // 2))
    table, out, start = RangeMaximum(strength), [], 0
    while n - start > limit:
        end = table.best(start + least, start + limit)
        out.append((start, end))
        start = end - overlap
    return [*out, (start, n)]


def split_text(text: str, limit: int, overlap_ratio: float) -> list[tuple[str, int, int, int]]:
    """(piece, words, start, end) with positions in ``text``; one piece when the text is within the limit."""
    spans = [m.span() for m in _WORD.finditer(text)]
    if len(spans) <= limit:
        return [(text, len(spans), 0, len(text))]
    ranges = cut_points(strengths(text, spans), limit, round(limit * overlap_ratio))
    return [(text[spans[a][0] : spans[b - 1][1]], b - a, spans[a][0], spans[b - 1][1]) for a, b in ranges]


def _pages(text: str, first: int, last: int, starts: list[int]) -> list[int]:
    """The page at each position. Pages of a parent are joined by a blank line; where there are as many
    blank lines as page changes each ends a page, else pages are shared out by position."""
    if last <= first:
        return [first] * len(starts)
    breaks = [m.end() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    if len(breaks) == last - first:
        return [first + int(np.searchsorted(breaks, s, side="right")) for s in starts]
    return [min(last, first + int(s / max(1, len(text)) * (last - first + 1))) for s in starts]


def split_oversized(items: DataFrame) -> DataFrame:
    """``items`` (item_id, text, max_words, overlap_ratio, page_start, page_end) cut into pieces.

    One row (item_id, piece_no, text, token_count, page) per piece; an item within its limit is one
    piece, unchanged. Words are counted in the JVM and only larger texts go through Python. Null text
    gives one piece with null text and 0 words, an empty text one empty piece, a limit that is null or
    below 1 counts as no limit, a null overlap_ratio as 0. Repeated items give their pieces again.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0))
    counted = items.select(
        "item_id",
        "text",
        F.when(F.col("max_words") >= 1, F.col("max_words")).alias("max_words"),
        F.coalesce("overlap_ratio", F.lit(0.0)).alias("overlap_ratio"),
        F.coalesce("page_start", F.lit(1)).alias("page_start"),
        F.coalesce("page_end", "page_start", F.lit(1)).alias("page_end"),
        words.alias("words"),
    )
    small = counted.where(F.col("max_words").isNull() | (F.col("words") <= F.col("max_words")))
    large = counted.where(F.col("words") > F.col("max_words")).drop("words")
    id_type = items.schema["item_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple] = []
            for item, text, limit, ratio, first, last in frame.itertuples(index=False):
                pieces = split_text(text, int(limit), ratio)
                pages = _pages(text, int(first), int(last), [p[2] for p in pieces])
                out += [(item, i, p[0], p[1], page) for i, (p, page) in enumerate(zip(pieces, pages))]
            yield pd.DataFrame(out, columns=["item_id", "piece_no", "text", "token_count", "page"])

    cut = large.mapInPandas(run, f"item_id {id_type}, piece_no int, text string, token_count int, page int")
    whole = small.select("item_id", F.lit(0).alias("piece_no"), "text", F.col("words").cast("int").alias("token_count"), F.col("page_start").cast("int").alias("page"))
    return whole.unionByName(cut)


def with_limits(items: DataFrame, documents: DataFrame, limits: DataFrame, limit_col: str, default_kind: str = "notes") -> DataFrame:
    """``items`` (item_id, document_id, text, page_start, page_end) with max_words and overlap_ratio of
    the document's kind; null and unknown kinds, and items without a document, count as ``default_kind``.

    ``limits`` has one row per kind, a list of kinds that doesn't grow, hence broadcast.
    """
    rules = limits.where(F.col("doc_kind").isNotNull()).select("doc_kind", F.col(limit_col).alias("max_words"), "overlap_ratio")
    fallback = rules.where(F.col("doc_kind") == default_kind).agg(F.min("max_words"), F.min("overlap_ratio")).first()
    kinds = documents.where(F.col("document_id").isNotNull()).select("document_id", F.coalesce("doc_kind", F.lit(default_kind)).alias("doc_kind"))
    joined = items.join(kinds, "document_id", "left").join(F.broadcast(rules), "doc_kind", "left")
    known = F.col("max_words").isNotNull()
    return joined.select(
        "item_id", "text", "page_start", "page_end",
        F.coalesce("max_words", F.lit(fallback[0])).alias("max_words"),
        F.when(known, F.col("overlap_ratio")).otherwise(F.lit(fallback[1])).alias("overlap_ratio"),
    )


def parent_items(parents: DataFrame) -> DataFrame:
    return parents.select(F.struct(F.lit("chunk_parents").alias("item_table"), F.col("parent_id").alias("item_id")).alias("item_id"), "document_id", "text", "page_start", "page_end")


def chunk_items(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.struct(F.lit("chunks").alias("item_table"), F.col("chunk_id").alias("item_id")).alias("item_id"), "document_id", "text", F.col("page").alias("page_start"), F.col("page").alias("page_end"))


def oversized_items(parents: DataFrame, chunks: DataFrame, documents: DataFrame, limits: DataFrame) -> DataFrame:
    """(item_table, item_id) of every text that the splitter cuts, each once.

    Texts within the smallest limit of all kinds can't be cut; they are left out before the join, so
    only texts that may be too large are shuffled.
    """
    parts = []
    for items, column in ((parent_items(parents), "parent_tokens"), (chunk_items(chunks), "child_tokens")):
        floor = limits.agg(F.min(column)).first()[0]
        may = items.where(F.regexp_count("text", F.lit(WORD_PATTERN)) > F.lit(floor))
        parts.append(split_oversized(with_limits(may, documents, limits, column)))
    second = reduce(DataFrame.unionByName, parts).where(F.col("piece_no") == 1)
    return second.select("item_id.item_table", "item_id.item_id").distinct()


def piece_counts(items: DataFrame) -> DataFrame:
    """(item_id, pieces): into how many pieces ``split_oversized`` cuts each of the items, which have one row an item."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0))
    within = F.coalesce(words <= F.when(F.col("max_words") >= 1, F.col("max_words")), F.lit(True))
    id_type = items.schema["item_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts = [len(split_text(text, int(limit), ratio)) for _, text, limit, ratio in frame.itertuples(index=False)]
            yield pd.DataFrame({"item_id": frame["item_id"], "pieces": counts})

    large = items.where(~within).select("item_id", "text", "max_words", F.coalesce("overlap_ratio", F.lit(0.0)).alias("overlap_ratio"))
    return items.where(within).select("item_id", F.lit(1).alias("pieces")).unionByName(large.mapInPandas(run, f"item_id {id_type}, pieces int"))


def split_all(parents: DataFrame, chunks: DataFrame, documents: DataFrame, limits: DataFrame) -> DataFrame:
    """Every piece of both tables: (item_table, item_id, document_id, piece_no, chunk_index, page,
    token_count, text); chunk_index counts a document's pieces of one table from 0.

    Pieces follow the items' page and chunk_index (null last), then the id. Repeated rows come once, the
    smallest by place, pages, document and text. Texts are shuffled once, by their id: limits, the numbers of
    pieces and the running numbers, all narrow, come to them.
    """
    wide, last = 4096, F.lit(2**31 - 1)
    texts, counts = [], []
    for name, items, column in (
        ("chunk_parents", parents.select(F.col("parent_id").alias("item_id"), "document_id", F.col("page_start").alias("place"), "page_start", "page_end", "text"), "parent_tokens"),
        ("chunks", chunks.select(F.col("chunk_id").alias("item_id"), "document_id", F.col("chunk_index").alias("place"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), "text"), "child_tokens"),
    ):
        once = items.groupBy("item_id").agg(F.min(F.struct("place", "page_start", "page_end", "document_id", "text")).alias("row")).select("item_id", "row.*")
        narrow = items.groupBy("item_id").agg(F.min(F.struct("place", "page_start", "page_end", "document_id")).alias("row")).select("item_id", "row.*", F.lit(None).cast("string").alias("text"))
        rules = with_limits(narrow, documents, limits, column).select(F.col("item_id").alias("rule_id"), "max_words", "overlap_ratio")
        limited = once.join(rules, F.col("item_id").eqNullSafe(F.col("rule_id"))).drop("rule_id")
        texts.append(limited.withColumn("item_table", F.lit(name)))
        counted = piece_counts(limited)
        named = narrow.select(F.lit(name).alias("item_table"), F.col("item_id").alias("narrow_id"), "document_id", "place")
        counts.append(named.join(counted, F.col("narrow_id").eqNullSafe(F.col("item_id"))).drop("narrow_id"))
    rows = cut_lineage(counts[0].unionByName(counts[1]))
    numbered = running_sum(rows, ["item_table", "document_id"], F.coalesce("place", last) / wide, [F.coalesce("place", last), "item_id"], F.col("pieces"), "first")
    numbered = cut_lineage(numbered.select("item_table", F.col("item_id").alias("number_id"), "first"))
    parts = []
    for name, limited in zip(("chunk_parents", "chunks"), texts):
        own = numbered.where(F.col("item_table") == name).select("number_id", "first")
        joined = limited.join(own, F.col("item_id").eqNullSafe(F.col("number_id")))
        key = F.struct("item_table", "item_id", "document_id", "first").alias("item_id")
        pieces = split_oversized(joined.select(key, "text", "max_words", "overlap_ratio", "page_start", "page_end"))
        parts.append(pieces.select("item_id.item_table", "item_id.item_id", "item_id.document_id", "piece_no", (F.col("item_id.first") + F.col("piece_no")).cast("int").alias("chunk_index"), "page", "token_count", "text"))
    return reduce(DataFrame.unionByName, parts)
