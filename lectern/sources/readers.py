"""Sources and sinks: pages from files, seeds and outlines from YAML or JSON, JSON lines both ways."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUTLINE = "struct<document string, course string, page_index_base int, page_count int, units array<struct<id string, title string, page_start int, page_end int, sections array<struct<title string, page_start int, page_end int>>>>>"
PAGES = "path string, page int, text string, char_count int, used_ocr boolean"
#: Characters of native text up to which a page is read by the scanner's reader as well.
OCR_BELOW = 50

Extractor = Callable[[bytes], list[str]]


def text_pages(content: bytes) -> list[str]:
    """Pages of a plain text file, parted by form feeds."""
    return content.decode("utf-8", "replace").split("\f")


def read_pages(spark: SparkSession, path: str, extract: Extractor = text_pages, ocr: Extractor | None = None, pattern: str = "*") -> DataFrame:
    """One row (path, page, text, char_count, used_ocr) per page of the files under ``path``.

    ``extract`` turns a file's bytes into native page texts (a PDF reader, for instance), ``ocr`` into
    texts by a scanner's reader; the latter counts where a page's native text has 50 characters at most
    and its own is longer. Files are read by the executors; an unreadable file gives one page with null text.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [{"path": name, **page} for page in pages_of(content, extract, ocr)]
            yield pa.RecordBatch.from_pylist(rows, schema=_PAGE_SCHEMA)

    return files.mapInArrow(run, PAGES)


_PAGE_SCHEMA = pa.schema([("path", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("char_count", pa.int32()), ("used_ocr", pa.bool_())])


def pages_of(content: bytes, extract: Extractor, ocr: Extractor | None) -> list[dict]:
    try:
        native = extract(content)
        scanned = ocr(content) if ocr and any(len(t.strip()) <= OCR_BELOW for t in native) else []
    except Exception:  # an extractor may raise anything on a damaged file
        return [{"page": 1, "text": None, "char_count": 0, "used_ocr": False}]
    out = []
    for i, text in enumerate(native):
        other = scanned[i] if i < len(scanned) else ""
        use = len(text.strip()) <= OCR_BELOW and len(other.strip()) > len(text.strip())
        best = other if use else text
        out.append({"page": i + 1, "text": best, "char_count": len(best), "used_ocr": use})
    return out


def load_mapping(path: str) -> dict:
    """A YAML or JSON document; YAML where its library is installed."""
    content = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(content)
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML needs the yaml library; use JSON instead") from missing
    return yaml.safe_load(content)


def outline_frame(spark: SparkSession, documents: list[dict]) -> DataFrame:
    """Outlines as one struct column, pages made 1-based by their page_index_base."""
    raw = spark.createDataFrame([(json.dumps(d),) for d in documents], "value string").select(F.from_json("value", OUTLINE).alias("o"))
    shift = F.when(F.coalesce("o.page_index_base", F.lit(0)) == 0, 1).otherwise(0)
    section = lambda s: F.struct(s["title"].alias("title"), (s["page_start"] + shift).alias("page_start"), (s["page_end"] + shift).alias("page_end"))
    unit = lambda u: F.struct(u["id"].alias("id"), u["title"].alias("title"), (u["page_start"] + shift).alias("page_start"), (u["page_end"] + shift).alias("page_end"), F.transform(u["sections"], section).alias("sections"))
    return raw.select("o.document", "o.course", "o.page_count", F.transform("o.units", unit).alias("units"))


def outline_sections(outlines: DataFrame) -> DataFrame:
    """(document, unit_id, unit_title, section_title, page_start, page_end, toc_path) of every section."""
    units = outlines.select("document", F.explode("units").alias("u"))
    rows = units.select("document", F.col("u.id").alias("unit_id"), F.col("u.title").alias("unit_title"), F.explode_outer("u.sections").alias("s"), "u")
    start, end = F.coalesce("s.page_start", "u.page_start"), F.coalesce("s.page_end", "u.page_end")
    return rows.select("document", "unit_id", "unit_title", F.col("s.title").alias("section_title"), start.alias("page_start"), end.alias("page_end"), F.concat_ws(" > ", "unit_title", "s.title").alias("toc_path"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; blank lines are left out."""
    return spark.read.schema(schema).json(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def audit_tier(empty: Column, multi_column: Column, image_heavy: Column) -> Column:
    """Which reader a file needs, by the shares of its sampled pages that are empty, of several columns, mostly image."""
    return (
        F.when((empty >= 0.75) | (image_heavy >= 0.75), "ocr")
        .when((multi_column >= 0.35) & (empty < 0.5), "layout_defer")
        .when((empty >= 0.2) | (image_heavy >= 0.35), "ocr")
        .otherwise("native")
    )


def reconciled_tier(tier: Column, multi_column: Column, n_pages: Column, ocr_pages: Column, nonempty_pages: Column) -> Column:
    """The tier after a file was read: scanned when nothing, or half of its pages, needed a scanner's reader."""
    pages = F.greatest(n_pages, F.lit(1))
    return (
        F.when((nonempty_pages == 0) | (ocr_pages / pages >= 0.5), "ocr")
        .when(tier == "layout_defer", "layout_defer")
        .when(ocr_pages / pages >= 0.15, "ocr")
        .when((tier == "native") & (multi_column >= 0.35), "layout_defer")
        .otherwise(tier)
    )


def looks_multi_column(centres: Column, width: Column) -> Column:
    """Whether text blocks, by the x of their centres, stand in columns: eight at least, three on either side."""
    left = F.size(F.filter(centres, lambda x: x < width * 0.45))
    right = F.size(F.filter(centres, lambda x: x > width * 0.55))
    return (width > 0) & (F.size(centres) >= 8) & (left >= 3) & (right >= 3)


def sampled(pages: DataFrame, most: int = 12) -> DataFrame:
    """Every floor(n / most)-th page of a document and its last, ``most`` at most (a sampling operator)."""
    sizes = pages.groupBy("document_id").agg(F.max("page").alias("last"), F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / most))
    at = F.col("page") - F.col("first")
    joined = pages.join(sizes, "document_id").where(((at % step == 0) & (at / step < most - 1)) | (F.col("page") == F.col("last")))
    return joined.drop("last", "first", "n")


def page_quality(pages: DataFrame) -> DataFrame:
    """(document_id, n_pages, empty_ratio, ocr_ratio, mean_chars, tier) over the sampled pages."""
    rows = sampled(pages)
    out = rows.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.round(F.avg((F.length(F.trim(F.coalesce("text", F.lit("")))) <= OCR_BELOW).cast("int")), 6).alias("empty_ratio"),
        F.round(F.avg(F.coalesce("used_ocr", F.lit(False)).cast("int")), 6).alias("ocr_ratio"),
        F.round(F.avg(F.length(F.coalesce("text", F.lit("")))), 2).alias("mean_chars"),
    )
    return out.withColumn("tier", audit_tier(F.col("empty_ratio"), F.lit(0.0), F.col("ocr_ratio")))
