"""Problem 3: noise in text from scanned pages.

Page numbers are lines that are the page's own number. Headers and footers are first or last lines
whose form comes back on other pages of the document, or that hold a pair of words which, over the
corpus, stands in such repeated lines. Words cut by a line's end are told from compounds by what the
corpus writes. Misread words are those the clean pages don't know: a symmetric-delete index over the
frequency lexicon of the clean pages gives candidates, a weighted edit distance in which confusions of
characters are cheap ranks them, and the count of the pair with the word before decides among equals.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import cut_lineage

#: Uses on clean pages that make a word known, and a correction trusted.
KNOWN, TRUSTED = 2, 3
#: The price of a confusion; other edits cost 1. The most a repair may cost, by the length of the word.
CONFUSION, MOST_COST, MOST_COST_SHORT = 0.25, 0.8, 0.3
#: Share of the edge lines with a pair of words that are repeated, at a line's begin and at its end (where
#: cut titles end anyhow), and documents with it, for an anchor.
ANCHOR_SHARE, ANCHOR_SHARE_END, ANCHOR_DOCUMENTS = 0.6, 0.85, 4
#: Marks that stand at the end of a line for a cut word.
MARKS = "-­‐‑¬–"

# What scanners read for what was printed.
CONFUSIONS = (
    ("@", "a"), ("(", "c"), ("c", "e"), ("e", "c"), ("0", "o"), ("o", "a"), ("1", "l"), ("1", "i"), ("l", "i"), ("i", "l"), ("|", "l"), ("!", "l"), ("!", "i"),
    ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("q", "g"), ("f", "t"), ("t", "f"), ("v", "y"), ("y", "v"), ("2", "z"), ("h", "b"), ("b", "h"), ("n", "u"), ("u", "n"),
    ("li", "h"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("vv", "w"), ("w", "vv"), ("m", "in"), ("in", "m"), ("m", "ni"),
)
_BY_READ = {}
for _read, _printed in CONFUSIONS:
    _BY_READ.setdefault(_read, []).append(_printed)

_DIGIT_FOR = str.maketrans({"O": "0", "o": "0", "l": "1", "I": "1", "|": "1", "i": "1", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2", "g": "9", "q": "9", "b": "6"})
_NUMBER_LINE = re.compile(r"^[\W_]*(?:(?:p[a-z@]{0,5}|s[a-z]{0,5})\.?[\W_]*)?([0-9OoIlSsBZzgqb|]{1,7}|[ivxlcdmIVXLCDM1]{1,15})(?:[\W_]*(?:of|0f|/|von|de|sur|out of)[\W_]*[0-9OoIlSsBZzgqb|]{1,7})?[\W_]*$", re.I)
_ROMAN = (("m", 1000), ("cm", 900), ("d", 500), ("cd", 400), ("c", 100), ("xc", 90), ("l", 50), ("xl", 40), ("x", 10), ("ix", 9), ("v", 5), ("iv", 4), ("i", 1))
_CORE = re.compile(r"^[\"'“”‘’«»\[{<*•–—-]*(.*?)[\"'“”‘’«»\]}>.,;:!?…*–—]*$", re.S)
_FOLD = str.maketrans({"0": "o", "1": "l", "i": "l", "|": "l", "!": "l", "5": "s", "8": "b", "6": "b", "9": "g", "q": "g", "@": "a", "(": "c", "e": "c", "f": "t", "v": "y"})


_NUMERIC = re.compile(r"[\W_]*[\dolis]*[\W_]*").fullmatch
_DIGITS_ALONE = re.compile(r"(?<![^\W_])\d+(?![^\W_])").sub
_PIECES = re.compile(r"[^\W\d_]+|[^\s\w]").findall
#: Words and pairs of words up to which they are broadcast (some 30 MB) instead of shuffled.
BROADCAST_WORDS = 300_000
#: Words that a task counts before it gives its counts away.
_HELD = 500_000


def roman(n: int) -> str:
    """Lower-case Roman numeral; empty where there is none."""
    out = ""
    for sign, worth in _ROMAN if n < 4000 else ():
        while n >= worth:
            out, n = out + sign, n - worth
    return out


def is_page_number(line: str, page: int) -> bool:
    """Whether the line is the number of ``page`` alone, in digits or Roman, bare or decorated."""
    m = _NUMBER_LINE.match(line.strip())
    if m is None or line.rstrip().endswith("."):
        return False
    digits = m.group(1).translate(_DIGIT_FOR)
    if digits.isdigit() and int(digits) == page:
        return True
    return m.group(1).lower().replace("1", "i") == roman(page) or m.group(1).lower().replace("l", "i") == roman(page)


def core(token: str) -> str:
    """The token without the punctuation around it, lower-cased; brackets that belong together go, others stay."""
    inner = _CORE.match(token).group(1)
    while inner and inner[-1] == ")" and inner.count(")") > inner.count("("):
        inner = _CORE.match(inner[:-1]).group(1)
    if len(inner) > 1 and inner[0] == "(" and inner[-1] == ")":
        inner = inner[1:-1]
    return inner.lower()


def form(line: str) -> str:
    """What stays the same of a header from page to page: its letters, confusable ones made equal."""
    kept = [t for t in line.lower().split() if not _NUMERIC(t)]
    folded = "".join(filter(str.isalpha, "".join(kept).translate(_FOLD)))
    for read, printed in (("rn", "m"), ("cl", "d"), ("ll", "u"), ("rl", "n"), ("yy", "w")):
        folded = folded.replace(read, printed)
    return folded


def header_pairs(line: str) -> list[str]:
    """The neighbouring pieces (words, signs, # for a number) at the line's begin and, marked, at its end.

    Confusable characters are made equal, so that a misread header still has its anchors; numbers at
    either end are the page's. Further in stands the document's title, which is no sign of a header.
    """
    pieces = _PIECES(_DIGITS_ALONE("#", line.lower()).translate(_FOLD))
    pieces = pieces[pieces[:1] == ["#"] :]
    pieces = pieces[: len(pieces) - (pieces[-1:] == ["#"])]
    at = sorted({0, 1, len(pieces) - 2} & set(range(len(pieces) - 1)))
    return list(dict.fromkeys(f"{'... ' if i >= 2 else ''}{pieces[i]} {pieces[i + 1]}" for i in at))


def edge_lines(text: str, page: int) -> tuple[int | None, int | None, set[int]]:
    """(first, last, numbers): the first and last line that is neither blank nor a page number, and the page numbers.

    Page numbers are looked for in the outermost three lines at either end.
    """
    lines = text.split("\n")
    full = [i for i, line in enumerate(lines) if line.strip()]
    numbers = {i for i in {*full[:3], *full[-3:]} if is_page_number(lines[i], page)}
    if len(numbers) > 1 and len(full) > 4:  # a page has one number; the outermost is it
        numbers = {min(numbers, key=lambda i: min(full.index(i), len(full) - 1 - full.index(i)))}
    rest = [i for i in full if i not in numbers]
    return (rest[0], rest[-1], numbers) if rest else (None, None, numbers)


def weighted_distance(read: str, printed: str, most: float) -> float:
    """Cost of reading ``printed`` as ``read``; infinity above ``most``."""
    inf = float("inf")
    rows, columns = len(read), len(printed)
    if abs(rows - columns) > 2:
        return inf
    table = [[inf] * (columns + 1) for _ in range(rows + 1)]
    table[0][0] = 0.0
    for i in range(rows + 1):
        for j in range(columns + 1):
            here = table[i][j]
            if here > most:
                continue
            if i < rows and j < columns:
                step = 0.0 if read[i] == printed[j] else 1.0
                table[i + 1][j + 1] = min(table[i + 1][j + 1], here + step)
            if i < rows:
                table[i + 1][j] = min(table[i + 1][j], here + 1)
            if j < columns:
                table[i][j + 1] = min(table[i][j + 1], here + 1)
            for width in (1, 2):
                for true in _BY_READ.get(read[i : i + width], ()) if i + width <= rows else ():
                    if printed.startswith(true, j):
                        table[i + width][j + len(true)] = min(table[i + width][j + len(true)], here + CONFUSION)
    return table[rows][columns] if table[rows][columns] <= most else inf


def deletes(word: str) -> list[str]:
    """The word and what is left of it after leaving out one or two characters (one of words under 5)."""
    out = {word}
    for k in (1, 2)[: 1 + (len(word) >= 4)]:
        if len(word) > k:
            out.update("".join(c for i, c in enumerate(word) if i not in gone) for gone in combinations(range(len(word)), k))
    return sorted(out)


#: Longer words are indexed by the deletes of their first and last characters, HALF of either.
LONGEST, HALF = 24, 11


def index_parts(word: str) -> list[str]:
    """What two words within the permitted cost share: deletes of the whole word, for long words of both its ends.

    Three confusions, the most that cost permits, leave one of two ends with one at most, which two
    deletes of either word undo. Words that may be two characters longer than LONGEST when misread have both kinds.
    """
    ends = [f"{mark}{part}" for mark, half in (("^", word[:HALF]), ("$", word[-HALF:])) for part in deletes(half)] if len(word) > LONGEST - 2 else []
    return ends + (deletes(word) if len(word) <= LONGEST else [])


def pages_once(pages: DataFrame) -> DataFrame:
    """(document_id, page, text, scanned), a repeated page once; scanned is null where that isn't known."""
    kept = pages.where(F.col("document_id").isNotNull() & F.col("page").isNotNull() & F.col("text").isNotNull())
    return kept.groupBy("document_id", "page").agg(F.min("text").alias("text"), F.max("used_ocr").alias("scanned"))


_BETWEEN = re.compile(r"[\s\"“”«»()\[\]{}<>.,;:!?…*•]+")


def split_words(text: str) -> list[str]:
    """The lower-cased words, without blanks and the punctuation around words."""
    return _BETWEEN.split(text.lower())


def _counted(texts: DataFrame, count: Callable[[Counter, str], None], schema: str, names: list[str]) -> DataFrame:
    """What ``count`` adds up over the one column of ``texts``, a key being a tuple or string; counts leave a task summed up."""
    kinds = [pa.string()] * (len(names) - 1) + [pa.int64()]

    def rows(held: Counter) -> pa.RecordBatch:
        keys = list(zip(*((k if isinstance(k, tuple) else (k,)) for k in held))) or [()] * (len(names) - 1)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*keys, held.values()], kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                count(held, text)
            if len(held) > _HELD:
                yield rows(held)
                held = Counter()
        yield rows(held)

    return texts.mapInArrow(run, schema).groupBy(*names[:-1]).agg(F.sum(names[-1]).alias(names[-1]))


def lexicon(pages: DataFrame) -> DataFrame:
    """(word, clean): how often each word stands on pages that weren't scanned, all pages counted."""

    def count(held: Counter, text: str) -> None:
        held.update(split_words(text))

    words = _counted(pages.where(~F.col("scanned")).select("text"), count, "word string, clean long", ["word", "clean"])
    # not the first part of a word cut by the line's end
    return words.where(~F.substring("word", -1, 1).isin(*MARKS) & (F.col("word") != ""))


def few(rows: DataFrame, most: int = BROADCAST_WORDS) -> DataFrame:
    """``rows`` to be broadcast where they were counted to be few."""
    return F.broadcast(rows) if rows.count() <= most else rows


def _tokens(scanned: DataFrame, following: DataFrame) -> DataFrame:
    """One row per line of the scanned pages, with its words and how it ends."""
    joined = scanned.join(following, ["document_id", "page"], "left").select("document_id", "page", "text", "next_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for document, page, text, after in zip(*(batch.column(i).to_pylist() for i in range(4))):
                out += page_lines(document, page, text, after)
            yield pa.RecordBatch.from_pylist(out, schema=_LINES)

    return joined.mapInArrow(run, _LINES_DDL)


_LINES_DDL = "document_id string, page int, line_no int, edge string, number boolean, form string, head string, tail string, tail_line int, next_tail string, mark string, both_upper boolean, words array<string>, pairs array<string>"
_LINES = pa.schema(
    [
        ("document_id", pa.string()), ("page", pa.int32()), ("line_no", pa.int32()), ("edge", pa.string()), ("number", pa.bool_()), ("form", pa.string()), ("head", pa.string()),
        ("tail", pa.string()), ("tail_line", pa.int32()), ("next_tail", pa.string()), ("mark", pa.string()), ("both_upper", pa.bool_()), ("words", pa.list_(pa.string())), ("pairs", pa.list_(pa.string())),
    ]
)


def page_lines(document: str, page: int, text: str, after: str | None) -> list[dict]:
    """The lines of a page. head and tail are the parts of a word cut (or a compound parted) by the
    line's end; words are the others, the parts of cut words left out."""
    lines = text.split("\n")
    first, last, numbers = edge_lines(text, page)
    out, cut_before = [], False
    body = [i for i, line in enumerate(lines) if line.strip() and i not in numbers]
    for i, line in enumerate(lines):
        tokens = line.split()
        row = {"document_id": document, "page": page, "line_no": i, "number": i in numbers, "pairs": None, "edge": None, "form": None, "head": None, "tail": None, "tail_line": None, "next_tail": None, "mark": None, "both_upper": None}
        if i == first or i == last:
            row["edge"], row["form"], row["pairs"] = "first" if i == first else "last", form(line), header_pairs(line)
        begin, end = 0, len(tokens)
        if tokens and i not in numbers:
            if cut_before and i != first:
                begin = 1
            lastly = tokens[-1]
            cut_before = len(lastly) > 1 and lastly[-1] in MARKS and lastly[-2].isalpha()
            if cut_before:
                end -= 1
                row["head"], row["mark"] = core(lastly[:-1]), lastly[-1]
                row["tail_line"] = next((j for j in body if j > i), None)
                token = lines[row["tail_line"]].split()[0] if row["tail_line"] is not None else ""
                row["tail"], row["next_tail"] = core(token) or None, _next_page_word(after, page)
                row["both_upper"] = token[:1].isupper() and lastly[:1].isupper()
        row["words"] = [c for t in tokens[begin : max(begin, end)] if (c := core(t))]
        out.append(row)
    return out


def _next_page_word(after: str | None, page: int) -> str | None:
    """The first word of the following page's text, its first line taken as a header where there are more."""
    if after is None:
        return None
    first, _, numbers = edge_lines(after, page + 1)
    lines = after.split("\n")
    free = [i for i, line in enumerate(lines) if line.strip() and i not in numbers and i != first]
    if not free and first is None:
        return None
    return core(lines[free[0] if free else first].split()[0]) or None


def aligned(lines: list[str], stream: list[str]) -> dict[int, int]:
    """{line: position in stream} of the lines of a chunk that stand in its pages' lines; both with single blanks.

    The longest runs of equal lines are taken, from the chunk's begin on; a part of a line at the chunk's
    begin or end counts where the line beside it stands beside the whole one.
    """
    where: dict[str, list[int]] = {}
    for k, line in enumerate(stream):
        where.setdefault(line, []).append(k)
    full = [i for i, line in enumerate(lines) if line]
    out: dict[int, int] = {}
    at, last = 0, -1
    while at < len(full):
        best = (0, False, 0)
        for start in where.get(lines[full[at]], ()):
            run = 0
            while at + run < len(full) and start + run < len(stream) and lines[full[at + run]] == stream[start + run]:
                run += 1
            best = max(best, (run, start > last, -start))
        for k in range(best[0]):
            out[full[at + k]] = last = k - best[2]
        at += max(1, best[0])
    if len(full) > 1:
        first, second, end, before = full[0], out.get(full[1], 0) - 1, full[-1], out.get(full[-2], len(stream)) + 1
        if first not in out and second >= 0 and stream[second].endswith(lines[first]):
            out[first] = second
        if end not in out and before < len(stream) and stream[before].startswith(lines[end]):
            out[end] = before
    return out


def chunk_lines(chunk: str, page: int, text: str, own: bool, pages: list) -> list[dict]:
    """The lines of a chunk as ``page_lines`` has them, numbers and headers of its pages marked as number.

    ``pages`` (page, scanned, text, drops) are the chunk's page, what it may reach into and one page at
    either side; ``own`` tells whether its page was scanned. Of lines of pages that weren't scanned no words
    come out. Line -1 is the line before the chunk, where it ends within a word. No rows come out of a chunk without scanned lines.
    """
    stream = []
    for q in sorted(pages, key=lambda q: q["page"]):
        gone = set(q["drops"] or ())
        stream += [(" ".join(line.split()), bool(q["scanned"]), i in gone) for i, line in enumerate(q["text"].split("\n")) if line.strip()]
    lines = text.split("\n")
    at = aligned([" ".join(line.split()) for line in lines], [line for line, _, _ in stream])
    if not own and not any(stream[k][1] for k in at.values()):
        return []
    numbers = {i for i, k in at.items() if stream[k][2]}
    body = [i for i, line in enumerate(lines) if line.strip() and i not in numbers]
    kept = [k for k, (_, _, dropped) in enumerate(stream) if not dropped]
    rank = {k: n for n, k in enumerate(kept)}
    beside = lambda k, by: kept[rank[k] + by] if 0 <= rank[k] + by < len(kept) else None
    cut = lambda line: len(t := line.split()[-1]) > 1 and t[-1] in MARKS and t[-2].isalpha()
    empty = {"document_id": chunk, "page": page, "number": False, "words": []} | dict.fromkeys(("pairs", "edge", "form", "head", "tail", "tail_line", "next_tail", "mark", "both_upper"))

    def ending(line: str, after: str | None, line_no: int | None) -> dict:
        lastly, token = line.split()[-1], after.split()[0] if after else ""
        tail = core(token) or None
        return {"head": core(lastly[:-1]), "mark": lastly[-1], "tail": tail, "tail_line": line_no, "next_tail": tail, "both_upper": token[:1].isupper() and lastly[:1].isupper()}

    out = []
    for n, i in enumerate(body):
        line, k = lines[i], at.get(i)
        if k is None:
            before = lines[body[n - 1]] if n else None
            after, line_no, scanned = (lines[body[n + 1]], body[n + 1], True) if n + 1 < len(body) else (None, None, own)
        else:
            b, a, scanned = beside(k, -1), beside(k, 1), stream[k][1]
            before = stream[b][0] if b is not None and stream[b][1] else None
            after = stream[a][0] if a is not None else None
            line_no = body[n + 1] if n + 1 < len(body) and a is not None and at.get(body[n + 1]) == a else None
        row = empty | {"line_no": i}
        if scanned:
            tokens = line.split()
            begins, ends = int(before is not None and cut(before)), cut(line)
            row["words"] = [c for t in tokens[begins : max(begins, len(tokens) - ends)] if (c := core(t))]
            row |= ending(line, after, line_no) if ends else {}
        if n == 0 and k is not None and before is not None and cut(before):
            out.append(empty | {"line_no": -1} | ending(before, line, i))
        out.append(row)
    return out + [empty | {"line_no": i, "number": True} for i in sorted(numbers)] + ([] if body or numbers else [empty | {"line_no": 0}])


def header_lines(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """(document_id, page, line_no) of the headers and footers among the edge lines ``lines``.

    ``edges`` (document_id, page, form, pairs) are the edge lines of all pages.
    """
    kept = edges.where(F.length("form") >= 4)
    per_form = kept.groupBy("document_id", "form").agg(F.count_distinct("page").alias("pages"))
    sizes = kept.groupBy("document_id").agg(F.count_distinct("page").alias("all_pages"))
    marked = kept.join(per_form, ["document_id", "form"]).join(sizes, "document_id")
    pair = F.explode("pairs").alias("pair")
    learnt = marked.where("all_pages >= 4").select("document_id", (F.col("pages") >= 2).cast("int").alias("repeated"), pair)
    anchors = learnt.groupBy("pair").agg(F.avg("repeated").alias("share"), F.count_distinct("document_id").alias("documents"))
    least = F.when(F.startswith("pair", F.lit("...")), ANCHOR_SHARE_END).otherwise(ANCHOR_SHARE)
    anchors = anchors.where((F.col("share") >= least) & (F.col("documents") >= ANCHOR_DOCUMENTS)).select("pair")
    candidates = lines.where(F.col("edge").isNotNull()).select("document_id", "page", "line_no", "form", "pairs")
    repeated = candidates.join(per_form.where("pages >= 2"), ["document_id", "form"], "left_semi").select("document_id", "page", "line_no")
    anchored = candidates.select("document_id", "page", "line_no", pair).join(anchors, "pair", "left_semi").select("document_id", "page", "line_no")
    return repeated.union(anchored).distinct()


def repairs(unknown: DataFrame, known: DataFrame) -> DataFrame:
    """(word, repair, cost, clean): for each unknown word the corrections within the permitted cost.

    Both sides are spread over their deletes and meet in a join on them: the symmetric-delete index as
    a table, which no task holds whole.
    """
    schema = "word string, clean long, part string"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, c, d) for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for d in index_parts(w)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [(), (), ()], (pa.string(), pa.int64(), pa.string()))], names=["word", "clean", "part"])

    letters = known.where(F.col("word").rlike(r"^[\p{L}'’-]+$") & (F.col("clean") >= TRUSTED)).select("word", "clean")
    index = letters.mapInArrow(spread, schema).withColumnRenamed("word", "repair")
    asked = unknown.where(F.col("word").rlike(r"\p{L}|[\d@(]")).select("word", F.lit(0).cast("long").alias("clean")).mapInArrow(spread, schema).drop("clean")
    met = asked.join(index, "part").select("word", "repair", "clean").distinct().where(F.abs(F.char_length("word") - F.char_length("repair")) <= 2)

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, targets = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            costs = [weighted_distance(w, t, MOST_COST if len(t) > 3 else MOST_COST_SHORT) for w, t in zip(words, targets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.float64())], names=["word", "repair", "clean", "cost"])

    priced = met.mapInArrow(price, "word string, repair string, clean long, cost double")
    return priced.where(F.col("cost") != float("inf")).select("word", "repair", "cost", "clean")


#: A number in which letters stand for digits.
_MIXED_NUMBER = r"^(?=.*\d)(?=.*[olis])[\dolis]{2,6}$|^(ll|lo|ol)$"
#: A letter word in which a digit or sign stands for a letter.
_MIXED_WORD = r"^\p{L}*(\p{L}[0158@(9]\p{L}|^[0568@(]\p{L}{3,}|\p{L}{3,}[0158@9(]$)[\p{L}0158@(9'’-]*$"


class Scanned:
    """The damage found on the scanned pages of a table of pages.

    What several steps read is written out (lexicon, lines of scanned pages, edges, headers), so that each step
    has a plan of its own; the pages themselves are only persisted.
    """

    def __init__(self, pages: DataFrame):
        self.pages = pages_once(pages).persist(StorageLevel.MEMORY_AND_DISK)
        self.words = cut_lineage(lexicon(self.pages))
        self.scanned = self.pages.where("scanned")
        self.lines = cut_lineage(self._page_lines())
        self.edges = cut_lineage(_edges(self.pages))
        self.headers = cut_lineage(header_lines(self.lines, self.edges))

    def _page_lines(self) -> DataFrame:
        following = self.pages.select("document_id", (F.col("page") - 1).alias("page"), F.col("text").alias("next_text"))
        return _tokens(self.scanned, following)

    def cut_words(self) -> DataFrame:
        """(document_id, page, line_no, head, tail, whole) of lines ending within a word written without a hyphen."""
        rows = self.lines.where(F.col("head").isNotNull() & ~F.col("number")).join(self.headers, ["document_id", "page", "line_no"], "left_anti")
        footers = self.headers.select("document_id", "page", F.col("line_no").alias("tail_line"), F.lit(True).alias("footer"))
        rows = rows.join(footers, ["document_id", "page", "tail_line"], "left")
        over = F.coalesce("footer", F.lit(False)) | F.col("tail_line").isNull()
        rows = rows.withColumn("both_upper", F.col("both_upper") & ~over).withColumn("tail", F.when(over, F.col("next_tail")).otherwise(F.col("tail")))
        rows = rows.select("document_id", "page", "line_no", "head", "tail", "mark", "both_upper", over.alias("over_page")).withColumns({"joined": F.concat("head", "tail"), "compound": F.concat_ws("-", "head", "tail")})
        rows = cut_lineage(rows)
        keys = ("joined", "compound", "head", "tail")
        asked = rows.select(F.explode(F.array(*keys)).alias("word")).where(F.col("word").isNotNull()).distinct()
        counts = few(cut_lineage(self.words.join(asked, "word", "left_semi")))
        for key in keys:
            rows = rows.join(counts.select(F.col("word").alias(key), F.col("clean").alias(f"n_{key}")), key, "left").fillna(0, [f"n_{key}"])
        parts = F.split("word", "-")
        begun = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "-")))
        heads = self.words.where(F.col("word").contains("-") & (F.col("clean") >= KNOWN) & (F.char_length("word") <= 2 * LONGEST)).select(begun.alias("head")).distinct()
        rows = rows.join(heads.withColumn("begins", F.lit(True)), "head", "left")
        both = (F.col("n_head") >= TRUSTED) & (F.col("n_tail") >= TRUSTED)
        whole = (
            F.when(F.col("tail").isNull(), F.col("begins").isNull())
            .when(F.col("both_upper"), F.lit(False))
            .when((F.col("n_joined") > 0) | (F.col("n_compound") > 0), F.col("n_joined") >= F.col("n_compound"))
            .otherwise(~(both & F.col("mark").isin("-", "‐", "‑")))
        )
        return rows.withColumn("whole", whole)

    def misread_words(self) -> DataFrame:
        """(document_id, page, line_no, place, word, repair) of misread words outside headers and page
        numbers; repair is null where only the word's shape tells, as for a name met nowhere else."""
        tokens = self.lines.where(~F.col("number")).select("document_id", "page", "line_no", F.posexplode("words").alias("place", "word"), F.col("words"))
        odd = tokens.where(~F.col("word").rlike(r"^[\d.,:%/+−–°-]+$") & F.col("word").rlike(r"\p{L}|@|\("))
        # the distinct words meet the lexicon; the rows of those it lacks, few as they are, lose those of headers
        unknown = cut_lineage(odd.select("word").distinct().join(self.words.where(F.col("clean") >= KNOWN).select("word"), "word", "left_anti"))
        odd = odd.join(few(unknown), "word").withColumn("before", F.when(F.col("place") > 0, F.try_element_at("words", F.col("place")))).drop("words")
        odd = cut_lineage(odd.join(self.headers, ["document_id", "page", "line_no"], "left_anti"))
        # a bracket or sign that only stands beside a known word is no misreading
        bare = unknown.withColumn("bare", F.regexp_replace("word", r"^[(@]+|[()]+$", ""))
        bare = bare.withColumn("parts", F.split("bare", r"[.(){}\[\]/_=:,;]+|[-–—]{1,2}")).select("word", F.explode("parts").alias("part")).where(F.col("part") != "")
        parts = bare.join(self.words.where(F.col("clean") >= KNOWN).select(F.col("word").alias("part"), F.lit(1).alias("is_known")), "part", "left")
        fine = parts.groupBy("word").agg(F.min(F.coalesce("is_known", F.col("part").rlike(r"^\d+$").cast("int"))).alias("fine")).where("fine = 1").select("word")
        open_ended = cut_lineage(unknown.join(fine, "word", "left_anti"))
        fixes = cut_lineage(repairs(open_ended, self.words))
        pairs = odd.join(fixes, "word").select("before", "word", "repair", "cost", "clean").distinct()
        open_choice = fixes.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("cost").alias("least")).where("n > 1").select("word", "least")
        close = pairs.join(open_choice, "word").where((F.col("cost") <= F.col("least")) & F.col("before").isNotNull())
        counts = self._pair_counts(close.select("before", "repair").distinct())
        best = Window.partitionBy("before", "word").orderBy("cost", F.desc("n"), F.desc("clean"), "repair")
        chosen = pairs.join(counts, ["before", "repair"], "left").fillna(0, ["n"]).withColumn("rank", F.row_number().over(best)).where("rank = 1")
        chosen = chosen.select(F.col("before").alias("b"), F.col("word").alias("w"), "repair")
        shaped = open_ended.where(F.col("word").rlike(_MIXED_NUMBER) | (F.col("word").rlike(_MIXED_WORD) & ~F.col("word").rlike(r"@.*\."))).select(F.col("word").alias("s"))
        found = odd.join(chosen, (odd["word"] == F.col("w")) & odd["before"].eqNullSafe(F.col("b")), "left").join(shaped, odd["word"] == F.col("s"), "left")
        return found.where(F.col("repair").isNotNull() | F.col("s").isNotNull()).select("document_id", "page", "line_no", "place", "word", "repair")

    def _pair_counts(self, asked: DataFrame) -> DataFrame:
        """(before, repair, n): how often the asked pairs stand on clean pages."""
        asked = cut_lineage(asked)
        texts = self.pages.where(~F.col("scanned")).select("text")
        chosen = None
        if asked.count() <= BROADCAST_WORDS:
            chosen = texts.sparkSession.sparkContext.broadcast({(r["before"], r["repair"]) for r in asked.toLocalIterator()})

        def count(held: Counter, text: str) -> None:
            words = list(filter(None, split_words(text)))
            pairs = zip(words, words[1:])
            held.update(pairs if chosen is None else filter(chosen.value.__contains__, pairs))

        counts = _counted(texts, count, "before string, repair string, n long", ["before", "repair", "n"])
        return counts if chosen is not None else counts.join(asked, ["before", "repair"], "left_semi")

    def paragraphs(self) -> DataFrame:
        """(document_id, page, text, n_dropped, n_repaired, n_joined) of the scanned pages: headers, footers
        and page numbers left out, misread words with a repair replaced, cut words joined, lines put
        together into paragraphs. A word cut by the page's end stands whole on the page it begins on.
        """
        key = ["document_id", "page"]
        cut = cut_lineage(self.cut_words().where("whole").select(*key, "line_no", "tail", "over_page"))
        drops = self.lines.where("number").select(*key, "line_no").union(self.headers).groupBy(*key).agg(F.collect_set("line_no").alias("drops"))
        fixes = self.misread_words().where(F.col("repair").isNotNull()).groupBy(*key).agg(F.collect_list(F.struct("line_no", "word", "repair")).alias("fixes"))
        joins = cut.groupBy(*key).agg(F.collect_list(F.struct("line_no", "tail", "over_page")).alias("joins"))
        carried = self._carried(cut).groupBy(*key).agg(F.min("carried").alias("carried"))
        rows = self.scanned.select(*key, "text")
        for part in (drops, fixes, joins, carried):
            rows = rows.join(part, key, "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [readable(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(2, 7)))]
                columns = list(zip(*out)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int32())))], names=[*key, "text", "n_dropped", "n_repaired", "n_joined"])

        return rows.mapInArrow(run, "document_id string, page int, text string, n_dropped int, n_repaired int, n_joined int")

    def _carried(self, cut: DataFrame) -> DataFrame:
        """(document_id, page, carried): the parts at the begin of a page of words that stand whole on the page before."""
        return cut.where(F.col("over_page") & F.col("tail").isNotNull()).select("document_id", (F.col("page") + 1).alias("page"), F.col("tail").alias("carried"))

    def found(self) -> DataFrame:
        """(document_id, page, line_no, kind), one row per damaged line and kind."""
        at = ["document_id", "page", "line_no"]
        numbers = self.lines.where("number").select(*at, F.lit("page_number").alias("kind"))
        headers = self.headers.select(*at, F.lit("running_header").alias("kind"))
        cut = self.cut_words().where("whole").select(*at, F.lit("split_word").alias("kind"))
        misread = self.misread_words().select(*at, F.lit("misread").alias("kind"))
        return numbers.union(headers).union(cut).union(misread).distinct()


class ScannedChunks(Scanned):
    """The damage in the chunks cut from scanned pages: chunk_id stands for document_id.

    A chunk's lines are found again in its pages, which tell what is a header or page number and how a word
    goes on that the chunk's end cuts; lines found nowhere are kept and their words repaired like others.
    """

    def __init__(self, chunks: DataFrame, pages: DataFrame):
        super().__init__(pages)
        key = ["document_id", "page"]
        usable = chunks.where(F.col("chunk_id").isNotNull() & F.col("document_id").isNotNull() & F.col("page").isNotNull() & F.col("text").isNotNull())
        once = usable.join(self.scanned.select("document_id").distinct(), "document_id", "left_semi").groupBy("chunk_id").agg(*(F.min(c).alias(c) for c in (*key, "text"))).persist(StorageLevel.MEMORY_AND_DISK)
        full = lambda text: F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"\S")))
        sized = self.pages.join(self.scanned.select("document_id").distinct(), "document_id", "left_semi").select(*key, F.coalesce("scanned", F.lit(False)).alias("own"), full("text").alias("n"))
        placed = sized.withColumn("end", F.sum("n").over(Window.partitionBy("document_id").orderBy("page"))).withColumn("begin", F.col("end") - F.col("n"))
        held = once.select("chunk_id", *key, full("text").alias("lines")).join(placed.drop("n"), key).drop("page")
        # the lines of the chunk's page, as many after it as the chunk has, and the page that ends before it
        others = placed.where("n > 0").select("document_id", "page", F.col("begin").alias("from"), F.col("end").alias("to"))
        near = held.join(others, "document_id", "left").where(F.col("page").isNull() | ((F.col("to") >= F.col("begin")) & (F.col("from") < F.col("end") + F.col("lines")))).select("chunk_id", *key, "own")
        drops = self.lines.where("number").select(*key, "line_no").union(self.headers).groupBy(*key).agg(F.collect_set("line_no").alias("drops"))
        texts = self.pages.join(drops, key, "left").select(*key, F.struct("page", "scanned", "text", "drops").alias("about"))
        reach = near.join(texts, key, "left").groupBy("chunk_id").agg(F.max("own").alias("own"), F.collect_list("about").alias("pages"))
        joined = once.join(reach, "chunk_id").select("chunk_id", "page", "text", "own", "pages")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [row for values in zip(*(batch.column(i).to_pylist() for i in range(5))) for row in chunk_lines(*values)]
                yield pa.RecordBatch.from_pylist(out, schema=_LINES)

        self.lines = cut_lineage(joined.mapInArrow(run, _LINES_DDL))
        self.headers = self.headers.limit(0)
        self.scanned = once.select(F.col("chunk_id").alias("document_id"), "page", "text").join(self.lines.select("document_id").distinct(), "document_id", "left_semi")

    def _page_lines(self) -> DataFrame:
        """Of the pages themselves only page numbers and edge lines are asked."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for document, page, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    first, last, numbers = edge_lines(text, page)
                    lines, at = text.split("\n"), {"document_id": document, "page": page}
                    out += [at | {"line_no": i, "number": True} for i in numbers]
                    out += [at | {"line_no": i, "number": False, "edge": "first" if i == first else "last", "form": form(lines[i]), "pairs": header_pairs(lines[i])} for i in {first, last} - {None}]
                yield pa.RecordBatch.from_pylist(out, schema=_LINES)

        return self.scanned.select("document_id", "page", "text").mapInArrow(run, _LINES_DDL)

    def _carried(self, cut: DataFrame) -> DataFrame:
        return cut.where(F.col("line_no") < 0).select("document_id", "page", F.col("tail").alias("carried"))


_OPENS = re.compile(r"^\s*(?:[-*•»]\s|\d{1,2}[.)]?\s|\(?[a-z]\)\s|(?i:unit|chapter|part)\b|\d+\.\d+\s)")


def _like(repair: str, token: str, word: str) -> str:
    """The token with the misread word in it replaced, its capital kept."""
    at = token.lower().find(word)
    if at < 0:
        return token
    first = token[at : at + 1]
    return token[:at] + (repair[:1].upper() + repair[1:] if first.isupper() else repair) + token[at + len(word) :]


def readable(text: str, drops: list | None, fixes: list | None, joins: list | None, carried: str | None) -> tuple[str, int, int, int]:
    """(text of one page, dropped lines, repaired words, joined words); paragraphs are parted by a blank line.

    A line opens a paragraph after a blank line, when it begins like a list item or heading, or when the
    line before ended a sentence well short of the page's width.
    """
    lines = text.split("\n")
    gone = set(drops or ())
    fix: dict[int, dict[str, str]] = {}
    for f in fixes or ():
        fix.setdefault(f["line_no"], {})[f["word"]] = f["repair"]
    cut = {j["line_no"]: j for j in joins or ()}
    width = max((len(line.rstrip()) for i, line in enumerate(lines) if i not in gone), default=0)
    paragraphs: list[list[str]] = []
    repaired = joined = 0
    skip, pending, fresh = carried, None, True
    for i, line in enumerate(lines):
        if i in gone:
            continue
        tokens = line.split()
        if not tokens:
            fresh = fresh or pending is None
            continue
        for word, repair in fix.get(i, {}).items():
            for k, token in enumerate(tokens):
                if core(token) == word:
                    tokens[k] = _like(repair, token, word)
                    repaired += 1
        if skip is not None and core(tokens[0]) == skip:
            tokens = tokens[1:]
        skip = None
        if pending is not None and tokens:
            paragraphs[-1][-1] = pending + tokens[0]
            joined, tokens, pending = joined + 1, tokens[1:], None
        if not tokens:
            continue
        if fresh or not paragraphs or _OPENS.match(line):
            paragraphs.append([])
        elif re.search(rf"\w[{MARKS}]$", paragraphs[-1][-1]) and tokens[0][0].isalnum():  # a compound that keeps its hyphen
            paragraphs[-1][-1], tokens = paragraphs[-1][-1] + tokens[0], tokens[1:]
        paragraphs[-1] += tokens
        if not paragraphs[-1]:
            continue
        fresh = paragraphs[-1][-1][-1] in ".!?:" and len(line.rstrip()) < 0.7 * width
        if i in cut:
            bare = paragraphs[-1][-1].rstrip(MARKS)
            if cut[i]["over_page"]:
                paragraphs[-1][-1] = bare + (cut[i]["tail"] or "")
                joined += 1
            else:
                pending = bare
    return "\n\n".join(" ".join(p) for p in paragraphs if p), len(gone), repaired, joined


def _edges(pages: DataFrame) -> DataFrame:
    """(document_id, page, form, pairs) of the first and last line of text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for document, page, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                first, last, _ = edge_lines(text, page)
                lines = text.split("\n")
                rows += [(document, page, form(lines[i]), header_pairs(lines[i])) for i in {first, last} if i is not None]
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.list_(pa.string())))], names=["document_id", "page", "form", "pairs"])

    return pages.select("document_id", "page", "text").mapInArrow(run, "document_id string, page int, form string, pairs array<string>")


def damaged_lines(pages: DataFrame) -> DataFrame:
    """(document_id, page, line_no, kind) of the damaged lines of the pages with used_ocr true.

    Kinds: page_number, running_header, split_word, misread (see the module). Pages with null
    document_id, page or text take no part; of a repeated page the smallest text counts; empty pages
    have no damage; used_ocr null counts as false. Line numbers count from 0 after splitting at newline.
    """
    return Scanned(pages).found()


def readable_pages(pages: DataFrame) -> DataFrame:
    """The scanned pages as continuous paragraphs, see ``Scanned.paragraphs``; same rows as damaged_lines looks at."""
    return Scanned(pages).paragraphs()


def readable_chunks(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(chunk_id, text, n_dropped, n_repaired, n_joined) of the chunks that hold lines of scanned pages, each once, repaired as the pages are.

    Chunks with null document_id, page or text take no part. A word cut by a chunk's end stands whole in the
    chunk it begins in and its rest is left out at the begin of the next.
    """
    return ScannedChunks(chunks, pages).paragraphs().withColumnRenamed("document_id", "chunk_id").drop("page")
