"""Column functions over text; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a question that are not searched for.
QUERY_STOPWORDS = "a an the is are was were what which who how why when where give explain describe define between with and or for of in to from using according over decades example examples".split()
# Words that no keyphrase holds.
PHRASE_STOPWORDS = """a an the and or but if then else when at by for with about against between into through during before after
above below to from up down in out on off over under again further once here there all each few more most other some such no
nor not only own same so than too very can will just don should now what which who whom this that these those am is are was
were be been being have has had do does did doing would could ought i you he she it we they me him her us them my your his
its our their of any five following each explain define describe compute state list give write name discuss differentiate between""".split()
# Phrases of questions that ask for wording more than for meaning.
LEXICAL_MARKERS = ("define", "what is", "what are", "difference between", "explain", "lexeme", "token", "grammar", "ambiguous", "short-circuit", "referential transparency", "lisp", "evaluation criteria")


def words(text: Column) -> Column:
    """Words between whitespace; an empty array for null or blank text."""
    return F.coalesce(F.filter(F.split(text, r"\s+"), lambda w: w != ""), F.array().cast("array<string>"))


def token_count(text: Column) -> Column:
    """Number of words, 1 at least."""
    return F.greatest(F.lit(1), F.size(words(text)))


def normalise(text: Column) -> Column:
    """Lower case, runs of whitespace collapsed, ends trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def focus_terms(text: Column, anchors: Sequence[str] = (), most: int = 8) -> Column:
    """Distinct words of a question (a letter and two more characters at least) that aren't stopwords, in
    order, ``most`` at most; of the ``anchors`` those that the question holds come first, the last of them foremost."""
    lowered = F.lower(text)
    found = F.regexp_extract_all(lowered, F.lit(r"[a-z][a-z0-9-]{2,}"), F.lit(0))
    kept = F.array_distinct(F.filter(found, lambda t: ~t.isin(QUERY_STOPWORDS)))
    if anchors:
        first = F.filter(F.array(*map(F.lit, reversed(anchors))), lambda a: F.contains(lowered, a) & ~F.array_contains(kept, a))
        kept = F.concat(first, kept)
    return F.slice(kept, 1, most)


def query_terms(words: Column, least: int = 1) -> Column:
    """The words without signs, those of three characters at least; none when there are fewer than ``least``."""
    cleaned = F.array_distinct(F.filter(F.transform(words, lambda w: F.lower(F.regexp_replace(w, "[^a-zA-Z0-9]", ""))), lambda w: F.length(w) >= 3))
    return F.when(F.size(cleaned) >= least, cleaned).otherwise(F.array().cast("array<string>"))


def is_lexical_heavy(text: Column, markers: Sequence[str] = LEXICAL_MARKERS) -> Column:
    """Whether the question holds one of the markers."""
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower(text), m)) if markers else F.lit(False)


def snippet(text: Column, longest: int = 160) -> Column:
    """The text, or its begin and three dots when it is longer."""
    return F.when(F.length(text) > longest, F.concat(F.rtrim(F.substring(text, 1, longest - 3)), F.lit("..."))).otherwise(text)


def year_of(label: Column) -> Column:
    """The first year 20xx in a label, as an integer, else null."""
    return F.nullif(F.regexp_extract(label, r"(20\d{2})", 1), F.lit("")).cast("int")


def main_number(number: Column) -> Column:
    """The leading digits of a question number, else null."""
    return F.nullif(F.regexp_extract(number, r"^\s*(\d+)", 1), F.lit(""))


def is_subpart(number: Column) -> Column:
    """Digits and one letter a..g, dots and brackets aside."""
    return F.coalesce(F.regexp_replace(F.lower(number), r"[.()\s]", "").rlike(r"^\d+[a-g]$"), F.lit(False))


def without_line(text: Column, header: Column) -> Column:
    """The text without the lines that equal ``header``."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: F.trim(line) != F.trim(header)), "\n")


def paper_code(text: Column) -> Column:
    """The first code of four or five characters that begins with a letter or digit pair, upper-cased, with dashes made one kind."""
    return F.nullif(F.regexp_extract(F.regexp_replace(F.upper(text), "[–—−]", "-"), r"\b([A-Z]{1,3}-?\d{4,5}(?:/[A-Z]{1,4})?|\d{5})\b", 1), F.lit(""))


def containment(terms_a: Column, terms_b: Column) -> Column:
    """Share of the smaller set of terms that the other has; 0 when either is empty."""
    a, b = F.array_distinct(terms_a), F.array_distinct(terms_b)
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def jaccard(terms_a: Column, terms_b: Column) -> Column:
    union = F.size(F.array_union(terms_a, terms_b))
    return F.when(union > 0, F.size(F.array_intersect(terms_a, terms_b)) / union).otherwise(0.0)
