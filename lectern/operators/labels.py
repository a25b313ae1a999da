"""Labels of concepts: which phrases are noise, which is the most specific, and how a label is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import normalise

# Short words that are concepts of their own.
ACRONYMS = "edta ro cng lpg pvc pla hcv lcv ph emf adt ou zn pb li ion co2 h2 o2 oop adt".split()
# Words that frame a topic and are none.
GENERIC = """applications application properties property preparation mechanism construction working brief note explain
define discuss describe compute state list give write name differentiate between mustrate demonstrate derive draw sketch
what how why when where important general various following any five available carry calculate degree impact structure
classification classify types type method methods principle principles introduction overview features advantages
disadvantages uses use role function functions process processes reaction reactions equation equations diagram neat
detail examples example significance importance effect effects factors factor comparison compare difference differences
classify applications classification constituents constituent composition characteristic characteristics relevant
concept concepts trans exchange method sources source influencing rate addition illustrate cracking significance
determined estimation evolution conduction using cell cells""".split()
# How noise begins and ends, fillers at a label's begin, misread words.
NOISE_BEGIN = r"^(how|what|applications?|explain|define|discuss|describe|brief|note|give|list|write|state|compute|derive|draw|sketch|demonstrate|mustrate|and|or|the)\b"
OPEN_END = r"\b(of|and|or|the|a|an|in|on|for|with|to|from|by|at|is|are|was|were)\s*$"
FILLER = r"^((and|or|the|a|an|of|in|on|for|with|to|from|by|at)\s+)+"
MISREAD = r"\b(datemnine|hewardness|diselss|janent|bed-worth|mustrate|diselss th)\b"


def _words(text: Column) -> Column:
    return F.filter(F.split(normalise(text), " "), lambda w: w != "")


def content_words(text: Column) -> Column:
    """The words of a phrase that don't merely frame a topic."""
    return F.filter(_words(text), lambda w: ~w.isin(GENERIC))


def titled(text: Column) -> Column:
    """The text with each word's first letter a capital."""
    return F.array_join(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def polished(text: Column) -> Column:
    """A label without fillers at its begin, in title case."""
    return titled(F.regexp_replace(normalise(text), FILLER, ""))


def is_garbage(word: Column) -> Column:
    """One or two characters, three capitals, or a misread word, and no known acronym."""
    odd = (F.length(word) <= 2) | ((F.length(word) <= 3) & (word == F.upper(word)) & word.rlike(r"\p{L}")) | F.lower(word).rlike(MISREAD)
    return ~F.lower(word).isin(ACRONYMS) & odd


def is_noise(text: Column) -> Column:
    """Whether a phrase is no label: one word, an open end, a beginning of instructions, framing words only."""
    whole, words, content = normalise(text), _words(text), content_words(text)
    n, c = F.size(words), F.size(content)
    return (
        F.when(whole.rlike(MISREAD) | (n <= 1) | whole.rlike(OPEN_END), True)
        .when(whole.rlike(NOISE_BEGIN) & (n <= 4), True)
        .when(F.exists(words, is_garbage), True)
        .when((F.size(F.array_distinct(words)) < n) & F.forall(words, lambda w: F.length(w) <= 4), True)
        .when(c == 0, True)
        .when(n > c, c < 2)
        .otherwise((c == 2) & F.forall(content, lambda w: F.length(w) < 5))
    )


def rebuilt(phrase: Column) -> Column:
    """A label of the content words alone; null for a single one of fewer than six letters."""
    content = content_words(phrase)
    return F.when((F.size(content) >= 2) | ((F.size(content) == 1) & (F.length(content[0]) >= 6)), titled(F.array_join(content, " ")))


def cluster_labels(terms: DataFrame, titles: DataFrame | None = None, least: float = 0.72) -> DataFrame:
    """(scope, cluster, label) of the clusters that have a label; ``terms`` is (scope, cluster, phrase, score).

    Phrases come in the order of most content words, most words, most characters, score. The first that's no
    noise gives the label; else the first whose content words make one; else the first that is none when
    polished. With ``titles`` (scope, phrase, title, similarity) the title most similar to one of the first ten
    takes its place where the similarity reaches ``least`` and the title isn't noise.
    """
    phrase = F.col("phrase")
    order = [F.desc("content"), F.desc("words"), F.desc("chars"), F.desc("score"), F.asc("phrase")]
    ranked = terms.select("scope", "cluster", "phrase", "score", F.size(content_words(phrase)).alias("content"), F.size(_words(phrase)).alias("words"), F.length(phrase).alias("chars"), is_noise(phrase).alias("noise"), polished(phrase).alias("polished"), rebuilt(phrase).alias("rebuilt"))
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("scope", "cluster").orderBy(*order)))
    own = F.when(~F.col("noise"), F.struct(F.lit(1).alias("way"), "place", F.col("polished").alias("label")))
    bare = F.when(F.col("rebuilt").isNotNull() & ~is_noise(F.col("rebuilt")), F.struct(F.lit(2).alias("way"), "place", F.col("rebuilt").alias("label")))
    last = F.when(~is_noise(F.col("polished")), F.struct(F.lit(3).alias("way"), "place", F.col("polished").alias("label")))
    picked = ranked.groupBy("scope", "cluster").agg(F.min(F.coalesce(own, bare, last)).alias("best"), F.min(own).alias("own"))
    label = F.when(F.col("own").isNotNull(), F.when(~is_noise(F.col("own.label")), F.col("own.label"))).otherwise(polished(F.col("best.label")))
    out = picked.select("scope", "cluster", label.alias("label"))
    if titles is not None:
        chosen = ranked.join(picked.select("scope", "cluster", F.col("own").isNotNull().alias("clean")), ["scope", "cluster"]).where(~F.col("clean") | ~F.col("noise"))
        chosen = chosen.withColumn("place", F.row_number().over(Window.partitionBy("scope", "cluster").orderBy("place"))).where("place <= 10")
        near = chosen.join(titles, ["scope", "phrase"]).groupBy("scope", "cluster").agg(F.max_by(F.struct("similarity", "title"), F.struct(F.col("similarity"), -F.col("place"))).alias("t"))
        near = near.where((F.col("t.similarity") >= least) & ~is_noise(F.col("t.title"))).select("scope", "cluster", "t.title")
        out = out.join(near, ["scope", "cluster"], "left").select("scope", "cluster", F.coalesce("title", "label").alias("label"))
    return out.where(F.col("label").isNotNull() & ~is_noise(F.col("label")))
