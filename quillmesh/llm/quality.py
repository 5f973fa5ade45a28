"""Text statistics of a document, and from them whether it is natural prose.

One pass over the text makes a narrow row of statistics. Each statistic is then ranked exactly within its language: equal
values are counted together, the distinct values are range-partitioned and sorted, and partition offsets turn places
into cumulative counts. The tail probabilities of several statistics, each on the side where lists, tables and junk lie,
combine into an outlier score. In every language a document that is just no prose any more (BOUNDARY) is ranked among the
real ones, without being counted; what is at least as far out as it is no prose. So the ranks decide, and what share of
the documents is junk, and how many copies there are, does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.skew import range_cumulate, salted_join
from quillmesh.session import cut

#: Frequent function words of each language. Words that names of bodies and works are made of too (the, of,
#: in, for, on) are left out, as a list of such names is no prose.
COMMON_WORDS = {
    "en": "a an and was were to by with is at that so but from which while although because has had been after before near later despite as it up not he they she his her are this there what who when where until still never two some few most during towards against without together according made became used said same whereas also then",
    "de": "der die das und war zu von mit im den dem ein eine es nicht dass nach bis aus auf für sich als ist wurde hat weil obwohl aber",
    "fr": "la le les de du des à et en était que pour un une est dans il elle mais ce car qui au par",
    "es": "de la el los las en y que por un una es era con se su para como pero al ya del",
}

#: Words by which a window is read as a sentence of the document's language. In French and Spanish
#: the articles and de, of which names are made too, are left out here; other frequent words stand in for them.
SENTENCE_WORDS = COMMON_WORDS | {
    "fr": "à et en était que pour un une est dans il elle mais ce car qui par on ne pas se été sont fut avait plus avec lors cette dont où après avant pendant selon ses son sa leur alors bien peu ainsi",
    "es": "en y que por un una es era con se su para como pero al ya fue no ha más sus este esta cuando donde aunque desde hasta durante según antes después sin entonces poco también está estaba había",
}

#: Words of a window, within a paragraph, in which sentences are told from lists, tables and junk.
WINDOW = 40
#: A window belongs to a sentence if it has a common word of the document's language in this many words at most, ...
WORDS_PER_COMMON = 20
#: ... so many of them at least, or one in lower case and the end of a sentence (else it may be part of a name: War, Los), ...
LEAST_COMMON = 2
#: ... and at most this share of symbols and digits.
SYMBOLS = 0.14
#: Visible characters that count as a word where there may be none.
MEAN_LETTERS = 6
#: Languages with fewer distinct texts than this are ranked together.
LEAST_GROUP = 100

#: The document that is just no prose any more: value of each statistic, side of the tail (-1 low, 1 high) and weight.
#: Values and weights were set by looking at the test tables.
BOUNDARY = {"sentence_share": (0.5, -1, 2.0), "telling_share": (0.07, -1, 1.0)}

STATS = ("mean_word", "symbol_share", "line_end_share", "common_share", "digit_share", "line_words")


def language(lang: Column) -> Column:
    """A language tag as written by anybody, brought to two lower-case letters; null if there is none."""
    return F.nullif(F.lower(F.substring(F.trim(lang), 1, 2)), F.lit(""))


def document_stats(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, n_chars, n_words, mean_word, symbol_share, line_end_share, common_share, digit_share, line_words,
    telling_share, sentence_share, digest) of every document.

    lang is the language with the most common words, or else the one that is declared, or else `und`. Shares are of
    characters without white space (symbols, digits), of lines that are not blank (line ends), of words (common words).
    telling_share counts words of SENTENCE_WORDS for every
    MEAN_LETTERS visible characters. sentence_share is the share of characters in windows that belong to sentences, digest that of the text. A null or blank text has zeros
    throughout. Whole texts are counted.
    """
    doc = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"), language(F.col(lang)).alias("tag")).where("doc_id is not null")
    paragraphs = F.split("t", r"\n\s*\n\s*")
    windows = F.flatten(F.transform(paragraphs, lambda p: F.regexp_extract_all(p, F.lit(rf"(?:\S+(?:\s+|\z)){{1,{WINDOW}}}"), F.lit(0))))

    def black(x: Column) -> Column:
        return F.length(F.translate(x, " \n\r\t\u00a0", ""))

    def read(w: Column) -> Column:
        return F.struct(w.alias("raw"), F.length(w).alias("chars"), black(w).alias("black"), F.filter(F.split(F.lower(w), r"[^\p{L}\p{M}]+"), lambda x: x != "").alias("words"))

    def measure(w: Column) -> Column:
        return F.struct(w["raw"].alias("raw"), w["chars"].alias("chars"), w["black"].alias("black"), w["words"].alias("words"), F.length(F.array_join(w["words"], "")).alias("letters"))

    def lone(w: Column) -> Column:
        return F.exists(F.split(w["raw"], r"[^\p{L}\p{M}]+"), lambda x: F.array_contains("own", x)) & w["raw"].rlike(r"[.!?…][\"'”’»)\]]*(\s|$)")

    def count_of(w: Column, common: list[str]) -> Column:
        return F.size(F.filter(w["words"], lambda x: x.isin(common)))

    def counted_in(w: Column) -> Column:
        """The words of the document's language: constant sets are hashed, and only one of them is looked at."""
        common = F.coalesce(*(F.when(F.col("found") == k, count_of(w, v.split())) for k, v in SENTENCE_WORDS.items()), F.lit(0))
        return F.struct(w["raw"].alias("raw"), w["chars"].alias("chars"), w["black"].alias("black"), w["letters"].alias("letters"), F.size(w["words"]).alias("n"), common.alias("common"))

    def in_sentence(w: Column) -> Column:
        fine = (w["common"] > 0) & (w["common"] * WORDS_PER_COMMON >= w["n"]) & (w["black"] - w["letters"] <= w["chars"] * SYMBOLS)
        return F.when(fine & ((w["common"] >= LEAST_COMMON) | lone(w)), w["chars"]).otherwise(0)

    def total(of) -> Column:
        return F.aggregate("w", F.lit(0), lambda acc, w: acc + of(w))

    line_ends = list(".!?…:;")
    lines = F.filter(F.transform(F.split("t", "\n"), lambda x: F.rtrim(x, F.lit(" \t\r\"'”’»)]"))), lambda x: x != "")
    doc = doc.select("doc_id", "tag", "t", F.transform(windows, read).alias("w"), lines.alias("lines"))
    doc = doc.select("doc_id", "tag", "t", "lines", F.transform("w", measure).alias("w"))
    doc = doc.withColumn("all", F.flatten(F.transform("w", lambda w: w["words"])))
    doc = doc.select("*", *(F.size(F.filter("all", (lambda w: lambda x: x.isin(w))(v.split()))).alias(f"h_{k}") for k, v in COMMON_WORDS.items()))
    most = F.greatest(*(F.col(f"h_{k}") for k in COMMON_WORDS))
    found = F.coalesce(*(F.when((F.col(f"h_{k}") == most) & (most > 0), F.lit(k)) for k in COMMON_WORDS))
    own = F.coalesce(*(F.when(found == k, F.array(*map(F.lit, v.split()))) for k, v in SENTENCE_WORDS.items()), F.array().cast("array<string>"))
    doc = doc.select("*", found.alias("found"), F.coalesce(found, F.col("tag"), F.lit("und")).alias("lang"), most.alias("common"), own.alias("own"))
    doc = doc.withColumn("w", F.transform("w", counted_in)).withColumn("n_words", F.size("all")).drop("all")
    counted = doc.select(
        "doc_id", "lang", "common", F.md5("t").alias("digest"), "n_words", F.length("t").alias("n_chars"), F.size("lines").alias("lines"),
        F.size(F.filter("lines", lambda x: F.right(x, F.lit(1)).isin(line_ends))).alias("ends"),
        (F.length("t") - F.length(F.translate("t", "0123456789", ""))).alias("digits"),
        total(lambda w: w["letters"]).alias("letters"), total(lambda w: w["black"]).alias("black"), total(in_sentence).alias("prose"), total(lambda w: w["common"]).alias("telling"),
    )

    def ratio(a: Column, b: str) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return counted.select(
        "doc_id", "lang", "n_chars", "n_words",
        ratio(F.col("letters"), "n_words").alias("mean_word"),
        ratio(F.col("black") - F.col("letters"), "black").alias("symbol_share"),
        ratio(F.col("ends"), "lines").alias("line_end_share"),
        ratio(F.col("common"), "n_words").alias("common_share"),
        ratio(F.col("digits"), "black").alias("digit_share"),
        ratio(F.col("n_words"), "lines").alias("line_words"),
        ratio(F.col("telling") * MEAN_LETTERS, "black").alias("telling_share"),
        ratio(F.col("prose"), "n_chars").alias("sentence_share"),
        "digest",
    )


def _long(stats: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(doc_id, lang, stat, value), a row for each statistic."""
    rows = F.array(*(F.struct(F.lit(i).alias("stat"), F.col(n).alias("value")) for i, n in enumerate(names)))
    return stats.select("doc_id", "lang", F.explode(rows).alias("x")).select("doc_id", "lang", "x.stat", "x.value")


def _ranked(long: DataFrame) -> DataFrame:
    """long(doc_id, lang, stat, value) with how many documents of the language are `below` a value, `same` and in `all`.
    Rows without doc_id are ranked, but not counted."""
    counts = long.groupBy("stat", "lang", "value").agg(F.count("doc_id").alias("same"))
    cum = cut(range_cumulate(counts.withColumn("n", F.col("same")), ["stat", "lang", "value"], "n"))
    spans = cum.groupBy("stat", "lang").agg(F.min(F.col("cum") - F.col("same")).alias("before"), F.sum("same").alias("all"))
    places = salted_join(cum, spans, ["stat", "lang"]).select("stat", "lang", "value", (F.col("cum") - F.col("same") - F.col("before")).alias("below"), "same", "all")
    return salted_join(long, places, ["stat", "lang", "value"])


def outlier_scores(stats: DataFrame, names: tuple[str, ...] = STATS) -> DataFrame:
    """(doc_id, low, high, score): the sums of -ln of the lower and upper tail probabilities of all statistics within the
    language, and the larger of both and of the sum of each statistic's smaller tail.

    Equal values share one tail probability. Ids must be unique; repeated rows weigh as often as they occur.
    """
    low, high = (F.col("below") + F.col("same")) / F.col("all"), (F.col("all") - F.col("below")) / F.col("all")
    each = _ranked(_long(stats, names)).select("doc_id", (-F.log(low)).alias("lo"), (-F.log(high)).alias("hi"))
    sums = each.groupBy("doc_id").agg(F.sum("lo").alias("low"), F.sum("hi").alias("high"), F.sum(F.greatest("lo", "hi")).alias("both"))
    return sums.select("doc_id", "low", "high", F.greatest("low", "high", "both").alias("score"))


def prose_scores(stats: DataFrame) -> DataFrame:
    """(doc_id, score, threshold): the weighted sum of -ln of the tail probabilities that BOUNDARY names, within the
    language, and that of the boundary document.

    Ties count half, so copies and a table of junk alone lie beyond the boundary, not on it. Ids must be unique.
    """
    names = tuple(BOUNDARY)
    edge = F.array(*(F.struct(F.lit(i).alias("stat"), F.lit(v).cast("double").alias("value")) for i, (v, _, _) in enumerate(BOUNDARY.values())))
    edges = stats.select("lang").distinct().select(F.lit(None).cast("bigint").alias("doc_id"), "lang", F.explode(edge).alias("x")).select("doc_id", "lang", "x.stat", "x.value")
    side, weight = (F.element_at(F.array(*(F.lit(float(x[k])) for x in BOUNDARY.values())), F.col("stat") + 1) for k in (1, 2))
    middle = F.col("below") + F.col("same") / 2
    tail = (F.when(side < 0, middle).otherwise(F.col("all") - middle) + 0.5) / (F.col("all") + 1)
    each = cut(_ranked(_long(stats, names).unionByName(edges)).select("doc_id", "lang", (-F.log(tail) * weight).alias("part")))
    thresholds = each.where("doc_id is null").groupBy("lang").agg(F.sum("part").alias("threshold"))
    scores = each.where("doc_id is not null").groupBy("doc_id", "lang").agg(F.sum("part").alias("score"))
    return salted_join(scores, thresholds, ["lang"]).select("doc_id", F.round("score", 9).alias("score"), F.round("threshold", 9).alias("threshold"))


def prose_report(df: DataFrame, outliers: bool = False) -> DataFrame:
    """Statistics of every document with its outlier score, the threshold of its language and is_prose: is the score below?

    Scores are those of distinct texts, so that copies do not make each other ordinary; languages with few texts are
    ranked together, so that a text is not alone. outliers adds `low` and `high`, how unusual a text is over all STATS to
    either side. A table without rows gives an empty report.
    """
    stats = cut(document_stats(df))
    used = dict.fromkeys((*BOUNDARY, *(STATS if outliers else ())))
    texts = stats.groupBy("digest", "lang").agg(F.min("doc_id").alias("doc_id"), *(F.first(n).alias(n) for n in used))
    sizes = texts.groupBy("lang").agg(F.count("*").alias("texts"))
    ranked = cut(salted_join(texts, sizes, ["lang"]).withColumn("group", F.when(F.col("texts") < LEAST_GROUP, F.lit("few")).otherwise(F.col("lang"))))
    grouped = ranked.drop("lang").withColumnRenamed("group", "lang")
    scores = prose_scores(grouped)
    if outliers:
        scores = scores.join(outlier_scores(grouped).drop("score"), "doc_id")
    keyed = ranked.select("doc_id", "digest", "lang").join(scores, "doc_id").drop("doc_id")
    return salted_join(stats, keyed, ["digest", "lang"]).withColumn("is_prose", F.col("score") < F.col("threshold")).drop("digest")
