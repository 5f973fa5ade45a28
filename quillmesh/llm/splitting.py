"""Pieces of bounded size, cut at natural boundaries, with a given overlap.

One regular expression with bounded quantifiers cuts a text: its alternatives, from the strongest boundary to the
weakest, each take as much as the limit allows. Looking back over the bodies before a cut gives the overlap that goes
before the piece, and offsets are running sums of lengths. Everything is built in SQL array functions, needs no shuffle, takes time in
proportion to a text however long it is, and counts code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limit and overlap in code points.
LIMIT, OVERLAP = 800, 100

_TRIM = r"^[ \t\r\n]+|[ \t\r\n]+$"


def trimmed(text: Column) -> Column:
    """The text without spaces, tabs and line breaks at its ends."""
    return F.regexp_replace(text, _TRIM, "")


def boundary_pattern(size: int) -> str:
    """Cuts of at most `size` code points: rest of the text, paragraph, sentence, line, word, and last any character.

    The strong boundaries must leave a piece at least a quarter full, else the next weaker one is taken.
    """
    low = max(size // 4, 1)
    ends = [r"(?=\n[ \t]*\r?\n)", r"(?<=[.!?…。][\"'”’»)\]]{0,2})(?=[\s\p{Z}])", r"(?=\r?\n)", r"(?=[\s\p{Z}])"]
    lows = [low, low, low, 1]
    return "(?s)" + "|".join([rf".{{1,{size}}}\z", *(f".{{{n},{size}}}{e}" for n, e in zip(lows, ends)), f".{{1,{size}}}"])


#: Lengths that are summed up at a time, see _ends.
_RUN = 128


def _let(value: Column, then) -> Column:
    """then(value), where value is worked out once however often `then` uses it."""
    return F.transform(F.array(value), then)[0]


def _running(lengths: Column) -> Column:
    """Running sums of an array of lengths. An array that grows item by item is copied at each of them, so it is kept to
    _RUN items: sums run inside stretches of that many, then over the stretches."""

    def run(xs: Column) -> Column:
        return F.aggregate(xs, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)))

    def add(runs: Column) -> Column:
        before = run(F.transform(runs, lambda r: F.element_at(r, -1)))
        return _let(before, lambda b: F.flatten(F.transform(runs, lambda r, i: F.transform(r, lambda x: x + F.when(i > 0, F.get(b, i - 1)).otherwise(0)))))

    starts = F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)), F.lit(_RUN))
    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(_let(F.transform(starts, lambda k: run(F.slice(lengths, k + 1, F.lit(_RUN)))), add))


def split_pieces(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """array<struct<start int, piece string>> of a text that is already trimmed.

    A text within the limit is one piece. Otherwise the bodies of the pieces, without their overlap, make up the text
    without gaps; a piece begins `overlap` code points before its body (the first at 0) and so has at most `limit`. A
    body that is white space throughout is not handed out. Null gives null, the empty text an empty array.
    """
    assert 0 <= overlap < limit
    pattern = F.lit(boundary_pattern(limit - overlap))
    bodies = F.when(F.length(text) > limit, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.filter(F.array(text), lambda b: b != ""))

    def before(cuts: Column, k: Column) -> Column:
        """The last `overlap` code points before cut k: of the body before it, or of as many as there are code points."""
        last = F.get(cuts, k - 1)
        far = F.array_join(F.slice(cuts, F.greatest(k - overlap, F.lit(0)) + 1, F.least(k, F.lit(overlap))), "")
        return F.when(k == 0, F.lit("")).otherwise(F.right(F.when(F.length(last) >= overlap, last).otherwise(far), F.lit(overlap)))

    def place(cuts: Column) -> Column:
        over = F.transform(cuts, lambda b, k: before(cuts, k)) if overlap else F.transform(cuts, lambda b: F.lit(""))
        both = F.arrays_zip(cuts.alias("body"), over.alias("over"), _running(F.transform(cuts, F.length)).alias("end"))
        return F.transform(both, lambda x: F.struct((x["end"] - F.length(x["body"]) - F.length(x["over"])).alias("start"), F.concat(x["over"], x["body"]).alias("piece"), x["body"].rlike(r"[^\s\p{Z}]").alias("shown")))

    shown = F.filter(_let(bodies, place), lambda x: x["shown"])
    return F.when(text.isNotNull(), F.transform(shown, lambda x: F.struct(x["start"].alias("start"), x["piece"].alias("piece"))))


def chunk_items(chunks: DataFrame) -> DataFrame:
    """(src, item_id, ctx_no, text) of passages; null texts are no items."""
    return chunks.select(F.lit("chunk").alias("src"), F.col("chunk_id").cast("string").alias("item_id"), F.lit(0).alias("ctx_no"), trimmed(F.col("text")).alias("text")).where("text is not null")


def question_items(questions: DataFrame) -> DataFrame:
    """(src, item_id, ctx_no, text) of the paragraphs of questions: sentences stripped, blank ones left out, joined by a
    space. A question delivered again gives the same rows again."""
    para = questions.select(F.col("id").alias("item_id"), F.posexplode("context").alias("ctx_no", "p"))
    sentences = F.filter(F.transform(F.col("p.sentences"), trimmed), lambda s: s.isNotNull() & s.rlike(r"[^\s\p{Z}]"))
    return para.select(F.lit("question").alias("src"), "item_id", "ctx_no", F.array_join(sentences, " ").alias("text")).where("text is not null")


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Adds `pieces` (see split_pieces) to (src, item_id, ctx_no, text)."""
    return items.withColumn("pieces", split_pieces(F.col("text"), limit, overlap))


def pieces_table(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row a piece: src, item_id, ctx_no, piece_no, start, n_chars, piece."""
    exploded = split_items(items, limit, overlap).select("src", "item_id", "ctx_no", F.posexplode("pieces").alias("piece_no", "x"))
    return exploded.select("src", "item_id", "ctx_no", "piece_no", "x.start", F.length("x.piece").alias("n_chars"), "x.piece")


def oversized(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(src, item_id, ctx_no) of the items that had to be cut; repeated items once."""
    return split_items(items, limit, overlap).where(F.size("pieces") > 1).select("src", "item_id", "ctx_no").distinct()
