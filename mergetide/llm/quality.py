"""Quality rules: a threshold table compiled into one Spark projection; no user functions anywhere.

Words are maximal runs of characters other than space and U+0009 to U+000D.  Defined results at the edges:
null or empty text has no words and fails the base rule; ratios over zero words count as 0; very long texts are
scored whole; repeated rows are scored one by one; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Frequent short words of English, German, French and Spanish, lower case.
STOP_WORDS = (
    "the of and to in is that it for was with as be on by are this an at from or a "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch in "
    "de la le et les des en un une est que dans qui pour par sur au avec ce pas du "
    "el los las del se por con para su al lo y es"
).split()

#: name of a ratio, lowest and highest value that is kept (None: open end).
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("mean_word_chars", 2.0, 12.0),
    ("symbol_ratio", None, 0.1),
    ("stop_word_ratio", 0.06, None),
    ("dup_line_ratio", None, 0.5),
    ("repeat_word_ratio", None, 0.5),
]


def joined_words(text: Column) -> Column:
    """The words of ``text`` joined by one space; empty without words."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def repeat_words(words: Column, n: Column) -> tuple[Column, Column]:
    """The hashes ``w3`` of the 3-word windows, and from that column the number of words inside windows found at least twice.

    Each window is one 64-bit hash (chance of a wrong count within a text of 20,000 words: 1e-11); only texts whose
    distinct windows are fewer than their windows sort them, and equal neighbours in that order give the repeated
    positions.
    """
    last = (n - F.lit(3)).cast("int")
    ids = F.transform(
        F.arrays_zip(F.slice(words, F.lit(1), last + 1).alias("a"), F.slice(words, F.lit(2), last + 1).alias("b"), F.slice(words, F.lit(3), last + 1).alias("c")),
        lambda x: F.xxhash64(x["a"], x["b"], x["c"]),
    )
    ordered = F.sort_array(F.arrays_zip(F.col("w3").alias("w"), F.sequence(F.lit(0), last).alias("i")))

    def repeated(z: Column, j: Column) -> Column:
        here = F.get(z, j)["w"]
        return F.when((F.get(z, j - 1)["w"] == here) | (F.get(z, j + 1)["w"] == here), F.get(z, j)["i"])

    # one-element transforms bind the sorted windows and the hits once, so that they are not made again for every position
    hits = F.transform(F.array(ordered), lambda z: F.array_compact(F.transform(F.sequence(F.lit(0), last), lambda j: repeated(z, j))))
    covered = F.transform(hits, lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda x: x + 1), F.transform(p, lambda x: x + 2)))))
    some = F.size(F.array_distinct("w3")) < last + 1
    return F.when(n < 4, F.array().cast("array<bigint>")).otherwise(ids), F.when(n < 4, F.lit(0)).when(some, F.get(covered, F.lit(0))).otherwise(F.lit(0)).cast("long")


def ratio(over: Column, under: Column) -> Column:
    return F.when(under > 0, over / under).otherwise(F.lit(0.0))


def compile_rules(thresholds: list[tuple[str, float | None, float | None]]) -> Column:
    """One boolean column: every ratio lies within its bounds."""
    kept = F.lit(True)
    for name, low, high in thresholds:
        if low is not None:
            kept = kept & (F.col(name) >= F.lit(low))
        if high is not None:
            kept = kept & (F.col(name) <= F.lit(high))
    return kept


def quality_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and ratios of each text."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = t.withColumn("j", joined_words(F.col("t")))
    t = t.withColumn("ws", F.when(F.col("j") == "", F.array().cast("array<string>")).otherwise(F.split("j", " ")))
    ids, repeats = repeat_words(F.col("ws"), F.size("ws"))
    t = t.withColumn("w3", ids)
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    t = t.select(
        "doc_id",
        F.size("ws").cast("long").alias("n_words"),
        (F.length("j") - F.greatest(F.size("ws") - 1, F.lit(0))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d")))[0].alias("l"),
        F.size(F.filter("ws", lambda w: w.isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
        repeats.alias("n_repeat_words"),
    )
    return t.select(
        "doc_id", "n_words", "word_chars", "n_symbols", (F.col("l.n") - F.col("l.d")).alias("n_dup_lines"), "n_repeat_words", "n_stop_words",
        ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        ratio(F.col("n_symbols"), F.col("n_words")).alias("symbol_ratio"),
        ratio(F.col("n_stop_words"), F.col("n_words")).alias("stop_word_ratio"),
        ratio(F.col("l.n") - F.col("l.d"), F.col("l.n")).alias("dup_line_ratio"),
        ratio(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_word_ratio"),
    )


def quality_rules(docs: DataFrame, thresholds: list[tuple[str, float | None, float | None]] | None = None, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of each row of ``docs``."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = quality_features(docs, id_col, text_col).withColumn("base_failed", base)
    return rows.withColumn("kept", ~F.col("base_failed") & compile_rules(THRESHOLDS if thresholds is None else thresholds))
