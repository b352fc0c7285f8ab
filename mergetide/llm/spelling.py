"""Groups of spelling variants: words one edit apart, found by a frontier that walks a trie level by level.

The trie is a table of edges: a node is a prefix of words, a row has the letters that follow it and, for each, the letters
that follow next and whether a word ends there.  A state is (word, position, node, edits); a level joins the states with the
nodes of one depth.  States without an edit are the words themselves at their own prefix; they insert a letter or replace
theirs by a later one wherever the next letter of the word goes on from there.  States with an edit follow their word.  A state
whose word ends where a word of the trie ends is a pair of neighbours; deletions are insertions seen from the other word, and
pairs are mirrored.  An insertion of the letter that follows would give the same word as one behind it, and is left to that.

Near the root every letter follows every prefix.  So words are in the trie as they are and turned round, and each way only the
half that is read last is edited: there few letters follow, and every edit lies in the last half of one of the two.

Words of more than ``LONG`` letters would make as many levels; they are compared by what all but one of their pieces hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergetide.sources.shared import cut, free

RUN = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: what a word begins with in the trie, as it is and turned round
ONWARD, TURNED = ">", "<"
LONG = 48
PIECE = 12
#: levels that go down in one job; the states are written after them
LEVELS = 4


def word_counts(docs: DataFrame, least_chars: int = 7, least_n: int = 2, spoil: int = 31) -> DataFrame:
    """``word, n``: lower-cased runs of letters with their number, those of enough letters and occurrences.

    Where ``spoil`` divides the crc32 of ``<doc_id>:<run>``, the run loses the letter at crc32 modulo its length; 0 spoils
    none.  A null id spoils none, a null text has no runs.
    """
    whole = f"[{RUN}]{{{least_chars},}}"  # a shorter run cannot become long enough
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(whole), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    word = F.col("run")
    if spoil:
        h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % spoil == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(word)
    counted = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= least_chars) & (F.col("n") >= least_n))


def both_ways(words: DataFrame) -> DataFrame:
    """``word, since``: each word as it is and turned round, behind a sign for that, and the position where edits begin."""
    half = F.floor(F.length("word") / 2).cast("int")
    ways = F.array(F.struct(F.concat(F.lit(ONWARD), "word").alias("word"), (half + 1).alias("since")), F.struct(F.concat(F.lit(TURNED), F.reverse("word")).alias("word"), (F.length("word") - half + 1).alias("since")))
    return words.select(F.explode(ways).alias("w")).select("w.word", "w.since")


def trie_of(words: DataFrame, since: int) -> DataFrame:
    """``depth, node, edges``: the letters that follow each prefix of ``since`` letters or more, each with those that follow it
    and whether a word ends there.  A node has at most 90 edges, as there are letters, and each at most as many letters."""
    cuts = words.select("word", F.explode(F.sequence(F.lit(since), F.length("word") - 1)).alias("at"))
    steps = cuts.select(F.substring("word", F.lit(1), F.col("at")).alias("node"), F.substring("word", F.col("at") + 1, F.lit(1)).alias("letter")).distinct()
    both = steps.withColumn("ends", F.lit(False)).unionByName(words.select(F.col("word").alias("node"), F.lit("").alias("letter"), F.lit(True).alias("ends")))
    nodes = both.groupBy("node").agg(F.array_join(F.collect_list("letter"), "").alias("next"), F.max("ends").alias("ends")).where(F.length("node") > since)
    edge = F.struct(F.substring("node", -1, 1).alias("letter"), "next", "ends")
    parent = F.substring("node", F.lit(1), F.length("node") - 1)
    # the last node of a path has no letters behind it, and its parent may have only it
    grouped = nodes.select(parent.alias("node"), edge.alias("edge")).groupBy("node").agg(F.collect_list("edge").alias("edges"))
    return grouped.select(F.length("node").alias("depth"), "node", "edges").sortWithinPartitions("depth")  # a level reads its own rows


def stepped(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """States ``word, position, node, edits`` one node deeper; those at the end of their word end at a word of the trie, and stay."""
    size, position, first = F.length("word"), F.col("position"), F.col("edits") == 0
    met = states.withColumn("ended", ~first & (position == size)).join(nodes.withColumnRenamed("node", "_node"), (F.col("node") == F.col("_node")) & ~F.col("ended"), "left")
    met = met.select("word", "position", "node", "edits", "ended", F.explode_outer("edges").alias("e")).where("ended or e is not null")
    tried = met.select("*", F.substring("word", position + 1, F.lit(1)).alias("letter"), F.explode(F.array(F.lit(0), F.lit(1))).alias("read"))  # letters of the word
    inserted = first & (F.col("read") == 0) & (F.col("e.letter") != F.col("letter"))
    replaced = first & (F.col("read") == 1) & (F.col("e.letter") > F.col("letter")) & (position < size)
    followed = ~first & (F.col("read") == 1) & (F.col("e.letter") == F.col("letter"))
    to = position + F.col("read")
    alive = F.when(to == size, F.col("e.ends")).otherwise(F.contains(F.col("e.next"), F.substring("word", to + 1, F.lit(1))))
    stay = F.col("ended") & (F.col("read") == 0)
    deeper = tried.where(stay | (~F.col("ended") & (inserted | replaced | followed) & alive))
    return deeper.select("word", to.alias("position"), F.when(F.col("ended"), F.col("node")).otherwise(F.concat("node", "e.letter")).alias("node"), F.lit(1).alias("edits"))


def trie_pairs(words: DataFrame) -> DataFrame:
    """``word, near``: pairs of ``words(word)`` of at most ``LONG`` letters that are one edit apart, each once, one way."""
    spark = words.sparkSession
    ways = cut(both_ways(words.where(F.length("word") <= LONG)), "ways")
    span = ways.agg(F.min("since").alias("first"), F.max(F.length("word")).alias("last")).first()
    if span["first"] is None:
        return spark.createDataFrame([], "word string, near string")
    trie = cut(trie_of(ways, span["first"]), "trie")
    ended = F.col("position") == F.length("word")
    pairs, written = [], []
    before = spark.createDataFrame([], "word string, position int, node string, edits int")
    for depth in range(span["first"], span["last"] + 1):
        own = ways.where((F.length("word") >= depth) & (F.col("since") <= depth))
        states = own.select("word", F.lit(depth).alias("position"), F.substring("word", 1, depth).alias("node"), F.lit(0).alias("edits"))
        before = stepped(before.unionByName(states), trie.where(F.col("depth") == depth).select("node", "edges"))
        if (depth - span["first"]) % LEVELS == LEVELS - 1 or depth == span["last"]:
            level = cut(before, "states")
            pairs.append(level.where(ended).select("word", F.col("node").alias("near")))
            before = level.where(~ended)
            written.append(level)
    plain = lambda c: F.when(F.startswith(c, F.lit(ONWARD)), F.substring(c, 2, LONG + 1)).otherwise(F.reverse(F.substring(c, 2, LONG + 1)))
    found = reduce(DataFrame.unionByName, pairs).select(plain(F.col("word")).alias("word"), plain(F.col("near")).alias("near"))
    swap = (F.length("near") == F.length("word")) & (F.col("near") < F.col("word"))  # turned round, the later letter may be in the smaller word
    found = cut(found.select(F.when(swap, F.col("near")).otherwise(F.col("word")).alias("word"), F.when(swap, F.col("word")).otherwise(F.col("near")).alias("near")).distinct(), "pairs")
    free(spark, ways, trie, *written)
    return found


def long_pairs(words: DataFrame) -> DataFrame:
    """``word, near``: pairs of ``words(word)`` one edit apart of which one has more than ``LONG`` letters.

    The shorter word is cut into pieces of ``PIECE`` letters; an edit leaves what is before and after one of them as it is, in
    both words.  Words that agree in that are compared.
    """
    words = words.where(F.length("word") >= LONG)
    size = F.length("word")

    def keyed(rows: DataFrame, as_long: Column) -> DataFrame:
        """A row for each piece left out, of a word seen as partner of one with ``as_long`` letters."""
        pieces = F.explode(F.sequence(F.lit(0), F.floor(F.col("short") / PIECE).cast("int") - 1)).alias("piece")
        rows = rows.withColumn("short", as_long).select("word", "short", pieces)
        last = F.col("piece") == F.floor(F.col("short") / PIECE) - 1
        behind = F.when(last, 0).otherwise(F.col("short") - (F.col("piece") + 1) * PIECE)
        rest = F.concat(F.substring("word", F.lit(1), F.col("piece") * PIECE), F.lit("|"), F.when(behind > 0, F.substring("word", size - behind + 1, behind)).otherwise(""))
        return rows.select("word", "short", "piece", F.md5(rest.cast("binary")).alias("rest"))

    short = keyed(words, size)
    other = keyed(words, size).unionByName(keyed(words.where(size > LONG), size - 1)).withColumnRenamed("word", "near")
    met = short.join(other, ["short", "piece", "rest"]).where((F.length("near") > LONG) & ((F.length("near") > size) | (F.col("near") > F.col("word"))))
    return met.where(F.levenshtein("word", "near", 1) == 1).select("word", "near").distinct()


def spelling_variants(counts: DataFrame, times: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of ``counts(word, n)``.

    Two words are near if one inserted, deleted or replaced letter makes one of the other.  A word's form is its near word
    with the largest ``n`` (of several the first in code-point order), if that is at least ``times`` its own, else null; its
    root is what forms lead to in the end, the word itself without one.  Words without neighbours have ``n_near`` 0.
    """
    spark = counts.sparkSession
    counts = cut(counts.select("word", "n"), "words")
    words = counts.select("word")
    once = cut(trie_pairs(words).unionByName(long_pairs(words)), "pairs")
    near = once.unionByName(once.select(F.col("near").alias("word"), F.col("word").alias("near")))
    sized = near.join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = sized.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    rows = counts.join(best, "word", "left").withColumn("large", -F.col("best.minus") >= times * F.col("n"))
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("large"), F.col("best.near")).alias("form"), F.when(F.col("large"), -F.col("best.minus")).alias("form_n"))
    rows = cut(rows, "forms")
    roots = ends_of(rows.where("form is not null").select("word", F.col("form").alias("root")))
    out = rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    free(spark, once)
    return out


def ends_of(links: DataFrame) -> DataFrame:
    """``word, root``: where chains of ``links(word, root)`` end.  Each round doubles the steps; counts grow tenfold a step, so
    that chains have 18 steps and this takes five rounds at most."""
    links = cut(links, "roots")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("on"))
        longer = cut(links.join(on, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "roots")
        links = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return links
