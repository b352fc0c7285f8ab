"""Ranked lexical search over K2-treaps: quadtrees of the term-document grid whose cells hold the largest impact below them.

An index is a table with a row for each block of documents: ids in ascending order (the columns of the grid), terms in order
(its rows), and the quadtree, compressed: a cell keeps which of its quarters hold anything and how much less than its parent
its maximum is, so that empty regions take no space.  Blocks are bounded in documents and bytes and are made where the
documents are read; nothing is shuffled.

A search walks a block for one item at a time: the paths of the item's terms go down together over ranges of documents, the
ranges with the largest sum of weighted maxima first, and ranges whose sum cannot reach the item's last place are given up.
Each task keeps an item's best documents over all its blocks, so that later blocks are given up sooner; the tasks' lists are
merged by a ranked window.  Items travel in batches of bounded size.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergetide.sources.shared import cut

#: What is no term: ASCII without letters and digits.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes to lower-case letters, digits and what is not ASCII; others become spaces
FOLD = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))
BLOCK_DOCS = 4096
BLOCK_BYTES = 8 << 20
BATCH_BYTES = 8 << 20
#: ranges that go down at once
WIDTH = 256
POP = np.array([bin(i).count("1") for i in range(16)], np.int64)
#: how many quarters of a cell lie before each of its quarters
BEFORE = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], np.int64)

INDEX = "n_docs int, ids array<long>, terms array<string>, dfs array<int>, depth int, sizes array<int>, quarters binary, drops binary"


def terms_of(data: bytes) -> list[bytes]:
    return data.translate(FOLD).split()


def item_terms(text: Column) -> Column:
    """Distinct terms of a text column."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0)))


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents that have a term, and all terms with repeats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        for b in batches:
            for data in b["data"].to_pylist():
                n = len(terms_of(data))
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
        yield pa.RecordBatch.from_pydict({"n_docs": [n_docs], "n_terms": [n_terms]})

    found = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("data")).mapInArrow(count, "n_docs long, n_terms long")
    row = found.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_terms").alias("n_terms")).first()
    return row["n_docs"] or 0, row["n_terms"] or 0


def spread_bits(x: np.ndarray) -> np.ndarray:
    """Bits of numbers below 2**31 at the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def tree_of(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, depth: int) -> tuple[list[int], bytes, bytes]:
    """Cells a level, their quarters and how much their maxima drop from the parent's, of a grid of 2**depth places a side."""
    keys = spread_bits(rows) << np.uint64(1) | spread_bits(cols)
    order = np.argsort(keys)
    keys, best = keys[order], values[order]
    levels, quarters = [best], []
    for _ in range(depth):
        up = keys >> np.uint64(2)
        first = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
        quarters.append(np.bitwise_or.reduceat(np.uint8(1) << (keys & np.uint64(3)).astype(np.uint8), first))
        keys, best = up[first], np.maximum.reduceat(best, first)
        levels.append(best)
    levels.reverse()
    quarters.reverse()
    drops = [levels[0]] + [np.repeat(above, POP[q]) - own for above, q, own in zip(levels, quarters, levels[1:], strict=False)]
    pack = zstandard.ZstdCompressor().compress
    return [len(x) for x in levels], pack(b"".join(q.tobytes() for q in quarters)), pack(b"".join(d.astype(np.int32).tobytes() for d in drops))


def block_of(docs: list[tuple[int | None, bytes]], n_docs: int, n_terms: int) -> dict:
    """A row of the index over some documents; those without terms have no column."""
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    number: dict[bytes, int] = {}
    ids, rows, tfs, widths, sizes = [], [], [], [], []
    for doc_id, data in docs:
        counts = Counter(terms_of(data))
        if counts:
            ids.append(doc_id)
            rows.extend([number.setdefault(t, len(number)) for t in counts])
            tfs.extend(counts.values())
            widths.append(len(counts))
            sizes.append(sum(counts.values()))
    if not ids:
        return {"n_docs": 0, "ids": [], "terms": [], "dfs": [], "depth": 0, "sizes": [], "quarters": b"", "drops": b""}
    terms = sorted(number)
    rank = np.empty(len(terms), np.int64)
    rank[[number[t] for t in terms]] = np.arange(len(terms))
    row, tf = rank[np.array(rows)], np.array(tfs, np.int64)
    length = 50 + 50 * np.array(sizes, np.int64) * n_docs // n_terms
    col = np.repeat(np.arange(len(ids)), widths)
    impact = 1_000_000_000 * tf // (1000 * tf + 20 * length[col])
    depth = max(1, int(max(len(terms), len(ids)) - 1).bit_length())
    cells, quarters, drops = tree_of(row, col, impact, depth)
    return {"n_docs": len(ids), "ids": ids, "terms": [t.decode() for t in terms], "dfs": np.bincount(row).tolist(), "depth": depth, "sizes": cells, "quarters": quarters, "drops": drops}


def build_index(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The index of all ``docs(doc_id, text)`` with a term, a row a block; impacts are those of a corpus of this size."""
    from mergetide.llm.phrases import spark_arrow

    arrow = spark_arrow(docs, INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, bytes]] = []
        size = 0
        for b in batches:
            for doc_id, data in zip(b["doc_id"].to_pylist(), b["data"].to_pylist(), strict=True):
                if held and (len(held) == BLOCK_DOCS or size + len(data) > BLOCK_BYTES):
                    yield pa.RecordBatch.from_pylist([block_of(held, n_docs, n_terms)], arrow)
                    held, size = [], 0
                held.append((doc_id, data))
                size += len(data)
        if held:
            yield pa.RecordBatch.from_pylist([block_of(held, n_docs, n_terms)], arrow)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    return rows.mapInArrow(run, INDEX).where("n_docs > 0")


class Treap:
    """A block's quadtree, ready to walk."""

    def __init__(self, depth: int, sizes: list[int], quarters: bytes, drops: bytes) -> None:
        self.depth = depth
        ends = np.cumsum(sizes)
        unpack = zstandard.ZstdDecompressor().decompress  # a block at a time
        flat, mask = np.frombuffer(unpack(drops), np.int32), np.frombuffer(unpack(quarters), np.uint8)
        self.best, self.mask, self.start = [flat[: sizes[0]].astype(np.int64)], [], []
        for level in range(depth):
            m = mask[ends[level] - sizes[level] : ends[level]]
            n = POP[m]
            self.mask.append(m)
            self.start.append(np.cumsum(n) - n)
            self.best.append(np.repeat(self.best[-1], n) - flat[ends[level] : ends[level + 1]])

    def children(self, level: int, cells: np.ndarray, down: np.ndarray, right: int) -> np.ndarray:
        """The cells one level deeper, below or above (``down``, a bit a column) and left or right; -1 where there is none."""
        m = np.where(cells >= 0, self.mask[level][cells], 0)
        quarter = 2 * down + right
        there = (m >> quarter) & 1
        return np.where(there == 1, self.start[level][cells] + BEFORE[m, quarter], -1)

    def top(self, rows: np.ndarray, weights: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
        """``(score, column)`` of the best ``k`` columns with a score above 0 and not below ``least``, equal scores by column."""
        bound = int(weights.sum() * self.best[0][0])
        heap = [(-bound, 0, 0, np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int64), np.array([bound]))]
        turn, found = 0, [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        while heap and -heap[0][0] >= max(1, least):
            _, _, level, cols, cells, bounds = heapq.heappop(heap)
            live = bounds >= max(1, least)
            cols, cells, bounds = cols[live], cells[live], bounds[live]
            if len(cols) > WIDTH:  # the best go on, the others wait
                order = np.argsort(-bounds, kind="stable")
                wait, go = order[WIDTH:], order[:WIDTH]
                turn += 1
                heapq.heappush(heap, (-int(bounds[wait].max()), turn, level, cols[wait], cells[wait], bounds[wait]))
                cols, cells = cols[go], cells[go]
            down = (rows >> (self.depth - 1 - level)) & 1
            both = np.concatenate([self.children(level, cells, down, 0), self.children(level, cells, down, 1)])
            at = np.concatenate([2 * cols, 2 * cols + 1])
            sums = np.where(both >= 0, self.best[level + 1][both], 0) @ weights
            keep = sums >= max(1, least)
            at, both, sums = at[keep], both[keep], sums[keep]
            if not len(at):
                continue
            if level + 1 < self.depth:
                turn += 1
                heapq.heappush(heap, (-int(sums.max()), turn, level + 1, at, both, sums))
                continue
            found = [np.concatenate([found[0], sums]), np.concatenate([found[1], at])]
            order = np.lexsort((found[1], -found[0]))[:k]
            found = [x[order] for x in found]
            if len(order) == k:
                least = max(least, int(found[0][-1]))
        order = np.lexsort((found[1], -found[0]))
        return list(zip(found[0][order].tolist(), found[1][order].tolist(), strict=True))


def search_blocks(index: DataFrame, items: list[tuple[int, list[str], list[int]]], k: int) -> DataFrame:
    """``item, doc_id, score``: the best ``k`` documents of each task for each of ``items`` (number, terms, weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, bool, int]]] = [[] for _ in items]  # (-score, id is null, id)
        for b in batches:
            for r in range(b.num_rows):
                block = {name: b[name][r].as_py() for name in ("ids", "terms", "depth", "sizes", "quarters", "drops")}
                treap = Treap(block["depth"], block["sizes"], block["quarters"], block["drops"])
                row_of = {t: i for i, t in enumerate(block["terms"])}
                for i, (_, terms, weights) in enumerate(items):
                    there = [(row_of[t], w) for t, w in zip(terms, weights, strict=True) if t in row_of]
                    if there:
                        rows, w = (np.array(x, np.int64) for x in zip(*there, strict=True))
                        least = -best[i][-1][0] if len(best[i]) == k else 1
                        new = [(-score, block["ids"][c] is None, block["ids"][c] or 0) for score, c in treap.top(rows, w, k, least)]
                        if new:
                            best[i] = sorted(best[i] + new)[:k]
        rows = [(items[i][0], None if null else doc_id, -minus) for i, found in enumerate(best) for minus, null, doc_id in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], pa.int64()) for j in range(3)], ["item", "doc_id", "score"])

    return index.select("ids", "terms", "depth", "sizes", "quarters", "drops").mapInArrow(run, "item long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of ``docs(doc_id, text)`` with the highest score above 0 for each
    row of ``items(item_id, text)``.

    Scores are whole numbers: weight of a term (by how few documents hold it) times its impact in the document (by how often,
    against the document's length), over the item's distinct terms.  Equal scores rank by ascending ``doc_id``, null last;
    rows with one id rank one by one, and items with one id each have their own ranks.  Null texts have no terms; an item
    without terms that any document holds has no rows.
    """
    spark = docs.sparkSession
    n_docs, n_terms = corpus_size(docs)
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long"
    index = cut(build_index(docs, n_docs, n_terms), "index")
    asked = cut(items.select("item_id", item_terms(F.col("text")).alias("terms")).where(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id()), "items")
    wanted = asked.select(F.explode("terms").alias("term")).distinct()
    postings = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"))
    held = postings.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighted = held.select("term", weight.alias("weight")).where("weight > 0")
    of_item = asked.select("item", F.explode("terms").alias("term")).join(weighted, "term").groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))  # an item's terms
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t["term"]) + 16)
    queries = cut(of_item.withColumn("bytes", size), "queries")
    batches = -(-(queries.agg(F.sum("bytes").alias("n")).first()["n"] or 0) // BATCH_BYTES)
    found = None
    for i in range(batches):  # each batch is of bounded size
        rows = queries.where(F.pmod(F.xxhash64("item"), F.lit(batches)) == i).select("item", "terms").collect()
        part = search_blocks(index, [(r["item"], [t["term"] for t in r["terms"]], [t["weight"] for t in r["terms"]]) for r in rows], k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
