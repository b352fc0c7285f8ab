"""Fingerprints of documents by the phrases of a Lempel-Ziv parse.

A text's UTF-8 bytes are cut into phrases, each the shortest piece that is not a phrase yet (a phrase at the end that is
one already adds nothing).  The set of phrase hashes is sketched by minima of 128 affine maps, a byte a minimum; two sketches
agree in about as many lanes as the sets have in common, so that texts that compress well together are alike.

Documents lie in ranges of their ids, sorted, so that a document's successor follows it in its task; only one document a
range meets its successor in a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergetide.llm.tokens import mix
from mergetide.sources.shared import cut

LANES = 128
CHUNK = 1024
MASK = (1 << 64) - 1
FACTOR = 0x9E3779B97F4A7C15
TIMES = mix(np.arange(1, LANES + 1, dtype=np.uint64)) | np.uint64(1)
PLUS = mix(np.arange(LANES + 1, 2 * LANES + 1, dtype=np.uint64))
#: chance that two unlike minima have one byte
CLASH = 1 / 256


class Parse:
    """Phrases of a text that grows: ``known`` maps (phrase, byte) to a longer phrase, ``hashes`` has one for each phrase."""

    def __init__(self) -> None:
        self.known: dict[int, int] = {}
        self.hashes = [0]  # the empty phrase
        self.at = 0

    def read(self, data: bytes) -> list[int]:
        """Hashes of the phrases that ``data`` adds."""
        known, hashes, at, before = self.known, self.hashes, self.at, len(self.hashes)
        get = known.get
        for byte in data:
            key = at << 8 | byte
            longer = get(key)
            if longer is None:
                known[key] = len(hashes)
                hashes.append(((hashes[at] ^ (byte + 1)) * FACTOR + 1) & MASK)
                at = 0
            else:
                at = longer
        self.at = at
        return hashes[before:]

    def back(self, added: int, at: int) -> None:
        """Forgets the last ``added`` phrases; ``at`` is the phrase that was open before them."""
        for _ in range(added):
            self.known.popitem()
        if added:
            del self.hashes[-added:]
        self.at = at


def minima(hashes: list[int]) -> np.ndarray:
    out = np.full(LANES, MASK, np.uint64)
    x = mix(np.array(hashes, np.uint64))
    for i in range(0, len(x), CHUNK):
        np.minimum(out, (x[i : i + CHUNK, None] * TIMES + PLUS).min(axis=0), out=out)
    return out


def written(lanes: np.ndarray, phrases: int) -> str:
    """A byte a lane in hexadecimal; empty where there is no phrase."""
    return (mix(lanes) & np.uint64(255)).astype(np.uint8).tobytes().hex() if phrases else ""


def fingerprint(text: str) -> str:
    found = Parse().read(text.encode())
    return written(minima(found), len(found))


def likeness(a: str, b: str) -> float:
    """Share of phrases in common by two fingerprints, 0 to 1; that of two empty texts is 1."""
    if not a or not b:
        return float(a == b)
    same = float(np.mean(np.frombuffer(bytes.fromhex(a), np.uint8) == np.frombuffer(bytes.fromhex(b), np.uint8)))
    return max(0.0, (same - CLASH) / (1 - CLASH))


def likeness_of(a: Column, b: Column) -> Column:
    """The same between two columns."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    lane = lambda c, i: F.substring(c, 2 * i + 1, F.lit(2))
    same = F.aggregate(F.sequence(F.lit(0), F.lit(LANES - 1)), F.lit(0), lambda n, i: n + (lane(a, i) == lane(b, i)).cast("int")) / LANES
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(F.greatest(F.lit(0.0), (same - CLASH) / (1 - CLASH)))


class Document:
    """A text, its fingerprint, and the parse of what an edit leaves of it."""

    def __init__(self, doc_id, text: str) -> None:
        self.doc_id, self.text = doc_id, text
        self.edited = len(text) // 4
        kept = text[: len(text) - self.edited]
        self.parse = Parse()
        self.phrases = self.parse.read(kept.encode())
        self.lanes = minima(self.phrases)
        self.fingerprint = self.with_end(text[len(kept) :])

    def with_end(self, end: str) -> str:
        """Fingerprint of the kept part and ``end``."""
        at = self.parse.at
        new = self.parse.read(end.encode())
        self.parse.back(len(new), at)
        return written(np.minimum(self.lanes, minima(new)), len(self.phrases) + len(new))

    def row(self, text: str, fingerprint: str) -> dict:
        """What the query tells of a document whose successor has this text and fingerprint."""
        end = text[: self.edited]
        edited = self.text[: len(self.text) - self.edited] + end
        found = self.with_end(end)
        return {
            "doc_id": self.doc_id, "n_chars": len(self.text), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "fingerprint": self.fingerprint,
            "edited_fingerprint": found, "near_edited": likeness(self.fingerprint, found), "near_next": likeness(self.fingerprint, fingerprint),
        }


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def phrase_fingerprints(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how near the edited text and the next document are.

    The edited text has its last quarter (of code points, rounded down) replaced by as many of the next document's first, or
    all of them.  Documents follow each other by ascending ``doc_id`` (null first; those of one id by their texts), after the
    last comes the first.  Null texts are empty; an empty text has an empty fingerprint, which is like an empty one only.
    Rows: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, one a row of ``docs``;
    other columns of ``docs`` are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = [F.col("doc_id"), F.xxhash64("text")]
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(*key).sortWithinPartitions(*key, "text")
    schema = f"place int, part int, doc_id {kind}, text string, {COLUMNS}"
    arrow = spark_arrow(docs, schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows at place 0 are whole; place 1 is the range's first document, place 2 its last."""
        part, last = TaskContext.get().partitionId(), None
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                doc = Document(doc_id, text)
                if last is None:
                    rows.append({"place": 1, "part": part, "doc_id": doc_id, "text": text, "fingerprint": doc.fingerprint})
                else:
                    rows.append({"place": 0, "part": part} | last.row(text, doc.fingerprint))
                last = doc
            yield pa.RecordBatch.from_pylist(rows, arrow)
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"place": 2, "part": part, "doc_id": last.doc_id, "text": last.text}], arrow)

    found = cut(placed.mapInArrow(walk, schema), "phrases")
    parts = found.where("place = 1").select("part")  # one row a range that has documents
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    follows = parts.select("part", F.lead("part").over(order).alias("to"), F.min("part").over(Window.partitionBy(F.lit(0))).alias("first"))
    heads = found.where("place = 1").select(F.col("part").alias("to"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    ends = found.where("place = 2").select("part", "doc_id", "text").join(follows.select("part", F.coalesce("to", "first").alias("to")), "part").join(heads, "to")
    out = spark_arrow(docs, f"doc_id {kind}, {COLUMNS}")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_pylist([Document(r["doc_id"], r["text"]).row(r["next_text"], r["next_fingerprint"])], out)

    names = ["doc_id", *[c.split()[0] for c in COLUMNS.split(", ")]]
    closed = ends.select("doc_id", "text", "next_text", "next_fingerprint").mapInArrow(close, f"doc_id {kind}, {COLUMNS}")
    return found.where("place = 0").select(*names).unionByName(closed)


def spark_arrow(df: DataFrame, schema: str) -> pa.Schema:
    """The Arrow schema of a Spark one."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
