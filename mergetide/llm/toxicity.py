"""Toxicity by a support vector machine over a gapped subsequence string kernel with Nystroem landmarks.

The kernel compares strings by their common subsequences of three letters, each weighted ``DECAY`` for every letter
skipped in between (two at most), so that inserted characters cost little, and counted once in a word at its
tightest; a word's start counts as a letter,
punctuation inside words is passed over, look-alike digits and signs count as letters, and single letters in a row are
read as one word.  Landmarks are the word stems most tied to toxic texts.  A sentence is described by its nearest word
to each landmark (the kernel over the landmark's own, so that endings and compounds cost nothing), scaled between two values
of the landmark's own (:func:`ranges`): 0 up to what the nearest word of clean training texts reaches, 1 from what the
landmark reaches with any one character inserted, so that short words tolerate an insertion as long ones do.  The
responses are mapped by the inverse root of the landmarks' kernel matrix.  The machine (squared hinge) is
trained on labelled sentences: all responding ones of clean texts, and of each toxic text its most toxic one by the
machine of the round before, and the landmarks with a character inserted as toxic ones.  A text scores as its highest sentence, through a logistic curve fitted on the training
texts.

Scoring folds all landmarks into one table of upper bounds by letter triple; only words whose bound reaches the
least value that counts get their kernel values, the others contribute 0 exactly.

Training takes a bounded sample: at most ``train_rows`` toxic and ``3 * train_rows`` other labelled texts, of at most
``TRAIN_CHARS`` characters each, lowest hash of the id first.  Edges: null and empty texts score as a text without
responding words; very long texts are scored whole; rows without a label are not trained on; repeated rows score
alike; with no labels of one kind, or no stem tied to them, every score is the share of toxic labels; other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergetide.llm.tokens import SPACE, slices

DECAY, FLOOR, GAP = 0.8, 0.45, 0.1
LANDMARKS, STEM, SURE = 96, (4, 10), 12.0
TRAIN_CHARS = 20_000
PATTERNS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))  # second and third letter after the first
WEIGHTS = np.array([DECAY ** (b - 2) for _, b in PATTERNS], np.float32)
#: Look-alikes of letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a"}
CODE = np.zeros(256, np.int64)
CODE[97:123] = np.arange(1, 27)
CODE[128:192] = 27 + np.arange(64) % 4  # later bytes of letters beyond ASCII
START = 31  # of a word
for _sign, _letter in LOOKALIKES.items():
    CODE[ord(_sign)] = CODE[ord(_letter)]
SENTENCE_END = np.zeros(256, bool)
SENTENCE_END[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Letters:
    """Letters of consecutive texts: code and word of each; sentence of each word; text of each sentence."""

    code: np.ndarray
    word: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray


def letters_of(texts: pa.Array) -> Letters:
    texts = pc.utf8_lower(texts.fill_null("")).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    cut = offsets - offsets[0]
    inside = ~SPACE[data]
    first = np.ones(len(data), bool)
    first[1:] = ~inside[:-1]
    edge = np.zeros(len(data), bool)
    edge[cut[:-1][cut[:-1] < len(data)]] = True
    first = inside & (first | edge)
    starts = np.flatnonzero(first)
    word = np.cumsum(first) - 1
    at = np.flatnonzero(inside & (CODE[data] > 0))
    word, code = word[at], CODE[data[at]]
    text = np.searchsorted(cut, starts, "right") - 1
    n = np.bincount(word, minlength=len(starts))
    single = n == 1
    merge = np.zeros(len(starts), bool)
    merge[1:] = single[1:] & single[:-1] & (text[1:] == text[:-1])
    number = np.cumsum(~merge) - 1  # single letters in a row become one word
    starts, text = starts[~merge], text[~merge]
    ends = np.append(starts[1:], len(data))
    new = np.zeros(len(data) + 1, bool)
    new[1:] = SENTENCE_END[data]
    new[:-1] |= edge
    sentence = np.cumsum(new)[starts] if len(starts) else np.zeros(0, np.int64)
    word = number[word] if len(word) else word
    head = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else word
    word, code = np.insert(word, head, word[head]), np.insert(code, head, START)
    ids, sentence = np.unique(sentence, return_inverse=True)
    of = np.zeros(len(ids), np.int64)
    of[sentence] = text
    return Letters(code, word, sentence, of, starts, ends, data)


def triples(x: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letter triple, word, weight) of all subsequences, in order of the patterns."""
    out = []
    for (a, b), weight in zip(PATTERNS, WEIGHTS, strict=True):
        if len(x.code) > b:
            ok = x.word[b:] == x.word[:-b]
            t = (x.code[:-b] << 10) | (x.code[a : len(x.code) - b + a] << 5) | x.code[b:]
            out.append((t[ok], x.word[:-b][ok], np.full(int(ok.sum()), weight, np.float32)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))  # type: ignore[return-value]


def word_vectors(words: list[str]) -> np.ndarray:
    """Weights of each word (row) over letter triples; the kernel is their product."""
    x = letters_of(pa.array(["".join(w.split()) for w in words], pa.string()))
    out = np.zeros((len(words), 1 << 15), np.float32)
    t, w, weight = triples(x)
    np.add.at(out, (x.text[x.sentence[w]] if len(w) else w, t), weight)
    return out


@dataclass
class Model:
    vectors: np.ndarray  # letter triple x landmark, over the value below which nothing counts
    top: np.ndarray  # where a response is full, in the same measure
    bound: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def responses(self, x: Letters) -> tuple[np.ndarray, np.ndarray]:
        """(sentences, values by landmark) of the sentences that respond."""
        t, w, weight = triples(x)
        n = len(x.starts)
        upper = np.bincount(w, weight * self.bound[t], n)
        keep = (upper >= 0.999)[w]
        t, w, weight = t[keep], w[keep], weight[keep]
        order = np.lexsort((t, w))
        t, w, weight = t[order], w[order], weight[order]
        if not len(t):
            return np.zeros(0, np.int64), np.zeros((0, self.vectors.shape[1]), np.float32)
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (w[1:] != w[:-1])
        head = np.flatnonzero(new)
        t, w, weight = t[head], w[head], np.maximum.reduceat(weight, head)
        new = np.ones(len(w), bool)
        new[1:] = w[1:] != w[:-1]
        head = np.flatnonzero(new)
        words = w[head]
        values = np.zeros((len(words), self.vectors.shape[1]), np.float32)
        for i in range(0, len(words), 2048):
            a, b = head[i], head[i + 2048] if i + 2048 < len(words) else len(w)
            values[i : i + 2048] = np.add.reduceat(self.vectors[t[a:b]] * weight[a:b, None], head[i : i + 2048] - a)
        values = np.clip((values - 1) / (self.top - 1), 0, 1)
        some = values.any(1)
        words, values = words[some], values[some]
        sentence = x.sentence[words]
        order = np.argsort(sentence, kind="stable")
        ids, head = np.unique(sentence[order], return_index=True)
        return ids, np.maximum.reduceat(values[order], head) if len(ids) else values

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Between 0 and 1 for each text."""
        best = np.full(len(texts), self.bias)
        x = letters_of(texts)
        ids, values = self.responses(x)
        np.maximum.at(best, x.text[ids], values @ self.weights + self.bias)
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.offset, -30, 30)))


def support_vectors(x: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float) -> np.ndarray:
    """Weights (bias last) of the squared-hinge machine, by Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w, inside = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for _ in range(50):
        a = x[inside] * c[inside, None]
        w = np.linalg.solve(a.T @ x[inside] + np.diag(penalty), a.T @ y[inside])
        now = y * (x @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w


def logistic(s: np.ndarray, y: np.ndarray, c: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve from scores to shares, with targets drawn in a little from 0 and 1."""
    n1, n0 = y.sum(), (~y).sum()
    target = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, b = np.stack([s, np.ones_like(s)], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (c * (target - p)))
        b = b + np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def copies_of(texts: list[str]) -> list[int]:
    """A group number for each text; texts that share a sentence of eight words are one group."""
    group = list(range(len(texts)))

    def top(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    first: dict[tuple[str, ...], int] = {}
    for i, text in enumerate(texts):
        for part in text.replace("!", ".").replace("?", ".").replace("\n", ".").split("."):
            words = tuple(part.split())
            if len(words) >= 8:
                group[top(i)] = top(first.setdefault(words, i))
    return [top(i) for i in range(len(texts))]


def landmarks_of(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Word stems most tied to toxic texts; copies of a text count once, and no stem starts with another."""
    groups: dict[tuple[int, bool], set[str]] = {}
    for text, y, g in zip(texts, toxic.tolist(), copies_of(texts), strict=True):
        groups.setdefault((g, y), set()).update(w for w in ("".join(c for c in w if c.isalpha()) for w in text.lower().split()) if len(w) >= STEM[0])
    n1, n0 = (max(1, sum(y == z for _, y in groups)) for z in (True, False))
    share = n1 / (n1 + n0)

    def sure(w: str) -> float:
        """Log odds against such a surplus of toxic texts among those with ``w`` by chance."""
        k1, k0 = seen[1][w], seen[0].get(w, 0)
        q = k1 / (k1 + k0)
        return (k1 * np.log(q / share) + (k0 * np.log((1 - q) / (1 - share)) if k0 else 0.0)) if q > share else 0.0

    least = max(3, SURE / np.log(1 / share))  # toxic texts that a stem needs; one that is longer has no more of them
    seen: tuple[dict[str, int], dict[str, int]] = ({}, {})
    longer: set[str] | None = None
    for n in range(STEM[0], STEM[1] + 1):
        now: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for want in (True, False):
            for (_, y), words in groups.items():
                if y == want:
                    stems = {w[:n] for w in words if len(w) >= n and (longer is None or w[: n - 1] in longer)}
                    now[y].update(stems if want else stems & now[1].keys())
            if want:
                for w in [w for w, k in now[1].items() if k < least]:
                    del now[1][w]
        longer = set(now[1])
        seen[0].update(now[0])
        seen[1].update(now[1])

    found: list[str] = []
    for w in sorted((w for w in seen[1] if sure(w) >= SURE), key=lambda w: (-sure(w), -len(w), w)):
        if not any(w.startswith(x) or x.startswith(w) for x in found):
            found.append(w)
    return found[:LANDMARKS]


def spoiled_forms(word: str) -> list[str]:
    """The word with one character inserted anywhere inside."""
    return [word[:i] + c + word[i:] for i in range(1, len(word)) for c in "xe"]


def ranges(words: list[str], vectors: np.ndarray, clean: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each landmark the kernel value (over its own) up to which nothing counts, and that from which a response is full.

    ``clean`` are words of clean texts; those that hold a landmark say nothing about it.
    """
    least = np.array([float((word_vectors(spoiled_forms(w)) @ v).min()) for w, v in zip(words, vectors, strict=True)])
    near = np.zeros(len(words))
    for i in range(0, len(clean), 512):  # some words at a time: each is a row over all letter triples
        part = clean[i : i + 512]
        values = word_vectors(part) @ vectors.T
        own = np.array([[w in x for w in words] for x in part])
        near = np.maximum(near, np.where(own, 0, values).max(0))
    low = np.clip(near + 0.01, FLOOR, 0.9)
    return low, np.minimum(1.0, np.maximum(least, low + GAP))


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray, rounds: int = 3) -> Model | float:
    """The model, or the share of toxic texts where there is nothing to tell apart."""
    share = float(np.average(toxic, weights=weight)) if len(texts) else 0.0
    words = landmarks_of(texts, toxic) if 0 < toxic.sum() < len(texts) else []
    if not words:
        return share
    vectors = word_vectors(words)
    own = (vectors * vectors).sum(1)
    gram = (vectors @ vectors.T / np.sqrt(np.outer(own, own))).astype(float)
    vectors = vectors / own[:, None]
    low, turn = np.linalg.eigh(gram)
    root = turn @ np.diag(np.where(low > 1e-3, 1 / np.sqrt(np.maximum(low, 1e-3)), 0)) @ turn.T
    letters = lambda w: "".join(c for c in w if c.isalpha())
    clean = sorted({letters(w) for t, y in zip(texts, toxic.tolist(), strict=True) if not y for w in t.lower().split()} - {""})
    low, top = ranges(words, vectors, clean)
    vectors = vectors / low[:, None]
    model = Model(np.ascontiguousarray(vectors.T), (top / low).astype(np.float32), vectors.max(0), np.zeros(len(words)), 0.0, 1.0, 0.0)
    found = []
    for i in range(0, len(texts), 64):  # some texts at a time: the driver holds responding sentences only
        x = letters_of(pa.array(texts[i : i + 64], pa.string()))
        ids, values = model.responses(x)
        found.append((values, x.text[ids] + i))
    values, owner = (np.concatenate(c) for c in zip(*found, strict=True))
    mapped = values @ root
    rank = values.sum(1)
    spoiled = [x for w in words for x in spoiled_forms(w)]
    _, more = model.responses(letters_of(pa.array(spoiled, pa.string())))
    more = more @ root
    extra = np.full(len(more), 0.1 * float(weight[toxic].sum()) / max(1, len(more)))
    for _ in range(rounds):
        best = np.full(len(texts), -1)
        for i in np.argsort(rank, kind="stable"):
            best[owner[i]] = i
        chosen = ~toxic[owner] | (best[owner] == np.arange(len(owner)))
        none = np.flatnonzero(best < 0)  # texts without a responding sentence
        rows = np.vstack([mapped[chosen], np.zeros((len(none), len(words))), more])
        y = np.where(np.concatenate([toxic[owner[chosen]], toxic[none], np.ones(len(more), bool)]), 1.0, -1.0)
        w = support_vectors(rows, y, np.concatenate([weight[owner[chosen]], weight[none], extra]), 0.05)
        rank = mapped @ w[:-1]
    model.weights, model.bias = root @ w[:-1], float(w[-1])
    top = np.full(len(texts), model.bias)
    np.maximum.at(top, owner, rank + model.bias)
    model.slope, model.offset = logistic(top, toxic, weight)
    return model


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 600) -> Model | float:
    """Fit on ``labels(doc_id, toxic)`` and their texts."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pick = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = pick(1, train_rows).unionByName(pick(0, 3 * train_rows))
    # at most 4 * train_rows ids and labels; of an id with several texts the least one
    texts = docs.select("doc_id", "text").where(F.length("text") <= TRAIN_CHARS).join(F.broadcast(sample), "doc_id")
    rows = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).limit(4 * train_rows).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    toxic = np.array([r["toxic"] == 1 for r in rows], bool)
    share = {y: total.get(y, 0) / max(1, int((toxic == bool(y)).sum())) for y in (0, 1)}
    weight = np.where(toxic, share[1], share[0]) / max(1e-9, np.mean(list(share.values())))
    return fit([r["text"] for r in rows], toxic, weight)


def score_texts(docs: DataFrame, model: Model | float, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score column in place of its text."""
    others = [c for c in docs.columns if c not in (text_col, score_col)]
    d = docs.select(*others, F.col(text_col).alias("text"))
    schema = d.select(*others, F.lit(0.0).alias(score_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s = model.scores(b["text"]) if isinstance(model, Model) else np.full(b.num_rows, model)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in others), pa.array(s, pa.float64())], [*others, score_col])

    return d.mapInArrow(run, schema)


HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_rows: int = 600) -> DataFrame:
    """The rows of ``docs`` (with a column ``text``) that score below ``threshold``."""
    model = train(docs, labels.where(f"not ({HELD_OUT})"), train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s = model.scores(b["text"]) if isinstance(model, Model) else np.full(b.num_rows, model)
            yield b.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_rows: int = 600) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row; labels of held-out rows (crc32 of the id modulo 4 is 2) are not used."""
    held_out = F.coalesce(F.expr(HELD_OUT), F.lit(False))
    model = train(docs, labels.where(~held_out), train_rows)
    scored = score_texts(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
