"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nystroem landmarks.

Kernel: two words are as alike as the triples of letters that they hold in the same order, each weighted by
DECAY to the power of the letters it stretches over, up to SPAN. Letters put between those of an insult
lengthen the stretch but leave the triples, so spaced, dotted or doctored insults stay close to the plain ones.
Signs and digits stand for no letter: they only stretch.

Units: a text's words; words over WIDTH letters are several overlapping units, a row of single letters ("i d i o t")
is one more unit. A sentence scores as its highest unit, a text as its highest sentence.

Training, on a bounded sample of labelled texts (TRAIN_ROWS by label, those with the smallest hashes of
their ids): sentences carry no labels of their own, so the units of toxic texts that stand out by their counts are
the first positives, units of other texts the negatives; after a fit, the highest unit of each toxic text joins the
positives, the highest units of other texts join the negatives, and the fit is repeated. Landmarks are units of both kinds; with K the landmarks' kernel matrix, a unit
x has the features K^(-1/2) k(x), and a linear SVM (squared hinge) is fitted on them. As the kernel is an inner
product, the machine folds into one weight for each letter triple, which is all that scoring needs. The margin
becomes a probability by Platt's logistic fit, weighted to the labels' true shares.

Defined results: null and empty texts get the score of a text without units, the lowest one; rows with equal ids
are scored row by row; labels that are null or without a text are left out, texts labelled both ways count as
toxic; with no labelled text of one kind every text scores that label's share; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Labelled texts of each kind that are read for training, at most.
TRAIN_ROWS = {0: 4000, 1: 2000}
#: Landmarks, and units trained on of each kind, at most.
LANDMARKS, UNITS = 240, 6000
#: Fits, and the highest units of a text without toxicity that join the negatives after each but the last.
ROUNDS, HARDEST = 4, 5
DECAY, SPAN, WIDTH = 0.6, 6, 24
LETTERS = 32
#: The end of the code points that hold letters; what comes after are marks and private use.
LAST_LETTER = 0x33480
SINGLES = re.compile(r"(?<!\S)(?:\S[\s]){3,}\S(?!\S)")
SENTENCES = re.compile(r"[.!?\n]+")
#: Scores of words that a task remembers; the table is emptied when it is full, which costs time only.
REMEMBERED = 150_000


def _letter_table() -> np.ndarray:
    """Code point to letter class: a-z are 1-26, accents and widths fall away, other letters share 27-31, the rest is 0."""
    table = np.zeros(LAST_LETTER, np.uint8)
    for point in range(len(table)):
        base = unicodedata.normalize("NFKD", chr(point).lower())[:1]
        if "a" <= base <= "z":
            table[point] = ord(base) - 96
        elif base and unicodedata.category(base)[0] == "L":
            table[point] = 27 + ord(base) % 5
    return table


_TABLE = _letter_table()


def units(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters of each unit in WIDTH columns, index of its word). A long word is several units that overlap by half."""
    pieces, owner = [], []
    for i, word in enumerate(words):
        for at in range(0, max(1, len(word) - WIDTH // 2), WIDTH // 2) if len(word) > WIDTH else (0,):
            pieces.append(word[at : at + WIDTH])
            owner.append(i)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], 0).astype(np.uint8)
    rows = np.zeros((len(pieces), WIDTH), np.uint8)
    col = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    rows[np.repeat(np.arange(len(pieces)), lengths), col] = letters
    return rows, np.array(owner, np.int64)


def triples(rows: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """(index of the letter triple of each unit, weight) for each place of a triple; index 0 where a letter is missing."""
    wide = rows.astype(np.int32)
    for i in range(WIDTH - 2):
        if not wide[:, i].any():
            continue
        for k in range(i + 2, min(i + SPAN, WIDTH)):
            if not wide[:, k].any():
                continue
            ends = wide[:, i] * LETTERS * LETTERS + wide[:, k]
            for j in range(i + 1, k):
                whole = (wide[:, i] > 0) & (wide[:, j] > 0) & (wide[:, k] > 0)
                yield np.where(whole, ends + wide[:, j] * LETTERS, 0), DECAY ** (k - i + 1)


def features(rows: np.ndarray) -> np.ndarray:
    """Units as unit vectors over letter triples."""
    out = np.zeros((len(rows), LETTERS**3), np.float32)
    at, norm = np.arange(len(rows)), np.zeros(len(rows))
    for index, weight in triples(rows):
        out[at, index] += weight
        norm += weight**2 * (index > 0)
    out[:, 0] = 0
    return out / np.sqrt(np.maximum(norm, 1e-12))[:, None].astype(np.float32)


def products(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The inner products of units with columns of weights over letter triples, without building the units' vectors."""
    total = np.zeros((len(rows), *weights.shape[1:]), np.float64)
    norm = np.zeros(len(rows))
    for index, weight in triples(rows):
        total += weight * weights[index]
        norm += weight**2 * (index > 0)
    norm = np.sqrt(np.maximum(norm, 1e-12))
    return total / (norm[:, None] if weights.ndim > 1 else norm)


@dataclass
class Model:
    """Weights by letter triple (index 0 is none), bias, the logistic fit, and the constant that replaces them if training saw one label only."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    constant: float | None = None

    def margins(self, words: list[str]) -> list[float]:
        """The highest unit's margin of each word."""
        found: list[float] = []
        for low in range(0, len(words), 4096):
            part = words[low : low + 4096]
            rows, owner = units(part)
            best = np.full(len(part), -np.inf)
            np.maximum.at(best, owner, products(rows, self.weights) + self.bias)
            found += best.tolist()
        return found

    def probability(self, margin: float) -> float:
        if self.constant is not None:
            return self.constant
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60))))


def words_of(text: str) -> list[str]:
    """A text's words, and its rows of single letters as one word each."""
    text = text.lower()
    return text.split() + ["".join(m.group().split()) for m in SINGLES.finditer(text)]


class Scorer:
    """Scores texts, remembering words."""

    def __init__(self, model: Model):
        self.model, self.known = model, {"": model.bias}

    def margin(self, texts: list[str]) -> list[float]:
        parts = [words_of(t) for t in texts]
        new = set().union(*parts).difference(self.known)
        if len(new) + len(self.known) > REMEMBERED:
            self.known = {"": self.model.bias}
            new = set().union(*parts) - {""}
        fresh = list(new)
        self.known.update(zip(fresh, self.model.margins(fresh), strict=True))
        look = self.known.__getitem__
        return [max(map(look, p), default=self.model.bias) for p in parts]

    def sentences(self, text: str) -> list[tuple[str, float]]:
        """Each sentence of a text with its margin."""
        parts = [s.strip() for s in SENTENCES.split(text)]
        return list(zip(parts, self.margin(parts), strict=True))


def _hinge_fit(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM with squared hinge loss, by Newton steps; y is 1 or -1, c a weight for each row."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        short = np.maximum(0, 1 - y * (x @ w))
        on = short > 0
        gradient = ridge @ w - 2 * x[on].T @ (c[on] * y[on] * short[on])
        step = np.linalg.solve(ridge + 2 * (x[on] * c[on, None]).T @ x[on], gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _logistic_fit(m: np.ndarray, t: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    a = b = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -60, 60)))
        g = np.array([(weight * (p - t) * m).sum() + 1e-3 * a, (weight * (p - t)).sum()])
        d = weight * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(d * m * m).sum() + 1e-3, (d * m).sum()], [(d * m).sum(), d.sum()]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def distinct_texts(ids: list[np.ndarray], names: list[str], bands: int = 10, width: int = 4, least: int = 7, alike: float = 0.5) -> list[int]:
    """One text of each family of copies, exact or near: texts (sorted arrays of word ids) that share `alike` of their words. Pairs are sought
    among texts that agree on all smallest hashes of their long words in any of some bands; each text is held against the family's first."""
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    hashes = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) + 1 for w in names), np.uint64, len(names))
    long = np.fromiter((len(w) >= least for w in names), bool, len(names))
    salts = np.random.default_rng(11).integers(1, 1 << 62, width * bands, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    seen: dict[tuple[int, bytes], int] = {}
    for i, words in enumerate(ids):
        some = words[long[words]]
        h = hashes[some if len(some) else words]
        least_of = ((h[:, None] * salts) >> np.uint64(20)).min(axis=0) if len(h) else np.zeros(width * bands, np.uint64)
        for b in range(bands):
            j = seen.setdefault((b, least_of[width * b : width * (b + 1)].tobytes()), i)
            low, high = sorted((root(i), root(j)))
            if low != high:
                both = len(np.intersect1d(words, ids[j], assume_unique=True))
                if both >= alike * (len(words) + len(ids[j]) - both):
                    parent[high] = low
    return [i for i in range(len(ids)) if root(i) == i]


def train(texts: list[str], toxic: list[int], share: float, landmarks: int = LANDMARKS, most: int = UNITS, seed: int = 7) -> Model:
    """A model from whole texts and their labels; share is the share of toxic texts among all labelled ones."""
    blank = np.zeros(LETTERS**3)
    if not 0 < sum(toxic) < len(toxic):
        return Model(blank, 0.0, 0.0, 0.0, float(share))
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    ids = []
    for text in texts:
        words = words_of(text)
        ids.append(np.unique(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words))))
    names = list(vocabulary)
    del vocabulary
    # A family of copies says as much as one text: counted apart, all its words would stand out together.
    one = distinct_texts(ids, names)
    if 0 < sum(toxic[i] for i in one) < len(one):
        toxic, ids = [toxic[i] for i in one], [ids[i] for i in one]
    n_toxic, n_other = sum(toxic), len(toxic) - sum(toxic)
    count = lambda y: np.bincount(np.concatenate([x for x, t in zip(ids, toxic, strict=True) if bool(t) == y]), minlength=len(names))
    in_toxic, in_other = count(True), count(False)
    prior = n_toxic / len(toxic)
    # How unlikely is it that chance puts a word's texts on the toxic side: a G test against the number of words tried.
    tried = np.flatnonzero((in_toxic >= 3) & (in_toxic > in_other) & np.fromiter((len(w) > 2 for w in names), bool, len(names)))
    n, m = in_toxic[tried], in_other[tried]
    g = 2 * (n * np.log(n / ((n + m) * prior)) + m * np.log(np.maximum(m, 1) / ((n + m) * (1 - prior))))
    strong = tried[(n > 4 * m) & (g > 2 * np.log(1 + len(tried)) + 6)]
    positive = dict.fromkeys(sorted(strong.tolist(), key=lambda w: (-in_toxic[w], names[w]))[: most // 2])
    others = sorted(np.flatnonzero(in_other).tolist(), key=lambda w: (-in_other[w], names[w]))
    rest = others[most // 4 :]
    negative = dict.fromkeys(others[: most // 4] + [rest[i] for i in sorted(rng.permutation(len(rest))[: most - most // 4])])
    model, margin = Model(blank, 0.0, 1.0, 0.0), np.zeros(len(names))
    for turn in range(ROUNDS):
        if not positive:
            break
        pos, neg = list(positive), [w for w in negative if w not in positive]
        marks = pos[: landmarks // 2] + neg[:: max(1, len(neg) // (landmarks // 2))][: landmarks // 2]
        first = lambda words: (lambda rows, owner: rows[np.unique(owner, return_index=True)[1]])(*units([names[w] for w in words]))
        base = features(first(marks)).T.astype(np.float64)
        values, vectors = np.linalg.eigh(base.T @ base)
        keep = values > 1e-6
        root = vectors[:, keep] / np.sqrt(values[keep])
        rows = first(pos + neg)
        k = np.vstack([products(rows[low : low + 1000], base) for low in range(0, len(rows), 1000)])
        y = np.concatenate([np.ones(len(pos)), -np.ones(len(neg))])
        w, bias = _hinge_fit(k @ root, y, np.where(y > 0, 100.0, 10.0))
        weights = base @ (root @ w)
        weights[0] = 0
        model = Model(weights, bias, 1.0, 0.0)
        margin = np.array(model.margins(names))
        for words, label in zip(ids, toxic, strict=True) if turn < ROUNDS - 1 else ():
            hardest = words[np.argsort(-margin[words], kind="stable")[:HARDEST]].tolist()
            if not label:
                negative.update(dict.fromkeys(v for v in hardest if margin[v] > -0.5))
            elif hardest and margin[hardest[0]] > 0 and not in_other[hardest[0]] and in_toxic[hardest[0]] > 1:
                positive.setdefault(hardest[0])
    of_text = np.array([margin[x].max(initial=-np.inf) if len(x) else model.bias for x in ids])
    label = np.array(toxic, float)
    target = np.where(label > 0, (n_toxic + 1) / (n_toxic + 2), 1 / (n_other + 2))
    model.slope, model.shift = _logistic_fit(of_text, target, np.where(label > 0, share / n_toxic, (1 - share) / n_other) * len(ids))
    return model


def train_from(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: dict[int, int] = TRAIN_ROWS) -> Model:
    """A model from the labelled rows that `usable` (a condition on labels) allows, at most rows[y] of label y.

    The bounded sample is trained on in one task; the driver gets the finished model only.
    """
    known = labels.where(usable) if usable is not None else labels
    known = known.select(F.col(id_col).alias("l_id"), F.col(label_col).alias("y")).where("l_id is not null and y is not null")
    known = known.groupBy("l_id").agg(F.max((F.col("y") > 0).cast("int")).alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64(F.col("l_id").cast("string")), "l_id").limit(rows[y]) for y in (0, 1)]
    picked = parts[0].unionByName(parts[1])
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    texts = read.join(F.broadcast(picked), F.col("id") == F.col("l_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((str(i), t, y) for b in batches for i, t, y in zip(*(c.to_pylist() for c in b.columns), strict=True))
        model = train([f[1] for f in found], [f[2] for f in found], share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)])], names=["model"])

    sample = texts.select("l_id", "text", "y").repartition(1)
    trained = sample.mapInArrow(run, "model binary").first()
    return pickle.loads(trained["model"]) if trained else train([], [], share)


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score_") -> DataFrame:
    """docs with one more column, `name` (one of that name is replaced)."""
    docs = docs.drop(name)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = []
            for low in range(0, batch.num_rows, 64):
                texts = [t or "" for t in batch.column(at).slice(low, 64).to_pylist()]
                found += [model.probability(m) for m in scorer.margin(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score of each row of docs."""
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text_"))
    return scored(read, model, "text_").select("id", F.col("score_").alias("score"))
