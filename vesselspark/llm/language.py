"""Language of words and documents by a linear-chain conditional random field.

Words are runs of letters, lower-cased. A word's features are its first and last
one to three letters, the two- and three-letter grams of the word between marks,
and, if it is in the lexicon (at least ``LEXICON`` times in the sample), the word
itself. A chain of at most ``CHAIN`` consecutive words of a document is labelled by
forward-backward with learned feature weights, start weights and transitions, so
that a word takes its neighbours into account and text may switch language within
a document. A document's language is the one with the largest mean of its words'
marginals; the score is that mean.

The field is fitted on a sample of at most ``SAMPLE`` documents of each language,
the smallest by hash of those with letters, with every word of a document labelled
by its ``lang``. Of each it takes ``SAMPLE_CHARS / SAMPLE`` characters from the first
letter on, so that no language holds more than ``SAMPLE_CHARS`` and a long text takes
no room from others (both bounds are parameters). Predictions cover all texts whole. A null text and one
without letters get ``und`` with score 0; so does every text if nothing can be
learned. Rows are judged one by one; ties go to the smaller language name.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vesselspark.llm.batches import with_columns
from vesselspark.llm.catalog import query, table

SAMPLE = 200
#: Characters of the sample for each language at most: a bound of the driver's memory.
SAMPLE_CHARS = 1_000_000
LEXICON = 5
LEAST = 3
CHAIN = 32
ROUNDS = 40
#: Words whose weights a task remembers.
WORDS = 300_000
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    found = WORD.findall(text.lower())
    return found if text.isascii() else [w for w in found if w.isascii() or any(map(str.isalpha, w))]


def features(word: str) -> list[str]:
    w = f"^{word}$"
    n = len(word)
    out = [f"w{word}"]
    for k in (1, 2, 3):
        if n >= k:
            out += (f"p{word[:k]}", f"s{word[n - k:]}")
    out += [w[i:i + 2] for i in range(n + 1)]
    out += [w[i:i + 3] for i in range(n)]
    return out


def lanes(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each chain of documents laid end to end, and the document of each."""
    starts, sizes, owner, at = [], [], [], 0
    for d, n in enumerate(counts):
        for s in range(0, n, CHAIN):
            starts.append(at + s)
            sizes.append(min(CHAIN, n - s))
            owner.append(d)
        at += n
    return np.array(starts, np.int64), np.array(sizes, np.int64), np.array(owner, np.int64)


def forward_backward(x: np.ndarray, sizes: np.ndarray, first: np.ndarray, step: np.ndarray):
    """Marginals of chains (chain, position, label) from potentials, and the expected transitions.

    Positions beyond a chain's size hold no meaning.
    """
    n, t, k = x.shape
    alpha, beta = np.empty_like(x), np.ones_like(x)
    a = first * x[:, 0]
    alpha[:, 0] = a / a.sum(1, keepdims=True)
    for i in range(1, t):
        a = (alpha[:, i - 1] @ step) * x[:, i]
        alpha[:, i] = a / a.sum(1, keepdims=True)
    moves = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        y = x[:, i + 1] * beta[:, i + 1]
        inside = sizes > i + 1
        b = y @ step.T
        beta[:, i] = np.where(inside[:, None], b / b.sum(1, keepdims=True), 1.0)
        both = alpha[:, i, :, None] * step * y[:, None, :]
        both /= both.sum((1, 2), keepdims=True)
        moves += both[inside].sum(0)
    p = alpha * beta
    p /= p.sum(2, keepdims=True)
    return p, moves


def fit(texts: list[str | None], langs: list[str], rounds: int = ROUNDS, rate: float = 0.15, decay: float = 1e-4) -> dict:
    """Weights of features, start and transitions by Adam on the conditional likelihood."""
    labels = sorted(set(langs))
    known: dict[str, int] = {}
    flat, counts = array("q"), []
    for text in texts:
        words = words_of(text)
        flat.extend([known.setdefault(w, len(known)) for w in words])
        counts.append(len(words))
    ids = np.array(flat, np.int64)
    if not labels or not len(ids):
        return {"labels": [], "features": {}, "weights": np.zeros((0, 0)), "first": np.zeros(0), "step": np.zeros((0, 0))}
    # Features are made twice rather than held: the driver keeps their numbers only.
    total: dict[str, int] = {}
    for w, c in zip(known, np.bincount(ids).tolist()):
        for f in features(w):
            total[f] = total.get(f, 0) + c
    index: dict[str, int] = {}
    rows, cols = array("q"), array("q")
    for i, w in enumerate(known):
        for f in features(w):
            if total[f] >= (LEXICON if f[0] == "w" and len(f) > 3 else LEAST):
                rows.append(i)
                cols.append(index.setdefault(f, len(index)))
    rows, cols = np.array(rows, np.int64), np.array(cols, np.int64)
    del total, flat
    starts, sizes, owner = lanes(counts)
    gold = np.array([labels.index(x) for x in langs])[owner]
    grid = np.minimum(starts[:, None] + np.arange(CHAIN), len(ids) - 1)
    mask = np.arange(CHAIN) < sizes[:, None]
    at = ids[grid]
    k, u, n_tokens = len(labels), len(known), len(ids)
    truth = np.zeros((len(starts), CHAIN, k))
    truth[np.arange(len(starts)), :, gold] = 1.0
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (gold, gold), np.maximum(sizes - 1, 0))
    theta = [np.zeros((len(index), k)), np.zeros(k), np.zeros((k, k))]
    m = [np.zeros_like(x) for x in theta]
    v = [np.zeros_like(x) for x in theta]
    spread = lambda values, group, size: np.stack([np.bincount(group, values[:, j], minlength=size) for j in range(k)], 1)
    for t in range(1, rounds + 1):
        emit = spread(theta[0][cols], rows, u)
        x = np.exp(emit - emit.max(1, keepdims=True))[at]
        p, moves = forward_backward(x, sizes, np.exp(theta[1]), np.exp(theta[2]))
        off = np.where(mask[:, :, None], p - truth, 0.0)
        by_word = spread(off.reshape(-1, k), at.reshape(-1), u)
        grads = [
            spread(by_word[rows], cols, len(index)) / n_tokens + decay * theta[0],
            off[:, 0].sum(0) / n_tokens + decay * theta[1],
            (moves - gold_moves) / n_tokens + 0.02 * theta[2],
        ]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            theta[i] = theta[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    return {"labels": labels, "features": index, "weights": theta[0], "first": np.exp(theta[1]), "step": np.exp(theta[2])}


class Labeller:
    """A fitted field in a task; remembers the potentials of words that it has met."""

    def __init__(self, model: dict):
        self.model = model
        self.labels = model["labels"]
        self.known: dict[str, int] = {}
        self.potential = np.zeros((1024, max(1, len(self.labels))), np.float32)

    def learn(self, words: list[str]) -> None:
        index, weights = self.model["features"], self.model["weights"]
        if len(self.known) + len(words) > WORDS:
            self.known = {}
        have = len(self.known)
        while len(self.potential) < have + len(words):
            self.potential = np.concatenate([self.potential, np.zeros_like(self.potential)])
        get = index.get
        flat: list[int] = []
        ends = []
        for w in words:
            flat.extend([j for j in map(get, features(w)) if j is not None])
            ends.append(len(flat))
        sums = np.zeros((len(flat) + 1, weights.shape[1]))
        np.cumsum(weights[flat], axis=0, out=sums[1:])
        emit = sums[ends] - sums[[0, *ends[:-1]]]
        self.potential[have:have + len(words)] = np.exp(emit - emit.max(1, keepdims=True))
        self.known.update(zip(words, range(have, have + len(words))))

    def marginals(self, docs: list[list[str]]) -> np.ndarray:
        """(word, label) over the documents' words laid end to end."""
        new = set().union(*docs).difference(self.known)
        if new:
            if len(self.known) + len(new) > WORDS:
                new = set().union(*docs)
            self.learn(sorted(new))
        get = self.known.__getitem__
        counts = [len(d) for d in docs]
        ids = np.fromiter((i for d in docs for i in map(get, d)), np.int64, sum(counts))
        out = np.empty((len(ids), len(self.labels)), np.float32)
        starts, sizes, _ = lanes(counts)
        for lo in range(0, len(starts), 8192):
            s, n = starts[lo:lo + 8192], sizes[lo:lo + 8192]
            width = int(n.max())
            grid = np.minimum(s[:, None] + np.arange(width), len(ids) - 1)
            inside = np.arange(width) < n[:, None]
            x = self.potential[ids[grid]] + np.float32(1e-12)
            p = smoothed(x, n, self.model["first"].astype(np.float32), self.model["step"].astype(np.float32))
            out[grid[inside]] = p[inside]
        return out


def smoothed(x, sizes, first, step):
    """Marginals alone, as ``forward_backward`` gives them."""
    alpha, beta = np.empty_like(x), np.ones_like(x)
    a = first * x[:, 0]
    alpha[:, 0] = a / a.sum(1, keepdims=True)
    for i in range(1, x.shape[1]):
        a = (alpha[:, i - 1] @ step) * x[:, i]
        alpha[:, i] = a / a.sum(1, keepdims=True)
    for i in range(x.shape[1] - 2, -1, -1):
        b = (x[:, i + 1] * beta[:, i + 1]) @ step.T
        beta[:, i] = np.where((sizes > i + 1)[:, None], b / b.sum(1, keepdims=True), 1.0)
    p = alpha * beta
    return p / p.sum(2, keepdims=True)


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list:
    """At most ``most`` (text, lang) of each language, the smallest by hash of id; of a text its first ``chars / most`` characters."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("y"), F.col(text_col).alias("text")).filter("y is not null and id is not null")
    rows = rows.filter(F.col("text").rlike(r"\p{L}"))
    first = Window.partitionBy("y").orderBy("h", "id")
    ids = rows.select("id", "y", F.xxhash64("id").alias("h")).distinct()
    picked = ids.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= most)
    span = F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, max(1, chars // most))
    texts = rows.join(F.broadcast(picked.select("id", "y", "k")), ["id", "y"]).select("k", "y", span.alias("text"))
    # Rows that repeat an id count as further documents.
    again = Window.partitionBy("y").orderBy("k", "text")
    kept = texts.withColumn("r", F.row_number().over(again)).filter(F.col("r") <= most).orderBy("k", "y", "text")
    return [(r["text"], r["y"]) for r in kept.select("text", "y", "k").toLocalIterator()]


def detect(docs: DataFrame, model: dict, text_col: str = "text", sure: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``; if ``sure``, with ``lang_sure``, the mean of the words' largest marginals."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        labeller = Labeller(shared.value)

        def work(texts):
            split = [words_of(t) for t in texts]
            names, scores, own = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            full = [i for i, d in enumerate(split) if d]
            if full and labeller.labels:
                p = labeller.marginals([split[i] for i in full]).astype(np.float64)
                at = np.cumsum([0, *(len(split[i]) for i in full)])
                mean = np.add.reduceat(p, at[:-1], axis=0) / np.diff(at)[:, None]
                best = mean.argmax(1)
                for i, b, row in zip(full, best.tolist(), mean):
                    names[i], scores[i] = labeller.labels[b], min(1.0, float(row[b]))
                if sure:
                    for i, top in zip(full, (np.add.reduceat(p.max(1), at[:-1]) / np.diff(at)).tolist()):
                        own[i] = min(1.0, top)
            return [names, scores, own] if sure else [names, scores]

        return work

    fields = [("lang_pred", "string"), ("lang_score", "double"), *([("lang_sure", "double")] if sure else [])]
    return with_columns(docs, [text_col], fields, start)


def label_words(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_runs``: spans of consecutive words (end exclusive) of one language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        labeller = Labeller(shared.value)

        def runs(words):
            if not words or not labeller.labels:
                return []
            best = labeller.marginals([words]).argmax(1)
            cuts = [0, *(np.flatnonzero(best[1:] != best[:-1]) + 1).tolist(), len(best)]
            return [{"lang": labeller.labels[best[s]], "start": s, "end": e} for s, e in zip(cuts, cuts[1:])]

        return lambda texts: [[runs(words_of(t)) for t in texts]]

    return with_columns(docs, [text_col], [("lang_runs", "array<struct<lang:string,start:int,end:int>>")], start)


def trained(docs: DataFrame, **columns) -> dict:
    rows = sample(docs, **columns)
    return fit([t for t, _ in rows], [y for _, y in rows])


@query()
def op10_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = trained(docs.filter(~held))
    found = detect(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
