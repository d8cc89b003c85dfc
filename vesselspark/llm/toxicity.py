"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's score is the logistic function of a bias plus the weights of its
distinct features (words and their first four to six letters); a document's is the noisy-or of its sentences,
1 - prod(1 - score). The weights are trained on document labels alone, by
gradient descent on the documents' likelihood, where the noisy-or hands most of a
toxic document's gradient to the sentences that explain it. The trained sentence
scores then locate the offending sentences.

The classifier is fitted on a sample of at most ``SAMPLE`` labelled documents of
each class, the smallest by hash; that bound is a parameter, and so is the number of
features. The features are chosen on the sample by Spark; only their numbers reach
the driver. Scores cover all texts whole.
Null and empty texts have one empty sentence and so the score of the bias.
Documents without a label, or with a null label, are not learned from; without any
labelled document every score is 0.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselspark.llm.batches import with_columns
from vesselspark.llm.catalog import query, table
from vesselspark.session import stored

#: Labelled documents of each class that the classifier is fitted on.
SAMPLE = 2500
#: Features of the model at most.
FEATURES = 20_000
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
OPENINGS = (4, 5, 6)
LEAST_DOCS = 3
ROUNDS = 300
#: Words whose features a task remembers.
WORDS = 300_000


def sentences(text: str | None) -> list[str]:
    return SENTENCE.split(text.lower()) if text else [""]


def features(words) -> set[str]:
    """Words and their openings, which carry a stem before changing endings."""
    out = set(words)
    for w in tuple(out):
        for n in OPENINGS:
            if len(w) >= n:
                out.add(f"{w[:n]}-")
    return out


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit(spans: list[tuple[bytes, bytes]], labels: list[int], lexicon: list[str], rounds: int = ROUNDS, rate: float = 0.3, decay: float = 2e-3) -> dict:
    """Bias and weights of ``lexicon``; full-batch Adam over the noisy-or likelihood.

    A document is its sentences' sizes and their features' numbers, as 32-bit blobs.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return {"bias": -30.0 if not len(y) or y.max() == 0 else 30.0, "weights": {}}
    sizes = [np.frombuffer(s, "<u4") for s, _ in spans]
    docs = np.repeat(np.arange(len(y)), [len(s) for s in sizes])
    flat = np.concatenate(sizes).astype(np.int64)
    at = np.repeat(np.arange(len(flat)), flat)
    word = np.concatenate([np.frombuffer(w, "<u4") for _, w in spans]).astype(np.int64)
    n, v = len(flat), len(lexicon)
    size = np.bincount(docs, minlength=len(y))
    w, b = np.zeros(v), -np.log(2 * max(1.0, size.mean()))
    balance = np.where(y == 1, len(y) / 2 / (y == 1).sum(), len(y) / 2 / (y == 0).sum())
    m = np.zeros(v + 1)
    s2 = np.zeros(v + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(at, w[word], minlength=n)
        p = sigmoid(z)
        clean = np.bincount(docs, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y))  # log of 1 - noisy-or
        q = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence: p for a clean document, -p (1 - q) / q for a toxic one
        g = p * (np.where(y == 1, -(1 - q) / q, 1.0) * balance)[docs] / len(y)
        grad = np.append(np.bincount(word, g[at], minlength=v) + decay * w / max(1, v) ** 0.5, g.sum())
        m = 0.9 * m + 0.1 * grad
        s2 = 0.99 * s2 + 0.01 * grad * grad
        step = rate * 0.98 ** (t / 10) * (m / (1 - 0.9**t)) / (np.sqrt(s2 / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return {"bias": float(b), "weights": dict(zip(lexicon, w.tolist()))}


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SAMPLE) -> DataFrame:
    """(k, id, y, text): at most ``most`` documents of each label, the smallest by hash ``k`` of the id."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1) and id is not null")
    known = known.groupBy("id").agg(F.max("y").alias("y")).withColumn("k", F.xxhash64("id"))
    picked = known.filter("y = 0").orderBy("k", "id").limit(most).union(known.filter("y = 1").orderBy("k", "id").limit(most))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")


def telling_features(sample: DataFrame, n: list[int], most: int = FEATURES) -> list[str]:
    """Features in ``LEAST_DOCS`` documents or more whose rates in clean and toxic documents (``n`` of each) differ most."""

    def count():
        def work(texts, labels):
            seen: dict[str, list[int]] = {}
            for text, y in zip(texts, labels):
                for f in features(WORD.findall(text.lower())) if text else ():
                    seen.setdefault(f, [0, 0])[y] += 1
            rows = [{"f": f, "n0": a, "n1": b} for f, (a, b) in seen.items()]
            return [[rows, *[[]] * (len(texts) - 1)]]

        return work

    parts = with_columns(sample, ["text", "y"], [("seen", "array<struct<f:string,n0:int,n1:int>>")], count).select(F.explode("seen").alias("s"))
    both = parts.groupBy("s.f").agg(F.sum("s.n0").alias("n0"), F.sum("s.n1").alias("n1")).filter(F.col("n0") + F.col("n1") >= LEAST_DOCS)
    spread = F.sqrt((F.col("n0") + F.col("n1")) / F.lit(float(n[0] * n[1])))
    told = both.withColumn("z", F.abs(F.col("n0") / n[0] - F.col("n1") / n[1]) / spread).filter("z > 4")
    return sorted(r["f"] for r in told.orderBy(F.desc("z"), "f").limit(most).collect())


def trained(docs: DataFrame, labels: DataFrame, **columns) -> dict:
    sample = stored(labelled_sample(docs, labels, **columns), "toxic-sample")
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(n) < 2:
        return fit([], list(n), [])
    lexicon = telling_features(sample, [n[0], n[1]])
    shared = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(lexicon)})

    def bags():
        look = shared.value.get

        def one(text):
            found = [sorted(i for i in map(look, features(WORD.findall(s))) if i is not None) for s in sentences(text)]
            return np.array([len(x) for x in found], "<u4").tobytes(), np.array([i for x in found for i in x], "<u4").tobytes()

        return lambda texts: list(map(list, zip(*map(one, texts))))

    made = with_columns(sample, ["text"], [("sizes", "binary"), ("found", "binary")], bags)
    rows = made.select("k", "id", "y", "sizes", "found").orderBy("k", "id").collect()  # SAMPLE rows of each label at most
    return fit([(bytes(r["sizes"]), bytes(r["found"])) for r in rows], [r["y"] for r in rows], lexicon)


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` (noisy-or) and ``offending``, the sentences (position, score) of at least 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        bias, weights = shared.value["bias"], shared.value["weights"]
        base = float(sigmoid(bias))
        lexicon = frozenset(weights)

        class Told(dict):
            """Features with a weight of each word met."""

            def __missing__(self, word):
                found = self[word] = lexicon.intersection(features((word,)))
                return found

        known = Told()
        look = known.__getitem__

        def judge(text):
            if not text:
                return base, []
            if len(known) > WORDS:
                known.clear()
            rest, hits, keep = 0, [], 1.0
            for k, s in enumerate(SENTENCE.split(text.lower())):
                told = [x for x in map(look, WORD.findall(s)) if x]
                if not told:
                    rest += 1
                    continue
                z = bias + sum([weights[f] for f in sorted(frozenset().union(*told))])
                p = 1.0 / (1.0 + math.exp(-min(30.0, max(-30.0, z))))
                keep *= 1 - p
                if p >= 0.5:
                    hits.append({"sentence": k, "score": p})
            return 1 - keep * (1 - base) ** rest, hits

        def work(texts):
            both = [judge(t) for t in texts]
            return [[min(1.0, max(0.0, p)) for p, _ in both], [h for _, h in both]]

        return work

    return with_columns(docs, [text_col], [("toxicity", "double"), ("offending", "array<struct<sentence:int,score:double>>")], start)


@query()
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = table(spark, sf_dir, "labels").filter(~held)
    model = trained(docs, labels)
    scored = score(docs, model).withColumn("held_out", F.coalesce(held, F.lit(False)))
    return scored.select(
        "doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").cast("long").alias("n_offending"),
    )
