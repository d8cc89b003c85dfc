r"""Language-model scores from a log-frequency Bloom filter of bigrams.

Tokens are runs of bytes other than space and U+0009 to U+000D with A-Z lower-cased,
then one end token for each text. Counts come from the rows to learn from.

Token counts c, their sum N and the number V of distinct tokens are exact and give
the base probability (c + 0.1) / (N + 0.1 (V + 1)). Bigram counts are quantised to
1 + floor(log(count) / log(``RATIO``)) and the filter holds one entry for each bigram
and level up to its own, ``BITS`` bits an entry. A count is read by probing level 1, 2,
... until a probe misses; its estimate is the mean of the counts of that level, at most
the exact count of either word. The model's probability of a token after another is
(estimate + ``PRIOR`` base) / (count of the other + ``PRIOR``), where the token before a
text's first is the start of a text, counted once for each text learned from.

The work goes through parcels: a task joins documents to about ``PARCEL`` tokens and
sends its distinct tokens with their counts, packed in blobs, to buckets by hash, which
add up and answer, so a token that fills a third of the corpus is sent once a parcel.
Buckets grow in number with the input, not in size. The filter is made in shards of about ``SHARD`` bigrams by hash of
the bigram, a number that grows with the input. While all shards together stay below
``BROADCAST`` bytes they are broadcast; a larger filter is probed where its shards are,
by the same packed bigrams that made it, and gives the same counts.

Null texts are empty: one end token. Repeated rows are scored one by one; without
rows to learn from, all tokens are unknown and N is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselspark.llm.batches import chunks
from vesselspark.llm.catalog import query, table
from vesselspark.session import stored

PARCEL = 500_000
SHARD = 1_000_000
RATIO = 1.5
BITS = 10
PROBES = 4
PRIOR = 200.0
#: Bytes of filter that are broadcast at most.
BROADCAST = 192 << 20
START, END = b"\n\n", b"\n"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Bytes of a bigram's hash within its shard.
WIDTH = 4
#: Tokens of text for one bucket of the exact counts.
BUCKET = 2_000_000


def tokens_of(text: str | None) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    words.append(END)
    return words


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def expand(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def packed_tokens(tokens: list[bytes]) -> bytes:
    """Tokens hold no space, so it stands between them."""
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(tokens))


def unpacked_tokens(blob: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(blob).split(b" ")


def token_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def bigram_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(before * _MUL + mixed(word))


def sharded(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and hash within the shard of each bigram."""
    return (keys % np.uint64(shards)).astype(np.int64), (keys // np.uint64(shards)) & np.uint64((1 << 8 * WIDTH) - 1)


class Shard:
    """One part of the filter: bits and their number."""

    def __init__(self, size: int, blob: bytes):
        self.size, self.bits = size, np.frombuffer(blob, np.uint8)

    @staticmethod
    def places(keys: np.ndarray, level, size: int) -> Iterator[np.ndarray]:
        """Bit numbers of the entries (key, level)."""
        h = mixed(keys * _MUL + np.asarray(level).astype(np.uint64) * _MIX)
        step = mixed(h) | np.uint64(1)
        for k in range(PROBES):
            yield (mixed(h + np.uint64(k) * step) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
        """Size and bits of the filter of distinct ``keys`` with ``counts``."""
        levels = levels_of(counts)
        size = max(64, int(levels.sum()) * BITS)
        bits = np.zeros(size, bool)
        level = 1
        while len(keys):
            for at in cls.places(keys, level, size):
                bits[at] = True
            level += 1
            deep = levels >= level
            keys, levels = keys[deep], levels[deep]
        return size, np.packbits(bits).tobytes()

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Levels of ``keys`` by probing upwards until a miss; 0 for what is not held."""
        out = np.zeros(len(keys), np.uint8)
        alive = np.arange(len(keys))
        level = 1
        while len(alive) and level < 256:
            held = np.ones(len(alive), bool)
            for at in self.places(keys[alive], level, self.size):
                held &= (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            alive = alive[held]
            out[alive] = level
            level += 1
        return out


def levels_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(RATIO) + 1e-9).astype(np.int64)


def estimates() -> np.ndarray:
    """Mean of the counts of each level; 0 for level 0."""
    out = [0.0]
    for level in range(1, 257):
        low, high = math.ceil(RATIO ** (level - 1) - 1e-9), math.ceil(RATIO**level - 1e-9) - 1
        out.append((low + max(low, high)) / 2)
    return np.array(out)


PARCELS = "parcel long, ids array<string>, held binary, sizes binary, places binary, tokens binary, counts binary, starts long, n long"


def parcels(docs: DataFrame) -> DataFrame:
    """One row for about ``PARCEL`` tokens of (id, text, held): documents as places in the parcel's distinct tokens, most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        schema = pa.schema([
            ("parcel", pa.int64()), ("ids", pa.list_(pa.string())), ("held", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary()),
            ("tokens", pa.binary()), ("counts", pa.binary()), ("starts", pa.int64()), ("n", pa.int64()),
        ])
        ids, held, texts, count = [], [], [], 0

        def flush():
            known: dict[bytes, int] = {}
            flat = np.fromiter((known.setdefault(t, len(known)) for t in chain.from_iterable(texts)), np.int64, count)
            sizes = np.array([len(t) for t in texts], "<u4")
            off = np.array(held, bool)
            learn = np.bincount(flat[np.repeat(~off, sizes)], minlength=len(known))
            order = np.argsort(-np.bincount(flat, minlength=len(known)), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            names = list(known)
            row = {
                "parcel": part << 32 | number, "ids": ids, "held": off.tobytes(), "sizes": squeeze(sizes), "places": squeeze(place[flat].astype("<u4")),
                "tokens": packed_tokens([names[i] for i in order.tolist()]), "counts": squeeze(learn[order].astype("<u4")), "starts": int((~off).sum()), "n": count,
            }
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for whole in batches:
            for batch in chunks(whole, [1]):
                for i, text, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    w = tokens_of(text)
                    ids.append(i)
                    held.append(bool(h))
                    texts.append(w)
                    count += len(w)
                    if count >= PARCEL:
                        yield flush()
                        ids, held, texts, count, number = [], [], [], 0, number + 1
        if ids:
            yield flush()

    return docs.select("id", "text", "held").mapInArrow(run, PARCELS)


def parcel_bigrams(tokens: list[bytes], sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Key of the bigram that ends at each token."""
    words = token_hashes([*tokens, START])
    before = np.empty(len(places), np.int64)
    before[1:] = places[:-1]
    before[np.cumsum(sizes) - sizes] = len(tokens)
    return bigram_keys(words[before], words[places])


def bucket_places(tokens: list[bytes], buckets: int) -> list[tuple[int, np.ndarray]]:
    """The places of the tokens that go to each bucket, ascending."""
    bucket = (token_hashes(tokens) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(b, order[cuts[b]:cuts[b + 1]]) for b in np.flatnonzero(np.diff(cuts)).tolist()]


def sent_tokens(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, parcel, tokens, counts): the distinct tokens of each parcel by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parcel, tokens, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                tokens, counts = unpacked_tokens(tokens), expand(counts, "<u4")
                parts = bucket_places(tokens, buckets)
                yield pa.RecordBatch.from_arrays([
                    pa.array([b for b, _ in parts], pa.int64()), pa.array([parcel] * len(parts), pa.int64()),
                    pa.array([packed_tokens([tokens[i] for i in at.tolist()]) for _, at in parts], pa.binary()),
                    pa.array([squeeze(counts[at]) for _, at in parts], pa.binary()),
                ], names=["bucket", "parcel", "tokens", "counts"])

    return rows.select("parcel", "tokens", "counts").mapInArrow(run, "bucket long, parcel long, tokens binary, counts binary")


def add_up(df: pd.DataFrame) -> pd.DataFrame:
    """Counts of one bucket's tokens, answered to every parcel in its own order; the bucket's sums stand in its first row."""
    total: dict[bytes, int] = {}
    split = [unpacked_tokens(b) for b in df["tokens"]]
    for tokens, counts in zip(split, df["counts"]):
        for t, n in zip(tokens, expand(counts, "<u4").tolist()):
            total[t] = total.get(t, 0) + n
    rest = [0] * (len(df) - 1)
    return pd.DataFrame({
        "parcel": df["parcel"], "bucket": df["bucket"], "counts": [squeeze(np.fromiter(map(total.__getitem__, tokens), "<u8", len(tokens))) for tokens in split],
        "total": [sum(total.values()), *rest], "known": [sum(n > 0 for n in total.values()), *rest],
    })


def sent_bigrams(rows: DataFrame, shards: int) -> DataFrame:
    """(shard, parcel, keys, counts): the distinct bigrams of each parcel by shard, ascending, with counts to learn (0: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r].as_py() for n in ("parcel", "tokens", "sizes", "places", "held")}
                sizes, places = expand(row["sizes"], "<u4"), expand(row["places"], "<u4").astype(np.int64)
                keys = parcel_bigrams(unpacked_tokens(row["tokens"]), sizes, places)
                learn = np.repeat(~np.frombuffer(row["held"], bool), sizes)
                shard, key = sharded(keys, shards)
                order = np.lexsort((key, shard))
                shard, key, learn = shard[order], key[order], learn[order]
                first = np.append(True, (key[1:] != key[:-1]) | (shard[1:] != shard[:-1]))
                at = np.flatnonzero(first)
                n = np.add.reduceat(learn.astype(np.int64), at)
                shard, key = shard[at], key[at]
                cuts = np.searchsorted(shard, np.arange(shards + 1))
                some = np.flatnonzero(np.diff(cuts)).tolist()
                raw = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH]
                yield pa.RecordBatch.from_arrays([
                    pa.array(some, pa.int64()), pa.array([row["parcel"]] * len(some), pa.int64()),
                    pa.array([raw[cuts[s]:cuts[s + 1]].tobytes() for s in some], pa.binary()),
                    pa.array([squeeze(n[cuts[s]:cuts[s + 1]].astype("<u4")) for s in some], pa.binary()),
                ], names=["shard", "parcel", "keys", "counts"])

    return rows.select("parcel", "tokens", "sizes", "places", "held").mapInArrow(run, "shard long, parcel long, keys binary, counts binary")


def widened(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(blob, np.uint8).reshape(-1, WIDTH)
    return out.view("<u8")[:, 0]


def make_shard(df: pd.DataFrame) -> pd.DataFrame:
    keys = np.concatenate([widened(b) for b in df["keys"]])
    counts = np.concatenate([expand(b, "<u4") for b in df["counts"]]).astype(np.int64)
    keys, counts = keys[counts > 0], counts[counts > 0]
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    size, bits = Shard.of(keys[at], np.add.reduceat(counts, at) if len(at) else counts)
    return pd.DataFrame({"shard": [df["shard"].iloc[0]], "size": [size], "bits": [bits]})


def probe_shard(asks: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    part = Shard(int(filters["size"].iloc[0]), filters["bits"].iloc[0])
    return pd.DataFrame({"parcel": asks["parcel"], "shard": asks["shard"], "levels": [part.level(widened(b)).tobytes() for b in asks["keys"]]})


def scorer(total: int, distinct: int, texts: int, buckets: int, shards: int, shared):
    """Scores one parcel from its row, its tokens' counts, and levels that the broadcast filter or other rows give."""
    mean = estimates()

    def run(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        tokens = unpacked_tokens(row["tokens"])
        answer = known[known["bucket"] >= 0]
        by_bucket = dict(zip(answer["bucket"], answer["counts"]))
        count = np.zeros(len(tokens) + 1)
        for b, at in bucket_places(tokens, buckets):
            count[at] = expand(by_bucket[b], "<u8")
        count[-1] = texts
        sizes, places = expand(row["sizes"], "<u4").astype(np.int64), expand(row["places"], "<u4").astype(np.int64)
        keys = parcel_bigrams(tokens, sizes, places)
        keys, back = np.unique(keys, return_inverse=True)
        shard, key = sharded(keys, shards)
        levels = np.zeros(len(keys), np.uint8)
        order = np.lexsort((key, shard))
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        if shared is not None:
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[s]:cuts[s + 1]]
                levels[at] = shared.value[s].level(key[at])
        else:
            for s, blob in known.loc[known["bucket"] < 0, ["shard", "levels"]].itertuples(index=False):
                at = order[cuts[int(s)]:cuts[int(s) + 1]]
                own, inverse = np.unique(key[at], return_inverse=True)
                levels[at] = np.frombuffer(blob, np.uint8)[inverse]
        before = np.empty(len(places), np.int64)
        begin = np.cumsum(sizes) - sizes
        before[1:] = places[:-1]
        before[begin] = len(tokens)
        base = (count[:-1] + 0.1) / (total + 0.1 * (distinct + 1))
        met = np.minimum(mean[levels[back]], np.minimum(count[before], count[places]))
        p = (met + PRIOR * base[places]) / (count[before] + PRIOR)
        return pd.DataFrame({
            "id": list(row["ids"]), "held_out": np.frombuffer(row["held"], bool), "n_tokens": sizes,
            "n_known": np.add.reduceat((count[places] > 0).astype(np.int64), begin), "train_tokens": np.int64(total),
            "base_score": np.add.reduceat(np.log10(base)[places], begin), "score": np.add.reduceat(np.log10(p), begin),
        })

    return run


SCORES = "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held, id_col: str = "doc_id", text_col: str = "text", broadcast: int = BROADCAST) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; rows where ``held`` is true are not learned from."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    asked = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    rows = stored(parcels(asked), "lm-parcels")
    size = rows.agg(F.sum("n"), F.sum("starts")).first()
    buckets, texts = max(64, -(-(size[0] or 0) // BUCKET)), size[1] or 0
    counted = sent_tokens(rows, buckets).groupBy("bucket").applyInPandas(add_up, "parcel long, bucket long, counts binary, total long, known long")
    answers = stored(counted, "lm-counts")
    sums = answers.agg(F.sum("total"), F.sum("known")).first()
    total, distinct = sums[0] or 0, sums[1] or 0
    answers = answers.select("parcel", "bucket", "counts").toDF("parcel", "bucket", "counts")
    shards = max(16, -(-total // SHARD))
    filters = stored(sent_bigrams(rows, shards).groupBy("shard").applyInPandas(make_shard, "shard long, size long, bits binary"), "lm-filter")
    shared = None
    if (filters.agg(F.sum(F.length("bits"))).first()[0] or 0) <= broadcast:
        shared = spark.sparkContext.broadcast({r["shard"]: Shard(r["size"], bytes(r["bits"])) for r in filters.toLocalIterator()})
    else:
        asks = sent_bigrams(rows, shards)
        probed = asks.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(probe_shard, "parcel long, shard long, levels binary")
        blank = {"shard": F.lit(None).cast("long"), "levels": F.lit(None).cast("binary")}
        answers = answers.withColumns(blank).unionByName(
            probed.select("parcel", F.lit(-1).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("counts"), "shard", "levels")
        )
    work = scorer(total, distinct, texts, buckets, shards, shared)
    left = rows.drop("counts", "starts", "n")
    out = left.toDF(*left.columns).groupBy("parcel").cogroup(answers.groupBy("parcel")).applyInPandas(work, SCORES)
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


@query()
def op2_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
