r"""Exact repeats of word sequences: fixed-block anchors, rolling probes, extension.

Words are runs of bytes other than space and U+0009 to U+000D. A window is
``WINDOW`` consecutive words of one document; every word covered by a window whose
sequence also starts anywhere else is removed.

Reference blocks are the non-overlapping blocks of ``BLOCK`` words from a document's
start; any window holds one whole. Every rolling window of BLOCK words is a probe:
it hits if its sequence equals a reference block elsewhere, or that block is itself
such. Windows around a hit are candidates; they are hashed whole, and those that
occur twice extend, where they overlap, to maximal exact repeats.

Both steps use one exchange. A task joins documents to parcels of about ``PARCEL``
words, settles sequences that repeat within the parcel, and sends one fingerprint
for each distinct sequence to the bucket of its hash, packed in blobs. A bucket gets
at most one row for a sequence and parcel, however common the sequence is, and
answers with positions. Buckets grow in number with the input, not in size. Probes
carry 24 bits besides the bucket (a false hit only makes a candidate); whole windows
carry 64 bits.

Documents are followed by a row id that is given anew in each scan, so ``docs`` must
be a scan of a table or another frame that gives the same rows in the same order.
Nulls, empty texts and texts shorter than a window keep all their words. Repeated
rows are repeats of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselspark.llm.batches import chunks, with_columns
from vesselspark.llm.catalog import query, table
from vesselspark.session import stored

WINDOW = 35
#: Any WINDOW words hold a whole block of this many that starts at a multiple of it.
BLOCK = (WINDOW + 1) // 2
PARCEL = 1_000_000
#: Characters of text for one bucket.
BUCKET_CHARS = 8_000_000
LEAST_BUCKETS = 64
WORDS = 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
PACKED = "bucket long, rows binary, ends binary, prints binary, places binary"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes:
    """64-bit hashes of words; remembers a bounded number."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, docs: list[list[bytes]]) -> np.ndarray:
        new = set().union(*docs).difference(self.known)
        if len(self.known) + len(new) > WORDS:
            self.known, new = {}, set().union(*docs)
        self.known.update(zip(new, map(xxhash.xxh3_64_intdigest, new)))
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(docs)), np.uint64, sum(map(len, docs)))


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position."""
    n = max(0, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * _BASE + words[k:k + n]
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def pack(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers as compressed differences; ascending ones fit 32 bits."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(numbers, prepend=0).astype(kind).tobytes())


def unpack(blob: bytes, kind: str = "<u4") -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind).astype(np.int64))


def parcel_rows(rows: np.ndarray, sizes: np.ndarray, at: np.ndarray, h: np.ndarray, buckets: int, width: int, prefer: np.ndarray) -> Iterator[tuple]:
    """What one parcel sends: hashes ``h`` at word places ``at`` of documents ``rows`` of ``sizes`` words.

    ``prefer`` marks places that stand for their sequence if any do. Sequences that
    repeat here are answered at once: their places go to a bucket that only passes
    them on (prints empty).
    """
    order = np.lexsort((at, ~prefer, h))
    hs = h[order]
    first = np.ones(len(hs), bool)
    first[1:] = hs[1:] != hs[:-1]
    again = ~first
    again[:-1] |= ~first[1:]
    ids, ends = pack(rows, "<i8"), pack(np.cumsum(sizes))
    if again.any():
        places = np.sort(at[order[again]])
        yield -1 - int(rows[0] % buckets), ids, ends, b"", pack(places)
    chosen = order[first]
    h, at = h[chosen], at[chosen]
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort((at, bucket))
    bucket, h, at = bucket[by], h[by] // np.uint64(buckets), at[by]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    raw = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        s, e = cuts[b], cuts[b + 1]
        yield b, ids, ends, raw[s:e].tobytes(), pack(at[s:e])


def answers(width: int, block: int | None):
    """Positions of the sequences of one bucket that occur more than once; with ``block``, one of them at a multiple of it."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        prints, owner, place, row = [], [], [], []
        done_rows, done_at = [], []
        for ids, ends, raw, packed in zip(df["rows"], df["ends"], df["prints"], df["places"]):
            ids, ends, at = unpack(ids, "<i8"), unpack(ends), unpack(packed)
            begin = np.append(0, ends[:-1])
            doc = np.searchsorted(begin, at, side="right") - 1
            if raw:
                wide = np.zeros((len(at), 8), np.uint8)
                wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
                prints.append(wide.view("<u8")[:, 0])
                row.append(ids[doc])
                place.append(at - begin[doc])
            else:
                done_rows.append(ids[doc])
                done_at.append(at - begin[doc])
        if prints:
            h, r, p = np.concatenate(prints), np.concatenate(row), np.concatenate(place)
            order = np.argsort(h, kind="stable")
            hs = h[order]
            edge = np.flatnonzero(np.append(True, hs[1:] != hs[:-1]))
            count = np.diff(np.append(edge, len(hs)))
            good = count > 1
            if block:
                good &= np.logical_or.reduceat(p[order] % block == 0, edge)
            hit = order[np.repeat(good, count)]
            done_rows.append(r[hit])
            done_at.append(p[hit])
        if not done_rows:
            return pd.DataFrame({"row": [], "places": []})
        r, p = np.concatenate(done_rows), np.concatenate(done_at)
        order = np.lexsort((p, r))
        r, p = r[order], p[order]
        edge = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, int)
        parts = [p[s:e].astype("<u4").tobytes() for s, e in zip(edge, np.append(edge[1:], len(r)))]
        return pd.DataFrame({"row": r[edge], "places": parts})

    return run


def exchanged(docs: DataFrame, buckets: int, window: int, width: int, block: int | None) -> DataFrame:
    """(row, places): for each document of (row, text, only) the positions, as little-endian 32-bit blobs, of repeated sequences.

    ``only`` null: every position is asked; else those in the blob.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held_rows, held_sizes, held_words, held_only = [], [], [], []
        names = ["bucket", "rows", "ends", "prints", "places"]
        types = [pa.int64(), *[pa.binary()] * 4]

        def flush():
            rows, sizes = np.array(held_rows, np.int64), np.array(held_sizes, np.int64)
            words = np.concatenate(held_words)
            h = rolling(words, window)
            begin = np.cumsum(sizes) - sizes
            if held_only[0] is None:
                left = np.repeat(begin + sizes, sizes)[:len(h)] - np.arange(len(h))
                at = np.flatnonzero(left >= window)
            else:
                at = np.concatenate([np.frombuffer(o, "<u4").astype(np.int64) + b for o, b in zip(held_only, begin)])
            if len(at):
                doc = np.searchsorted(begin, at, side="right") - 1
                prefer = (at - begin[doc]) % block == 0 if block else np.zeros(len(at), bool)
                made = list(parcel_rows(rows, sizes, at, h[at], buckets, width, prefer))
                for lo in range(0, len(made), 256):
                    cols = list(zip(*made[lo:lo + 256]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
            for x in (held_rows, held_sizes, held_words, held_only):
                x.clear()

        count = 0
        for whole in batches:
            for batch in chunks(whole, [1]):
                split = [words_of(t) for t in batch.column(1).to_pylist()]
                flat, lo = hashes(split), 0
                for row, w, only in zip(batch.column(0).to_pylist(), split, batch.column(2).to_pylist()):
                    part, lo = flat[lo:lo + len(w)], lo + len(w)
                    if len(w) >= window:
                        held_rows.append(row)
                        held_sizes.append(len(w))
                        held_words.append(part)
                        held_only.append(only)
                        count += len(w)
                        if count >= PARCEL:
                            yield from flush()
                            count = 0
        if held_rows:
            yield from flush()

    packed = docs.select("row", "text", "only").mapInArrow(send, PACKED)
    return packed.groupBy("bucket").applyInPandas(answers(width, block), "row long, places binary")


def covered(places: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` positions lie within ``size`` from one of ``places``."""
    edges = np.bincount(places, minlength=n + 1)[:n + 1] - np.bincount(np.minimum(places + size, n), minlength=n + 1)[:n + 1]
    return np.cumsum(edges)[:n] > 0


def all_places(blobs) -> np.ndarray:
    return np.unique(np.concatenate([np.frombuffer(b, "<u4").astype(np.int64) for b in blobs]))


def candidates(texts, hits):
    """(n_words, starts of candidate windows or None) of each document."""
    counts, found = [], []
    for text, blobs in zip(texts, hits):
        n = len(words_of(text))
        counts.append(n)
        starts = None
        if blobs and n >= WINDOW:
            # Windows that hold a whole hit block start at most WINDOW - BLOCK words before it.
            at = all_places(blobs)
            back = np.maximum(at - (WINDOW - BLOCK), 0)
            edges = np.bincount(back, minlength=n + 1) - np.bincount(at + 1, minlength=n + 1)
            starts = np.flatnonzero(np.cumsum(edges)[:n - WINDOW + 1] > 0).astype("<u4").tobytes() or None
        found.append(starts)
    return counts, found


def repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and ``repeat_spans``: maximal runs of words (end exclusive) to remove."""
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-chars // BUCKET_CHARS))
    asked = rows.select(F.col("__row").alias("row"), F.col(text_col).alias("text"), F.lit(None).cast("binary").alias("only"))
    gathered = lambda df: df.groupBy("row").agg(F.collect_list("places").alias("hits")).withColumnRenamed("row", "__row")
    hits = gathered(stored(exchanged(asked, buckets, BLOCK, 3, BLOCK), "repeat-hits"))
    met = with_columns(rows.join(hits, "__row", "left"), [text_col, "hits"], [("n_words", "long"), ("__starts", "binary")], lambda: candidates)
    met = stored(met.drop("hits"), "repeat-candidates")
    asked = met.filter("__starts is not null").select(F.col("__row").alias("row"), F.col(text_col).alias("text"), F.col("__starts").alias("only"))
    found = gathered(stored(exchanged(asked, buckets, WINDOW, 8, None), "repeat-windows"))

    def extend():
        def work(counts, blobs):
            out = []
            for n, own in zip(counts, blobs):
                if not own:
                    out.append([])
                    continue
                gone = np.concatenate([[False], covered(all_places(own), WINDOW, n), [False]])
                turns = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
                out.append([{"start": s, "end": e} for s, e in zip(turns[::2], turns[1::2])])
            return [out]

        return work

    spans = with_columns(found.join(met.select("__row", "n_words"), "__row"), ["n_words", "hits"], [("repeat_spans", "array<struct<start:int,end:int>>")], extend)
    spans = stored(spans.select("__row", "repeat_spans"), "repeat-spans")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return met.drop("__starts").join(spans, "__row", "left").drop("__row").withColumn("repeat_spans", F.coalesce("repeat_spans", none))


def without_repeats(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``kept``: the words outside ``repeat_spans``, joined by one space."""

    def start():
        def work(texts, spans):
            return [[b" ".join(kept_words(t, s)).decode("utf-8", "surrogatepass") for t, s in zip(texts, spans)]]

        return work

    return with_columns(found, [text_col, "repeat_spans"], [("kept", "string")], start)


def kept_words(text: str | None, spans) -> list[bytes]:
    words = words_of(text)
    for s in reversed(spans or ()):
        del words[s["start"]:s["end"]]
    return words


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS s
        FROM (SELECT *, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS p FROM win SEMI JOIN rep USING (s)),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query(SQL)
def op7_substrings(spark, sf_dir):
    found = repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def digest():
        return lambda texts, spans: [[hashlib.sha256(b" ".join(kept_words(t, s))).hexdigest() for t, s in zip(texts, spans)]]

    removed = F.aggregate("repeat_spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    out = with_columns(found, ["text", "repeat_spans"], [("kept_sha256", "string")], digest)
    return out.select("doc_id", "n_words", removed.alias("n_removed"), "kept_sha256")
