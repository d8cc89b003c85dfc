"""Near-duplicate documents by BagMinHash signatures and verified multiset overlap.

A document is the multiset of its shingles of ``SHINGLE`` consecutive words (runs of
letters, digits and _, lower-cased; all words if there are fewer). Similarity is the
weighted Jaccard index of two multisets: sum of minima over sum of maxima. Texts of
at least ``LEAST`` similarity are linked, and a class is a connected component of links.

BagMinHash: every shingle carries unit-rate Poisson processes in time on the weight
levels [0, 1), [1, 2), [2, 4), [4, 8) ...; an event names one of the signature's
places, and one whose level is not below the shingle's weight is dropped. A place
keeps its first event, so that two signatures agree in a place with probability equal
to the similarity. Events are drawn in order of time and only up to a limit at which
nearly every signature is full; the rest are drawn again with a doubled limit.

``BANDS`` bands of ``ROWS`` places make candidate buckets (a pair of similarity 0.8
shares one with probability 0.9999). The low bytes of the signatures are kept as
sketches; a pair that agrees in fewer than ``AGREE`` of 120 places is no candidate
(a pair of similarity 0.8 agrees in fewer with probability below 1e-4). Exact copies
are one text first. Of a bucket, sorted by its texts' other bands, neighbours in that order
are compared first, for each text the pair whose sketches agree best. After that only
buckets whose texts are in different components are left, and there every text outside the
bucket's largest component is compared with all others: a bucket is cut into blocks of at
most about ``BLOCK`` texts and ``BLOCK_BYTES``, a task gets a block of such texts and a block of
others, compares their sketches, verifies what agrees on the spot, and gives back only links
that join two components. A pair is compared in the first band that it shares. Links between
texts that a component already joins are not needed for the classes; no other is left out.

Nulls, empty texts and texts without words are classes of their own. Repeated rows
are exact copies of each other. A class is named by its smallest document id; an
empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vesselspark.llm.batches import with_columns
from vesselspark.llm.catalog import query, table
from vesselspark.plans.graphloop import STAR_ROWS, _stars, components
from vesselspark.session import forget, stored

SHINGLE = 5
LEAST = 0.8
BANDS = 24
ROWS = 5
#: Of 120 places, those in which the sketches of a candidate pair agree at least.
AGREE = 78
#: Texts of one block of a bucket, about, and bytes of their shingles.
BLOCK = 2048
BLOCK_BYTES = 8 << 20
#: Words whose hashes a task remembers.
WORDS = 200_000
#: Bytes of text that a task works on at once.
CHUNK = 2 << 20
WORD = re.compile(r"\w+")

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_S = [np.uint64(x) for x in (30, 27, 31, 11)]


def times(n: int, k: int) -> np.uint64:
    """n times a constant, modulo 2^64."""
    return np.uint64(n * int(_M[k]) & 0xFFFFFFFFFFFFFFFF)


def draws(n: int) -> tuple[np.ndarray, np.ndarray]:
    """What is added to an element's seed for the time and for the place of each event."""
    k = np.arange(n, dtype=np.uint64) * np.uint64(2)
    return (k + np.uint64(1)) * _M[1], (k + np.uint64(2)) * _M[2]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _S[0])) * _M[1]
    x = (x ^ (x >> _S[1])) * _M[2]
    return x ^ (x >> _S[2])


class Shingler:
    """Distinct shingle hashes and counts of texts; remembers hashes of words."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash, count), sorted by text and hash."""
        docs = [WORD.findall(t.lower()) if t else () for t in texts]
        new = set().union(*docs).difference(self.known)
        if len(self.known) + len(new) > WORDS:
            self.known, new = {}, set().union(*docs)
        digest = xxhash.xxh3_64_intdigest
        self.known.update((w, digest(w)) for w in new)
        get = self.known.__getitem__
        sizes = np.array([len(d) for d in docs], np.int64)
        words = np.fromiter(map(get, chain.from_iterable(docs)), np.uint64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(docs)), sizes)
        left = np.repeat(ends, sizes) - np.arange(len(words))  # words from here to the end of the text
        h = np.zeros(len(words), np.uint64)
        for k in range(SHINGLE):
            piece = words[k:] if k else words
            piece = np.concatenate([piece, np.zeros(min(k, len(words)), np.uint64)])[:len(words)]
            h = h * _M[0] + np.where(left > k, piece, np.uint64(k + 1))
        starts = (left >= SHINGLE) | (left == np.repeat(sizes, sizes))  # the first place of a short text counts
        h, owner = mixed(h[starts]), owner[starts]
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(first)
        return owner[at], h[at], np.diff(np.append(at, len(h)))


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> _S[3]).astype(np.float64) + 0.5) * 2.0**-53


def bag_signatures(owner: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """(n, m) signatures of the multisets (owner, key, weight); rows without elements stay 0."""
    sig = np.zeros((n, m), np.uint64)
    total = np.bincount(owner, weight, minlength=n)
    limit = (math.log(m) + 3.0) * m / np.maximum(total, 1)
    pending = total > 0
    odd, even = draws(4096)
    while pending.any():
        mine = pending[owner]
        best = np.full(n * m, np.inf)
        name = np.zeros(n * m, np.uint64)
        own, k, w = owner[mine], key[mine], weight[mine]
        low, length, level = 0, 1, 0
        while len(k):
            # The process of one level of every element that reaches it, event by event.
            o, seed, top = own, mixed(k + times(level + 1, 0)), w
            t = np.zeros(len(o))
            step, width = 0, 1
            while len(o):
                # Events step, step + 1, ... of all elements whose last event was within the limit.
                a = mixed(seed[:, None] + odd[step:step + width])
                gaps = np.log(uniform(a)) * (-m / length)
                gaps[:, 0] += t
                when = np.cumsum(gaps, 1)
                row, col = np.nonzero(when <= limit[o][:, None])
                if len(row):
                    event, time = a[row, col], when[row, col]
                    b = mixed(seed[row] + even[step + col])
                    keep = low + length * uniform(mixed(b ^ event)) < top[row]
                    cell = (o[row] * m + (b % np.uint64(m)).astype(np.int64))[keep]
                    event, time = event[keep], time[keep]
                    np.minimum.at(best, cell, time)
                    won = time == best[cell]
                    name[cell[won]] = event[won]
                go = when[:, -1] <= limit[o]
                o, seed, top, t = o[go], seed[go], top[go], when[go, -1]
                step, width = step + width, min(2 * width, 64)
                if step + width > len(odd):
                    odd, even = draws(2 * len(odd))
            low, length, level = low + length, (length if level == 0 else 2 * length), level + 1
            deep = w > low
            own, k, w = own[deep], k[deep], w[deep]
        full = np.isfinite(best).reshape(n, m).all(1) & pending
        sig[full] = name.reshape(n, m)[full]
        pending &= ~full
        limit = np.where(pending, 2 * limit, limit)
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One hash for each band of each signature, different between bands."""
    h = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _M[0], (len(sig), 1))
    for r in range(rows):
        h = mixed(h * _M[1] + sig[:, r * bands:(r + 1) * bands])
    return h.view(np.int64)


def with_bands(docs: DataFrame, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` with ``bands`` (empty without words) and ``sketch``."""

    def start():
        shingles = Shingler()

        def work(texts):
            owner, key, weight = shingles(texts)
            sig = bag_signatures(owner, key, weight, len(texts), bands * rows)
            some = np.bincount(owner, minlength=len(texts)) > 0
            low = (sig & np.uint64(255)).astype(np.uint8)
            return [[k if s else [] for k, s in zip(band_keys(sig, bands, rows).tolist(), some.tolist())], [x.tobytes() for x in low]]

        return work

    return with_columns(docs, [text_col], [("bands", "array<long>"), ("sketch", "binary")], start, chunk=CHUNK)


def agreeing(pairs: DataFrame, agree: float) -> DataFrame:
    """``pairs`` (x, y, sketches sx, sy) with ``agree``, the places in which the sketches agree; below the share ``agree`` they go."""

    def start():
        def work(xs, ys):
            if not xs:
                return [[]]
            both = [np.frombuffer(b"".join(z), np.uint8).reshape(len(z), -1) for z in (xs, ys)]
            return [(both[0] == both[1]).sum(1).tolist()]

        return work

    met = with_columns(pairs, ["sx", "sy"], [("agree", "int")], start)
    return met.filter(F.col("agree") >= agree * F.length("sx")).drop("sx", "sy")


def with_shingles(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``shingles`` (sorted 64-bit hashes) and ``counts`` (32-bit, compressed), as blobs, and ``weight``; without the text."""

    def start():
        shingles = Shingler()

        def work(texts):
            owner, key, weight = shingles(texts)
            at = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
            both = list(zip(at, at[1:]))
            return [
                [key[s:e].tobytes() for s, e in both], [squeeze(weight[s:e].astype("<u4")) for s, e in both],
                [int(weight[s:e].sum()) for s, e in both],
            ]

        return work

    return with_columns(docs, [text_col], [("shingles", "binary"), ("counts", "binary"), ("weight", "long")], start, chunk=CHUNK).drop(text_col)


def squeeze(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.tobytes())


def expand(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<u4")


def overlap(a: bytes, ca: bytes, b: bytes, cb: bytes) -> int:
    """Sum of the minima of two multisets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = y[at] == x
    return int(np.minimum(expand(ca)[same], expand(cb)[at[same]]).sum())


def verified(pairs: DataFrame, shingled: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (a, b) whose multisets have at least ``least`` similarity, with it."""
    weights = shingled.select("rep", "weight")
    sides = [weights.toDF("a", "wa"), weights.toDF("b", "wb")]
    # Sizes alone rule out many pairs before any shingles move.
    pairs = pairs.join(sides[0], "a").join(sides[1], "b").filter(F.least("wa", "wb") >= least * F.greatest("wa", "wb"))
    blobs = shingled.select("rep", "shingles", "counts")
    pairs = pairs.join(blobs.toDF("a", "sa", "ca"), "a").join(blobs.toDF("b", "sb", "cb"), "b")

    def start():
        return lambda *columns: [[overlap(*row) for row in zip(*columns)]]

    met = with_columns(pairs, ["sa", "ca", "sb", "cb"], [("met", "long")], start)
    similarity = F.col("met") / (F.col("wa") + F.col("wb") - F.col("met"))
    return met.select("a", "b", similarity.alias("similarity")).filter(F.col("similarity") >= least)


def text_key(text_col: str):
    return F.md5(F.col(text_col))


def joined(links: DataFrame, comp: DataFrame) -> DataFrame:
    """``comp`` (rep, comp) after the components that ``links`` (a, b) touch have become one."""
    ends = [comp.toDF(x, f"c{x}") for x in ("a", "b")]
    edges = links.join(ends[0], "a").join(ends[1], "b").filter("ca <> cb").select(F.lit(0).cast("long").alias("case_id"), F.col("ca").alias("src"), F.col("cb").alias("dst"))
    edges = stored(edges.distinct(), "near-edges")
    n = edges.count()
    if n == 0:
        return comp
    if n <= STAR_ROWS:  # one batch of the contraction that ``components`` starts with, and so all of it
        ends = edges.select("case_id", F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        found = ends.coalesce(1).mapInPandas(_stars, ends.schema).select(F.col("u").alias("comp"), F.col("v").alias("new"))
    else:
        found = components(edges).select(F.col("node").alias("comp"), F.col("comp").alias("new"))
    return stored(comp.join(found, "comp", "left").select("rep", F.coalesce("new", "comp").alias("comp")), "near-comps")


def undecided(members: DataFrame, comp: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """Members of buckets with several components, with ``lead`` (outside the largest one) and the numbers of blocks.

    ``comp`` holds rep, comp and size; ``leads`` and ``others`` are the numbers of blocks of leading and of all texts.
    """
    at = members.join(comp, "rep")
    parts = lambda n, size: F.ceil(F.greatest(F.col(n) / block, F.col(size) / block_bytes))
    per = (
        at.groupBy("bucket", "comp").agg(F.count("*").alias("c"), F.sum("size").alias("s")).groupBy("bucket")
        .agg(F.sum("c").alias("n"), F.sum("s").alias("bytes"), F.count("*").alias("comps"), F.max(F.struct("c", "comp", "s")).alias("top"))
        .filter("comps > 1").withColumn("lead_n", F.col("n") - F.col("top.c")).withColumn("lead_bytes", F.col("bytes") - F.col("top.s"))
        .select("bucket", F.col("top.comp").alias("top"), parts("lead_n", "lead_bytes").alias("leads"), parts("n", "bytes").alias("others"))
    )
    return at.join(per, "bucket").withColumn("lead", F.col("comp") != F.col("top")).drop("top")


def cells(held: DataFrame, block_bytes: int) -> DataFrame:
    """``held`` once for each pair of blocks that a text belongs to: ``part`` and ``l``, ``o`` name it, ``asks`` and ``answers`` say what the text does there.

    Buckets of one pair of blocks share parcels of about ``block_bytes``.
    """
    total = held.filter("leads * others = 1").agg(F.sum("size")).first()[0] or 0
    parcels = max(1, math.ceil(total / block_bytes))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    cell = lambda l, o, asks, answers: F.struct(l.alias("l"), o.alias("o"), asks.alias("asks"), answers.alias("answers"))
    last = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    answering = F.transform(last("leads"), lambda l: cell(l, own("others"), F.col("lead") & (l == own("leads")), F.lit(True)))
    asking = F.filter(last("others"), lambda o: F.col("lead") & (o != own("others")))
    asking = F.transform(asking, lambda o: cell(own("leads"), o, F.lit(True), F.lit(False)))
    placed = held.select("bucket", "rep", "comp", F.expr("leads * others = 1").alias("small"), F.explode(F.concat(answering, asking)).alias("cell"))
    part = F.when(F.col("small"), F.pmod("bucket", F.lit(parcels))).otherwise(F.col("bucket"))
    return placed.select("bucket", "rep", "comp", "small", part.alias("part"), "cell.*")


def bucket_links(names: np.ndarray, bands: np.ndarray, bucket: int, comp: np.ndarray, asks: np.ndarray, answers: np.ndarray, sketch: np.ndarray,
                 weight: np.ndarray, shingles: list[np.ndarray], counts: list[np.ndarray], agree: float, least: float) -> list[tuple[int, int]]:
    """Verified pairs of one bucket's asking and answering texts that join components, fewer than the texts."""
    others = np.flatnonzero(answers)
    band = int(np.argmax(bands[0] == bucket))
    label = np.unique(comp, return_inverse=True)[1]
    sizes = np.array([len(x) for x in shingles])
    ids = np.unique(np.concatenate(shingles), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    held = np.zeros(int(ids.max()) + 1, np.int64)
    found = []
    for x in np.flatnonzero(asks):
        ys = others[label[others] != label[x]]
        ys = ys[np.minimum(weight[ys], weight[x]) >= least * np.maximum(weight[ys], weight[x])]
        same = (sketch[ys] == sketch[x]).sum(1)
        ys = ys[same >= agree * sketch.shape[1]]
        ys = ys[~(bands[ys, :band] == bands[x, :band]).any(1)]  # an earlier bucket holds those
        if not len(ys):
            continue
        mine = ids[starts[x]:ends[x]]
        held[mine] = counts[x]
        theirs = np.concatenate([ids[starts[y]:ends[y]] for y in ys])
        met = np.minimum(held[theirs], np.concatenate([counts[y] for y in ys]))
        met = np.add.reduceat(met, np.cumsum(sizes[ys]) - sizes[ys])
        held[mine] = 0
        for y in ys[met >= least * (weight[ys] + weight[x] - met)]:
            if label[y] != label[x]:
                found.append((int(names[x]), int(names[y])))
                label[label == label[y]] = label[x]
    return found


def cell_links(agree: float, least: float):
    """The function that takes the texts of a parcel of buckets, or of one pair of blocks, to the links in them."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("bucket").combine_chunks()
        bucket = part["bucket"].to_numpy()
        edges = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1, append=bucket[-1] + 1))
        found = []
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            one = part.slice(s, e - s)
            column = lambda c: one[c].to_numpy(zero_copy_only=False)  # noqa: E731,B023
            blobs = lambda c: [v.as_py() for v in one[c]]  # noqa: E731,B023
            found += bucket_links(
                column("rep"), np.array(one["bands"].to_pylist(), np.int64), int(bucket[s]), column("comp"), column("asks"), column("answers"),
                np.frombuffer(b"".join(blobs("sketch")), np.uint8).reshape(e - s, -1), column("weight"),
                [np.frombuffer(v, np.uint64) for v in blobs("shingles")], [expand(v).astype(np.int64) for v in blobs("counts")], agree, least,
            )
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def text_classes(docs: DataFrame, text_col: str = "text", bands: int = BANDS, rows: int = ROWS, agree: int = AGREE, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(text_key, comp): the component of each distinct text that has words."""
    texts = docs.select(F.col(text_col).alias("text")).filter("text is not null")
    made = with_bands(texts.withColumn("text_key", text_key("text")), "text", bands, rows).drop("text")
    found = made.filter(F.size("bands") > 0).groupBy("text_key").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = stored(found.withColumn("rep", F.monotonically_increasing_id()), "near-texts")
    agree = agree / (BANDS * ROWS)
    # The order within a bucket: the texts' next bands, so that neighbours share several.
    turn = lambda k: F.element_at("bands", (F.col("at") + k) % bands + 1)
    places = reps.select("rep", "sketch", "bands", F.posexplode("bands").alias("at", "bucket"))
    places = places.select("rep", "sketch", "bucket", *[turn(k).alias(f"o{k}") for k in (1, 2, 3)])
    shared = places.select("bucket").groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    buckets = stored(places.join(shared, "bucket"), "near-buckets")
    order = Window.partitionBy("bucket").orderBy("o1", "o2", "o3", "rep")
    beside = buckets.select(F.col("rep").alias("x"), F.col("sketch").alias("sx"), F.lag(F.struct("rep", "sketch")).over(order).alias("before"))
    beside = beside.filter("before is not null").select("x", "sx", F.col("before.rep").alias("y"), F.col("before.sketch").alias("sy"))
    first = agreeing(beside, agree).groupBy("x").agg(F.max(F.struct("agree", "y")).alias("top")).select("x", "top.y")
    tested = stored(first.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "near-pairs")
    members = buckets.select("bucket", "rep")
    nodes = stored(members.select("rep").distinct(), "near-nodes")
    # Copies of a wanted text meet again here: one row for each stays before the shingles are made.
    wanted = nodes.join(reps.select("rep", "text_key"), "rep")
    again = texts.withColumn("text_key", text_key("text")).join(wanted, "text_key").groupBy("rep").agg(F.first("text").alias("text"))
    size = (F.length("shingles") + F.length("counts") + 16 * bands + 256).cast("long")
    shingled = stored(with_shingles(again, "text").withColumn("size", size), "near-shingles")
    links = stored(verified(tested, shingled).select("a", "b"), "near-links")
    comp = joined(links, nodes.withColumn("comp", F.col("rep")))
    held = stored(undecided(members, comp.join(shingled.select("rep", "size"), "rep"), block, block_bytes), "near-undecided")
    forget(buckets)
    known = shingled.select("rep", "shingles", "counts", "weight").join(reps.select("rep", "bands", "sketch"), "rep")
    met = cells(held, block_bytes).join(known, "rep").groupBy("small", "part", "l", "o").applyInArrow(cell_links(agree, LEAST), "a long, b long")
    more = stored(met, "near-links")
    comp = joined(more, comp)
    for table_ in (tested, links, more, held, shingled):
        forget(table_)
    return reps.select("text_key", "rep").join(comp, "rep", "left").select("text_key", F.coalesce("comp", "rep").alias("comp"))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, class_size) for each row of ``docs``; a text without words is alone in its class."""
    texts = text_classes(docs, text_col)
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("text_key"))
    own = rows.groupBy("text_key").agg(F.min("id").alias("low"), F.count("*").alias("n")).join(texts, "text_key")
    named = own.groupBy("comp").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"))
    by_text = texts.join(named, "comp").select("text_key", "class_id", "class_size")
    found = rows.join(by_text, "text_key", "left")
    return found.select(
        F.col("id").alias(id_col), F.when(F.col("class_size").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: the one of smallest id (of equal rows any one); texts without words all stay."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    docs = stored(docs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__key", text_key(text_col)), "near-docs")
    texts = text_classes(docs, text_col)
    rows = docs.groupBy("__key").agg(F.min(F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), F.col("__row").alias("row"))).alias("first"))
    chosen = rows.join(texts.withColumnRenamed("text_key", "__key"), "__key").groupBy("comp").agg(F.min("first").alias("first"))
    keep = stored(chosen.select(F.col("first.row").alias("__row")), "near-keep")
    known = texts.select(F.col("text_key").alias("__key"))
    wordless = docs.select("__row", "__key").join(known, "__key", "left_anti").select("__row")
    return docs.join(keep.unionByName(wordless).distinct(), "__row", "left_semi").select(*columns)


@query()
def op9_neardup(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"))
