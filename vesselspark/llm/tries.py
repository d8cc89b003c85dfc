"""Prefix trie of conversations from sorted sequences and range-minimum search.

A turn is the 128-bit start of the SHA-256 of its role and text; a conversation is
the string of its turns' digests. Conversations are range-partitioned and sorted by
(digests, id), so that the members of every prefix stand together and a hot prefix
or a hot conversation spans as many partitions as it needs. Each partition holds the
longest common prefixes (LCPs) of neighbours and a sparse table of their minima. Every
candidate prefix, one for each turn that does not stand in the conversation before,
then searches the left and right ends of its interval, and of its parent's, by powers
of two, independently of all others: no stack and no order among candidates. Counts
over an interval are differences of running sums, the smallest member is another
sparse table.

A prefix whose interval touches the end of a partition is open: every partition adds
its part, and parts (as many as a partition's first and last conversations have turns)
are summed by the prefix's digest. Between partitions only the LCP of neighbours is
passed on, one number for each. Lists of ids are hashed as a stream of sorted pieces.

Rows without ``conv_id`` take no part. Null role or text is the empty one. Turns are
ordered by ``turn`` (null first), equal ones by the digest of role and text; repeated
rows are turns of their own. An empty table gives no nodes; other columns are not read.
A conversation is one row of 24 bytes a turn, texts are hashed where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vesselspark.llm.catalog import query, table
from vesselspark.session import stored

#: Turns of one partition of sorted conversations, about.
TURNS = 250_000
#: Ids in one piece of a list that spans partitions.
PIECE = 1_000
#: Open prefixes up to which they are broadcast (32 bytes each).
OPEN_ROWS = 200_000
WIDTH = 16
#: Marks a conversation that starts no common prefix, as there is none before it.
NOTHING = -1

PARTS = (
    "open boolean, node binary, up binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, part int, pieces array<string>"
)


def digest(role="role", text="text"):
    """16 bytes, in hexadecimal, of a turn's role and text."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), F.col(role), F.col(text)).cast("binary"), 256).substr(1, 2 * WIDTH)


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): ordered (turn, digest, size) of each conversation; size is the text's code points."""
    plain = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turn = F.struct("turn", digest().alias("digest"), F.length("text").cast("long").alias("size"))
    return plain.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def rebuilt(lists: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Conversations that begin with h turns of their group's first and go on with their own after h; h = crc32(id) % ``most``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = lists.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most - 1).alias("_head"))
    own = lists.withColumns({"_base": F.col("conv_id") - F.col("conv_id") % group, "_h": h})
    head = F.slice(F.coalesce("_head", F.array().cast(lists.schema["turns"].dataType)), F.lit(1), F.col("_h"))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(heads, "_base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def ordered(lists: DataFrame, n_turns: int) -> DataFrame:
    """(part, conv_id, digests, sizes), stored: range-partitioned by (digests, conv_id), ``part`` in that order."""
    spark = lists.sparkSession
    rows = lists.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("digests"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"),
    )
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_turns // TURNS))
    ranged = rows.repartitionByRange(n, "digests", "conv_id")
    return stored(ranged.withColumn("part", F.spark_partition_id()), "trie-ordered")


def common(a: bytes, b: bytes) -> int:
    """Turns at the start that two conversations share."""
    n = min(len(a), len(b)) // WIDTH
    if a[:n * WIDTH] == b[:n * WIDTH]:
        return n
    low = 0  # the first ``low`` are shared, the first n are not
    while n - low > 1:
        mid = (low + n) // 2
        if a[low * WIDTH:mid * WIDTH] == b[low * WIDTH:mid * WIDTH]:
            low = mid
        else:
            n = mid
    return low


def seams(rows: DataFrame) -> DataFrame:
    """(part, before, after): turns shared with the neighbouring partitions, -1 where there is none; one row for each."""
    ends = rows.groupBy("part").agg(F.min(F.struct("digests", "conv_id"))["digests"].alias("first"), F.max(F.struct("digests", "conv_id"))["digests"].alias("last"))
    shared = F.udf(lambda a, b: NOTHING if a is None or b is None else common(bytes(a), bytes(b)), "int")
    w = Window.orderBy("part")
    pairs = ends.select("part", F.lag("last").over(w).alias("left"), "first", "last", F.lead("first").over(w).alias("right"))
    return pairs.select("part", shared("left", "first").alias("before"), shared("last", "right").alias("after"))


class Minima:
    """Sparse table: minima of all runs whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def right(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """First place from ``start`` on with a value below ``least``, or the length."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            fits = at < len(level)
            fits[fits] = level[at[fits]] >= least[fits]
            at[fits] += 1 << k
        return at

    def left(self, stop: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Start of the longest run of values from ``least`` on that ends before ``stop``."""
        at = stop.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            fits = at >= 1 << k
            fits[fits] = level[at[fits] - (1 << k)] >= least[fits]
            at[fits] -= 1 << k
        return at

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least value of the places first..last."""
        k = np.frexp((last - first + 1).astype(float))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for level in np.unique(k):
            some = k == level
            held = self.levels[level]
            out[some] = np.minimum(held[first[some]], held[last[some] - (1 << int(level)) + 1])
        return out


def prefix_digest(conversation: bytes, depth: int) -> bytes:
    return hashlib.sha256(conversation[:depth * WIDTH]).digest()[:WIDTH]


def nodes_of_part(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes that start in one partition, parts of open ones, and pieces of their id lists."""
    rows = rows.sort_values(["digests", "conv_id"], ignore_index=True)
    keys = [bytes(k) for k in rows["digests"]]
    ids = rows["conv_id"].to_numpy(np.int64)
    part, before, after = int(rows["part"].iloc[0]), int(rows["before"].iloc[0]), int(rows["after"].iloc[0])
    n = len(keys)
    size = np.fromiter((len(k) // WIDTH for k in keys), np.int64, n)
    lcp = np.fromiter((before if not i else common(keys[i - 1], keys[i]) for i in range(n)), np.int64, n)
    following = np.append(lcp[1:], after)

    # Code points of the first turns of each conversation: total[offset[i] + d] of the first d.
    offset = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    total = np.concatenate([np.concatenate([[0], np.cumsum(np.asarray(s, np.int64))]) for s in rows["sizes"]]).astype(np.int64)
    cut = np.concatenate([[0], np.cumsum(total[offset + np.maximum(lcp, 0)])])  # shared with the one before, summed
    leaf = np.concatenate([[0], np.cumsum(following < size)])
    minima, smallest = Minima(lcp), Minima(ids)

    # Copies of one conversation stand together: where a run of them ends.
    again = np.zeros(n, bool)
    again[1:] = (lcp[1:] == size[1:]) & (lcp[1:] == size[:-1])
    starts = np.flatnonzero(~again)
    stops = np.append(starts[1:], n)
    run_stop = np.repeat(stops, stops - starts)

    # Candidates: one for each turn that the conversation before does not share.
    count = size - lcp
    at = np.repeat(np.arange(n), count)
    first = np.concatenate([[0], np.cumsum(count)])
    depth = lcp[at] + 1 + np.arange(len(at)) - first[at]
    stop = minima.right(at + 1, depth)
    opened = (stop == n) & (depth <= after)
    # The parent's interval is searched from the candidate's own place, to the left and to the right.
    up_from = minima.left(at + 1, depth - 1) - 1
    up_stop = minima.right(at + 1, depth - 1)
    up_open = (up_from < 0) | ((up_stop == n) & (depth - 1 <= after))
    up_conv = smallest.least(np.maximum(up_from, 0), up_stop - 1)

    # Children are counted at their parent's number; parents that start in an earlier partition apart, by depth.
    inner = (up_from >= 0) & (depth > 0)
    number = first[up_from] + depth - 1 - lcp[up_from] - 1
    children = np.bincount(number[inner], minlength=len(at))
    outer = np.bincount(depth[(up_from < 0) & (depth > 0)] - 1, minlength=max(before, 0) + 1)

    # Parts of nodes that go on from an earlier partition: prefixes of the first conversation.
    d = np.arange(before + 1) if before >= 0 else np.zeros(0, np.int64)
    d_stop = minima.right(np.zeros(len(d), np.int64), d)

    node_at = np.concatenate([at, np.zeros(len(d), np.int64)])
    node_depth = np.concatenate([depth, d])
    node_stop = np.concatenate([stop, d_stop])
    goes_on = np.concatenate([np.zeros(len(at), bool), np.ones(len(d), bool)])
    is_open = np.concatenate([opened, np.ones(len(d), bool)])
    own = node_at + ~goes_on  # the first member of a node shares nothing with a member before it
    above = total[offset[node_at] + np.maximum(node_depth - 1, 0)]
    parent_open = np.concatenate([up_open, np.ones(len(d), bool)]) & (node_depth > 0)
    parent_conv = np.concatenate([up_conv, np.zeros(len(d), np.int64)])

    ends, pieces, marks, ups = [], [], [], []
    nobody = hashlib.sha256(b"").hexdigest()
    for i, deep, o, p in zip(node_at.tolist(), node_depth.tolist(), is_open.tolist(), parent_open.tolist()):
        marks.append(prefix_digest(keys[i], deep) if o else None)
        ups.append(prefix_digest(keys[i], deep - 1) if p else None)
        members = ids[i:run_stop[i]] if deep == size[i] else ids[:0]
        ends.append(None if o else hashlib.sha256(",".join(map(str, members.tolist())).encode()).hexdigest() if len(members) else nobody)
        pieces.append([",".join(map(str, members[k:k + PIECE].tolist())) for k in range(0, len(members), PIECE)] if o else None)

    resolved = pd.Series(parent_conv, dtype="Int64").mask(parent_open | (node_depth == 0))
    return pd.DataFrame({
        "open": is_open, "node": marks, "up": ups, "conv_id": smallest.least(node_at, node_stop - 1), "depth": node_depth,
        "parent_conv_id": resolved, "n_convs": node_stop - node_at, "n_children": np.concatenate([children, outer[:len(d)]]),
        "n_leaves": leaf[node_stop] - leaf[node_at], "saved_tokens": cut[node_stop] - cut[own] - (node_stop - own) * above,
        "ends_sha256": ends, "part": np.int32(part), "pieces": pieces,
    })


def hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order; holds one batch at a time."""
    node, sha = None, None
    done: list[tuple[bytes, str]] = []
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != node:
                if sha is not None:
                    done.append((node, sha.hexdigest()))
                node, sha = key, hashlib.sha256(text.encode())
            else:
                sha.update(b"," + text.encode())
    if sha is not None:
        done.append((node, sha.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([v for _, v in done], pa.string())], names=["node", "ends_sha256"])


def trie(lists: DataFrame, n_turns: int) -> DataFrame:
    """One row for each node of the trie of (conv_id, turns); ``n_turns`` sizes the partitions.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (code points that members after the first share, over the subtree), ends_sha256 (ids that end here).
    """
    rows = ordered(lists, n_turns)
    found = stored(
        rows.join(F.broadcast(seams(rows)), "part").groupBy("part").applyInPandas(nodes_of_part, PARTS), "trie-nodes"
    )
    pieces = found.where("open").select("node", "part", F.posexplode("pieces").alias("piece", "ids"))
    pieces = pieces.repartition("node").sortWithinPartitions("node", "part", "piece").select("node", "ids")
    ends = pieces.mapInArrow(hash_pieces, "node binary, ends_sha256 string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    opened = found.where("open").groupBy("node", "depth").agg(F.min("up").alias("up"), F.min("conv_id").alias("conv_id"), *sums)
    opened = stored(opened.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256))), "trie-open")
    parents = opened.select(F.col("node").alias("up"), F.col("conv_id").alias("_conv"))
    if opened.count() <= OPEN_ROWS:
        parents = F.broadcast(parents)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    closed = found.where("not open")
    inner = closed.where("up is null").select(*columns)
    nodes = closed.select(*columns, "up").drop("parent_conv_id").where("up is not null").unionByName(opened.select(*[c for c in columns if c != "parent_conv_id"], "up").where("up is not null"))
    under = nodes.join(parents, "up").withColumn("parent_conv_id", F.col("_conv")).select(*columns)
    roots = opened.where("up is null").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns)
    return inner.unionByName(under).unionByName(roots)


# crc32 bit by bit: an element of -1 shifts once, others are bytes taken in.
SQL = """
WITH t AS (
  SELECT conv_id, turn, length(coalesce("text", '')) AS size,
    sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce("text", ''))[1:32] AS digest
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS k FROM t
), ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: list_prepend(ascii(c)::BIGINT, [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
      lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END
    ), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT i.conv_id, k, size, digest FROM ids i JOIN o ON o.conv_id = i.base AND k <= h
  UNION ALL SELECT i.conv_id, k, size, digest FROM ids i JOIN o ON o.conv_id = i.conv_id AND k > h
), m AS (
  SELECT conv_id, row_number() OVER w AS d, size, sha256(string_agg(digest, '') OVER w) AS p FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids
), a AS (
  SELECT *, lag(p) OVER w AS up, lead(d) OVER w IS NULL AS ends FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY d)
), n AS (
  SELECT p, any_value(d) AS d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM a GROUP BY p
), c AS (
  SELECT up AS p, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up
), s AS (
  SELECT a.p, count(*) FILTER (WHERE c.p IS NULL) AS n_leaves, sum((v.n_convs - 1) * v.size) AS saved_tokens
  FROM n v JOIN a ON a.conv_id = v.conv_id AND a.d <= v.d LEFT JOIN c ON c.p = v.p GROUP BY a.p
)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.p = n.p LEFT JOIN c ON c.p = n.p LEFT JOIN n u ON u.p = n.up
"""


@query(SQL)
def op12_tries(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return trie(rebuilt(turn_lists(conversations)), conversations.count())
