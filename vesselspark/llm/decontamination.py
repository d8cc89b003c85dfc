"""Benchmark passages in documents: Wu-Manber search for many word windows at once.

Words are runs of bytes other than ASCII punctuation, space and control
characters, with A-Z lower-cased. A window is ``WINDOW`` consecutive words of an
item; an item of fewer words is one window.

The shift table maps a block of two words to the distance that the search may
move on: the least distance from the block to the end of the first m words of any
pattern, or m - 1 for a block that no pattern holds. At shift 0 the bucket of the
suffix block (split by the first word) names the patterns to compare directly.
Patterns are searched in classes of similar length, so that one short item does
not shorten the shifts of all.

Patterns reach the tasks in packs of at most ``PACK`` windows, one pass over the
documents for each, so no broadcast grows with the benchmark. Nulls and texts
without words have no hits; repeated rows are judged one by one; an item without
id marks words but is not listed; an empty table of items hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselspark.llm.batches import with_columns
from vesselspark.llm.catalog import query, table
from vesselspark.session import stored

WINDOW = 10
#: Windows in one broadcast pack.
PACK = 200_000
BLOCK = 2

_SEPARATE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_SEPARATE).split() if text else []


class WuManber:
    """Shift and bucket tables over words; ``find`` gives (start, length, ids)."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        classes: dict[int, list[tuple[bytes, ...]]] = {}
        for p in patterns:
            classes.setdefault(len(p).bit_length(), []).append(p)
        self.ids = patterns
        self.classes = []
        for members in classes.values():
            m = min(map(len, members))
            b = min(BLOCK, m)
            shift: dict[tuple[bytes, ...], int] = {}
            buckets: dict[tuple[bytes, ...], dict[bytes, set]] = {}
            for p in members:
                for end in range(b, m + 1):
                    block = p[end - b:end]
                    shift[block] = min(shift.get(block, m), m - end)
                buckets.setdefault(p[m - b:m], {}).setdefault(p[0], set()).add(p)
            self.classes.append((m, b, shift, buckets))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        n = len(words)
        for m, b, shift, buckets in self.classes:
            jump = m - b + 1
            look = shift.get
            i = m - 1
            while i < n:
                block = (words[i - 1], words[i]) if b == 2 else (words[i],)
                step = look(block, jump)
                if step:
                    i += step
                    continue
                start = i - m + 1
                for p in buckets[block].get(words[start], ()):
                    if tuple(words[start:start + len(p)]) == p:
                        yield start, len(p), self.ids[p]
                i += 1


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlap or touching ends."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def windows_of(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(window, id): each distinct window of each item."""

    def cut():
        def work(texts):
            found = []
            for text in texts:
                w = words_of(text)
                size = min(WINDOW, len(w))
                found.append(sorted({b" ".join(w[i:i + size]) for i in range(len(w) - size + 1)}) if w else [])
            return [found]

        return work

    ids = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return (
        with_columns(ids, ["text"], [("windows", "array<binary>")], cut)
        .select(F.explode("windows").alias("window"), "id").distinct()
    )


def packs(windows: DataFrame, most: int) -> Iterator[dict[tuple[bytes, ...], list[str]]]:
    """Bounded parts of the windows, brought to the driver one at a time."""
    pack: dict[tuple[bytes, ...], list[str]] = {}
    held = 0
    for window, item in windows.toLocalIterator():
        ids = pack.setdefault(tuple(bytes(window).split(b" ")), [])
        if item is not None:
            ids.append(item)
        held += 1
        if held >= most:
            yield pack
            pack, held = {}, 0
    if pack:
        yield pack


def find_passages(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", pack: int = PACK) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (word positions, end exclusive, merged) and ``hit_items`` (ids as strings)."""
    spark = docs.sparkSession
    out = None
    fields = [("n_words", "long"), ("hit_spans", "array<struct<start:int,end:int>>"), ("hit_items", "array<string>")]
    for part in packs(windows_of(items, item_id, item_text), pack) if items is not None else ():
        shared = spark.sparkContext.broadcast(part)

        def search(shared=shared):
            machine = WuManber(shared.value)

            def work(texts, spans=None, names=None):
                counts, covered, listed = [], [], []
                for k, text in enumerate(texts):
                    w = words_of(text)
                    hits, seen = [], set()
                    for start, size, ids in machine.find(w):
                        hits.append((start, start + size))
                        seen.update(ids)
                    if spans is not None:
                        hits += [(s["start"], s["end"]) for s in spans[k]]
                        seen.update(names[k])
                    counts.append(len(w))
                    covered.append([{"start": s, "end": e} for s, e in merged(hits)] if hits else [])
                    listed.append(sorted(seen))
                return [counts, covered, listed]

            return work

        if out is None:
            out = with_columns(docs, [text_col], fields, search)
        else:
            out = with_columns(stored(out, "passages"), [text_col, "hit_spans", "hit_items"], fields, search)
    if out is None:
        def count():
            return lambda texts: [[len(words_of(t)) for t in texts], [[] for _ in texts], [[] for _ in texts]]

        out = with_columns(docs, [text_col], fields, count)
    return out


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'"
_LIST = rf"regexp_extract_all(translate(coalesce(text,''),{_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, {_LIST} AS w FROM documents),
b AS (SELECT item_id, {_LIST} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size,
         array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win
       FROM (SELECT *, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i
             FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query(SQL)
def op4_decontamination(spark, sf_dir):
    found = find_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
