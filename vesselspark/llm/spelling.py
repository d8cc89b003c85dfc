"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the usual form of each.

A word is a maximal run of Latin letters, A-Z lower-cased, of at least ``LETTERS``
code points and ``TIMES`` occurrences. Of two words, the one that is not longer
contributes two disjoint chunks, its halves; the other contributes positional grams.
One edit spares a chunk: the first half then stands at the start of the other word, the
second half at its end, that is shifted by the difference in length, at most one. Grams
that no chunk can meet within that shift are not sent. Chunk and gram meet in an
equi-join on length, half and letters, and the edit distance verifies each pair. A pair
whose halves both stand is kept for the first one only, so that no pair arises twice.

The join is left to skew handling: a frequent half spreads over tasks, and nothing
is capped. Counts are added up in each task, then by word; roots come by pointer
doubling over the table of forms, as a form is at least ``RATIO`` times as frequent as
its variant and chains are short.

Null and empty texts have no words; a null ``doc_id`` counts as the empty one; repeated
rows count each time; ties in frequency go to the smaller word in code-point order; an
empty table gives no words. Other columns are not read. Texts are read whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselspark.llm.batches import chunks
from vesselspark.llm.catalog import query, table
from vesselspark.session import stored

LETTERS = 6
TIMES = 5
RATIO = 5
#: One occurrence in so many loses a letter; 0: none.
DAMAGE = 199
#: Words that a task counts before it sends them on.
HELD = 400_000

# Latin letters of one byte each, A-Z lower-cased; everything else parts words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split() if text else []


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, damage: int = 0) -> DataFrame:
    """(word, n) of the words of at least ``letters`` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            made = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for whole in batches:
            for batch in chunks(whole, [1]):
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = Counter([r for r in runs(text) if len(r) >= letters])
                    if damage:
                        start = zlib.crc32(f"{doc}:".encode())
                        # Counted apart: a damaged run may equal another run of its document.
                        left: Counter[bytes] = Counter()
                        for word, n in found.items():
                            h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                            left[word if h % damage else word[:(at := h % len(word))] + word[at + 1:]] += n
                        found = left
                    held.update(found)
                if len(held) > HELD:
                    yield sent()
        yield sent()

    few = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    sums = few.mapInArrow(run, "word string, n long").where(F.length("word") >= letters)
    return sums.groupBy("word").agg(F.sum("n").alias("n"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each unordered pair of distinct words one inserted, deleted or replaced letter apart, once."""
    w = words.select("word", "n", F.length("word").alias("size"))
    half = F.floor(F.col("size") / 2).cast("int")
    chunk = w.select(
        F.col("word").alias("a"), F.col("n").alias("a_n"), "size",
        F.explode(F.array(
            F.struct(F.lit(1).alias("half"), F.col("word").substr(F.lit(1), half).alias("letters")),
            F.struct(F.lit(2).alias("half"), F.col("word").substr(half + 1, F.col("size") - half).alias("letters")),
        )).alias("c"),
    ).select("a", "a_n", "size", "c.*")
    grams = []
    for shift in (0, 1):
        size = F.col("size") - shift  # of the word that the gram may meet
        at = F.floor(size / 2).cast("int")
        grams += [
            F.struct(size.alias("size"), F.lit(1).alias("half"), F.col("word").substr(F.lit(1), at).alias("letters")),
            F.struct(size.alias("size"), F.lit(2).alias("half"), F.col("word").substr(at + 1 + shift, F.col("size")).alias("letters")),
        ]
    gram = w.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.explode(F.array(*grams)).alias("g")).select("b", "b_n", "g.*")
    same_start = F.expr("startswith(b, substr(a, 1, size div 2))")
    first_met = (F.col("half") == 1) | ~same_start
    one_way = (F.length("b") > F.col("size")) | (F.col("a") < F.col("b"))
    met = chunk.join(gram, ["size", "half", "letters"]).where(one_way & first_met & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n")


def followed(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of (word, form)."""
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        new = at.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        new = stored(new, "spelling-roots")
        if new.where("_moved").isEmpty():
            return new.drop("_moved")
        at = new.drop("_moved")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of (word, n).

    form: the near word of largest n (ties: the smaller word), if that is at least ``ratio`` times the word's.
    """
    words = stored(words, "spelling-words")
    both = near_pairs(words).select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("m"))
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("m.k") >= ratio * F.col("n"), F.struct(F.col("m.near").alias("form"), (-F.col("m.k")).alias("form_n"))).alias("f"),
    ).select("word", "n", "n_near", "f.form", "f.form_n")
    found = stored(found, "spelling-forms")
    roots = followed(found.where("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


# crc32 bit by bit: an element of -1 shifts once, others are bytes taken in.
SQL = """
WITH RECURSIVE r AS (
  SELECT doc, run, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc,
      unnest(regexp_extract_all(translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
    FROM documents
  ) WHERE length(run) >= 6 GROUP BY doc, run
), h AS (
  SELECT run, n, xor(list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(flatten(list_transform(string_split(doc || ':' || run, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)),
      lambda b: list_prepend(b::BIGINT, [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END
  ), 4294967295) AS h FROM r
), w AS (
  SELECT word, sum(n)::BIGINT AS n, length(word) AS size FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h
  ) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), d AS (
  SELECT word, size, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, size + 1))::INT AS i FROM w)
), p AS (
  SELECT a.word, b.word AS near FROM d a JOIN d b ON a.size = b.size AND a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, rest FROM d SEMI JOIN w v ON v.word = d.rest
  UNION SELECT rest, word FROM d SEMI JOIN w v ON v.word = d.rest
), b AS (
  SELECT p.word, near, v.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, near) AS k
  FROM p JOIN w v ON v.word = p.near
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN b ON b.word = w.word AND k = 1
), c AS (
  SELECT word, word AS root, form AS next FROM f
  UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.next
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word AND c.next IS NULL
"""


@query(SQL)
def op13_spelling(spark, sf_dir):
    words = counted(table(spark, sf_dir, "documents"), damage=DAMAGE).where(F.col("n") >= TIMES)
    return variants(words)
