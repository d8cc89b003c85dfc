"""Pieces of merge-type vocabularies, conversation tries, spelling variants."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vesselspark.llm import pieces, spelling, tries

# ---- pieces


def test_pieces_equal_the_library(spark):
    path = pieces.default_path()
    lib = pieces.vocabulary(path).library
    rng = random.Random(3)
    letters = "ab te\n\t▁é日 \0ﬁ.,<s>\x1c　"
    texts = [None, "", " ", "  a", "a ", "\n", "▁", "<s>x</s><0x41>", "ab" * 4000, " " * 3000 + "x", "the " * 2000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate([*texts, texts[-1]])], "doc_id long, text string, agrees string, other string")
    digests = {r["doc_id"]: r for r in pieces.digests(docs, path).collect()}
    rows = pieces.decode(pieces.encode(docs, path), path).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = lib.encode(r["text"] or "")
        assert list(r["piece_ids"]) == want and r["n_tokens"] == len(want) and r["agrees"] is True and r["other"] == "y"
        assert r["decoded"] == lib.decode(want)
        d = digests[r["doc_id"]]
        assert d["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert d["decoded_sha256"] == hashlib.sha256(lib.decode(want).encode()).hexdigest() and d["n_tokens"] == len(want)
    assert pieces.decode(pieces.encode(docs.limit(0), path), path).count() == 0


def test_any_ids_decode_as_in_the_library():
    vocab = pieces.vocabulary(pieces.default_path())
    encoder = pieces.Encoder(vocab)
    rng = random.Random(4)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(262), rng.randrange(3)]) for _ in range(rng.randint(0, 12))]
        want = vocab.library.decode(ids)
        assert vocab.decode(ids) == want and encoder.decode(list(map(str, ids))).decode() == want


def test_both_agendas_take_the_same_pairs():
    vocab = pieces.vocabulary(pieces.default_path())
    rng = random.Random(5)
    for n in [0, 1, 2, *range(3, 120)]:
        part = "".join(rng.choice("aeinrst▁") for _ in range(n))
        assert vocab.short(part) == vocab.long(part)


# ---- tries


def plain_trie(rows, rebuild):
    """Nodes by walking every prefix of every conversation."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(conv, []).append((turn is not None, turn or 0, mark, len(text)))
    own = {c: [(m, n) for _, _, m, n in sorted(t)] for c, t in own.items()}
    convs = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        convs[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + t[h:] if rebuild else t  # as SQL rounds: -3 belongs to 0
    members = {}
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    out = []
    for p, cs in members.items():
        under = [q for q in members if q[:len(p)] == p]
        kids = [q for q in under if len(q) == len(p) + 1]
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(p))))
        out.append((
            min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids),
            sum(not any(r[:len(q)] == q and len(r) > len(q) for r in under) for q in under),
            sum((len(members[q]) - 1) * (q[-1][1] if q else 0) for q in under), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def nodes(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


TURNS = "conv_id long, turn long, role string, text string, digests string, part string"


@pytest.mark.parametrize("rebuild", [True, False])
def test_trie_equals_walk_over_all_prefixes(spark, rebuild):
    rng = random.Random(6)
    rows = []
    for c in [*range(40), *range(100, 130), 250, 251, 300]:  # 251 has no first conversation but 250 is none of a hundred either
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", None, ""]), rng.choice(["a", "bé", "", None])))
    rows += [(7, None, "user", "late"), (8, 0, "user", "a"), (8, 0, "user", "a"), (None, 0, "user", "x"), (-3, 0, "x", "日本")]
    frame = spark.createDataFrame([(*r, "extra", "extra") for r in rows], TURNS)
    lists = tries.turn_lists(frame)
    got = nodes(tries.trie(tries.rebuilt(lists) if rebuild else lists, len(rows)))
    assert got == plain_trie(rows, rebuild)
    assert got == nodes(tries.trie(tries.rebuilt(lists) if rebuild else lists, 40 * tries.TURNS))  # many small partitions


def test_trie_of_copies_that_span_partitions(spark):
    rows = [(c, t, "user", f"text {t}") for c in range(3000) for t in range(2)] + [(c, 2, "user", "more") for c in range(0, 3000, 500)]
    rows += [(5000, t, "user", str(t) * 9) for t in range(400)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["depth"]: r for r in tries.trie(tries.turn_lists(frame), 12 * tries.TURNS).where("conv_id < 5000").collect()}
    assert set(got) == {0, 1, 2, 3} and got[0]["n_convs"] == 3001 and got[0]["n_leaves"] == 2 and got[2]["n_children"] == 1
    left = ",".join(str(c) for c in range(3000) if c % 500)
    assert got[2]["ends_sha256"] == hashlib.sha256(left.encode()).hexdigest() and got[2]["n_convs"] == 3000
    assert got[2]["saved_tokens"] == 2999 * 6 + 5 * 4 and got[1]["saved_tokens"] == 2 * 2999 * 6 + 5 * 4
    assert tries.trie(tries.turn_lists(frame.limit(0)), 0).count() == 0


# ---- spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(words):
    out = {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = [best if near and words[best] >= 5 * n else None, n, len(near)]
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w].append(root)
    return sorted((w, f, r, n, k, words[f] if f else None) for w, (f, n, k, r) in out.items())


def test_variants_equal_all_pairs(spark):
    rng = random.Random(7)
    words = {"".join(rng.choice("abÿ") for _ in range(rng.randint(6, 8))): rng.choice([5, 6, 25, 30, 125, 700, 3200]) for _ in range(900)}
    words |= {"a" * 60: 5, "a" * 61: 50, "a" * 62: 400, "b" + "a" * 60: 50}
    frame = spark.createDataFrame([(w, n) for w, n in words.items()], "word string, n long")
    cols = ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted(tuple(r) for r in spelling.variants(frame).select(*cols).collect())
    assert got == plain_variants(words) and any(f and r != f for _, f, r, *_ in got)
    assert spelling.variants(frame.limit(0)).count() == 0


def test_counts_of_whole_texts(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcÀé×Z") for _ in range(rng.randint(1, 9)))
    texts = [None, "", " .,1 ", "Straße日本Größe", *(" -1日".join(word() for _ in range(rng.randint(1, 400))) for _ in range(30)), "aBcDeFg " * 50_000]
    rows = [(i, t, "x", 1) for i, t in enumerate([*texts, texts[5]])] + [(None, "without an identifier", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    for damage in (0, 7):
        want = Counter()
        for doc, text, *_ in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                if damage and h % damage == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                if len(run) >= 6:
                    want[run] += 1
        got = spelling.counted(docs, damage=damage)
        assert {r["word"]: r["n"] for r in got.collect()} == dict(want)
    assert spelling.counted(docs.limit(0)).where(F.col("n") > 0).count() == 0


def test_damaged_run_may_equal_another_run_of_its_document(spark):
    damage = 3
    hurt = lambda doc, run: (h := zlib.crc32(f"{doc}:{run}".encode())) % damage == 0 and run[:h % len(run)] + run[h % len(run) + 1:]
    rng = random.Random(9)
    rows, want = [], Counter()
    while len(rows) < 20:
        doc, run = len(rows), "".join(rng.choice("abÿ") for _ in range(9))
        if (once := hurt(doc, run)) and (twice := hurt(doc, once)):
            rows.append((doc, f"{run} {once} {once}"))  # the longer run first: its result is damaged itself
            want.update([once, twice, twice])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["word"]: r["n"] for r in spelling.counted(docs, damage=damage).collect()} == dict(want)
