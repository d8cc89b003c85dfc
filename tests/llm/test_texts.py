"""Operators on single texts: decontamination, byte pairs, personal data, toxicity, languages."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vesselspark.llm import bpe, decontamination, language, pii, toxicity

DOCS = "doc_id long, text string, n_words string, spans string"


def frame(spark, texts, extra="x"):
    """Documents with repeated rows and columns whose names clash with results."""
    return spark.createDataFrame([(i, t, extra, extra) for i, t in enumerate(texts)], DOCS)


# ---- decontamination


def brute_hits(text, items):
    words = decontamination.words_of(text)
    spans, ids = set(), set()
    for item, t in items:
        w = decontamination.words_of(t)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for j in range(len(words) - size + 1):
                if words[j:j + size] == w[i:i + size]:
                    spans |= set(range(j, j + size))
                    ids.add(str(item))
    return len(words), len(spans), sorted(ids)


def test_passages_match_brute_force_in_one_pack_and_in_many(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "Ab", "é", "x1"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 5, 9, 10, 11, 14, 30])] + [(20, None), (21, "..."), (3, "a b x1 a b")]
    texts = [None, "", " .,! ", *(" - ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(40)), "z " * 30_000 + items[8][1]]
    docs = frame(spark, [*texts, texts[5]])
    table = spark.createDataFrame(items, "item_id long, text string")
    for pack in (10_000, 7):
        got = decontamination.find_passages(docs, table, pack=pack).orderBy("doc_id").collect()
        for r in got:
            n, hit, ids = brute_hits(r["text"], [i for i in items if i[1]])
            assert (r["n_words"], sum(s["end"] - s["start"] for s in r["hit_spans"]), list(r["hit_items"])) == (n, hit, ids)
    assert decontamination.find_passages(docs, table.limit(0)).filter(F.size("hit_spans") > 0).count() == 0
    assert decontamination.find_passages(docs.limit(0), table).count() == 0


# ---- byte pairs


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_ids_and_text_equal_the_library(spark, library):
    path, lib = library
    rng = random.Random(2)
    letters = " \n\t'stlaéß12<.  　日‍"
    texts = [None, "", " ", "a" * 3000, "<|endoftext|> x<|endoftext|>", "  a  b \n\n c 's'll\x1c", "ab" * 500, *("".join(rng.choice(letters) for _ in range(80)) for _ in range(200))]
    docs = frame(spark, [*texts, texts[8]])
    rows = bpe.decode(bpe.encode(docs, path), path).collect()
    digests = {r["doc_id"]: r for r in bpe.digests(docs, path).collect()}
    for r in rows:
        want = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)
        assert r["decoded"] == lib.decode(want, skip_special_tokens=False) == (r["text"] or "")
        assert digests[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert bpe.encode(docs.limit(0), path).count() == 0


def test_round_trips_in_one_pass(spark, library):
    path, _ = library
    texts = [None, "", " a\n", "caf\u00e9 <|endoftext|>", "\U0001f600 ab" * 40, "x\u0301 y"]
    docs = frame(spark, texts)
    want = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    got = bpe.round_trips(docs, path)
    assert got.columns == ["doc_id", "n_words", "spans", "token_ids", "n_tokens", "round_trip"]
    for r in got.collect():
        w = want[r["doc_id"]]
        assert (r["token_ids"], r["n_tokens"], r["round_trip"]) == (w["token_ids"], w["n_tokens"], w["decoded"] == (w["text"] or ""))
    assert got.count() == len(texts) and bpe.round_trips(docs.limit(0), path).count() == 0


def test_stages_of_the_pipeline_run_one_python_worker_a_task(spark):
    """Workers that feed each other in one stage all stay in an executor's memory."""
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a b", "aa", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    spans = f"array<{pii.SPAN}>"
    found = docs.withColumns({"spans": F.array().cast(spans), "base_spans": F.array().cast(spans)})
    for df in (corpus_pipeline.encode_tokens(spark, docs, ""), pii.redact(found)):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert pii.redact(found).columns == docs.columns


def test_forgetting_pieces_changes_nothing(library, monkeypatch):
    vocab = bpe.vocabulary(library[0])
    texts = ["the quick brown fox", "the slow brown ox", "quick quick"]
    want = bpe.Encoder(vocab).encode(texts)
    monkeypatch.setattr(bpe, "PIECES", 0)
    encoder = bpe.Encoder(vocab)
    assert [encoder.encode([t])[0] for t in texts] == want


def test_ids_that_are_not_text_decode_as_in_the_library(library):
    path, lib = library
    encoder = bpe.Encoder(bpe.vocabulary(path))
    rng = random.Random(3)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert encoder.decode(np.array(ids, "<u4").tobytes()).decode() == lib.decode(ids, skip_special_tokens=False)


# ---- personal data

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub(r"\D", "", s)) <= 19 and pii.luhn(re.sub(r"\D", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub(r"[^0-9]", "", s)) <= 15),
]


def brute_spans(text):
    return [(k, *m.span()) for k, rx, ok in BASE for m in re.finditer(rx, text or "") if ok(m.group())]


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab@.1.2-+ ()9_%é") for _ in range(60)) for _ in range(4000)]
    texts += ["".join(rng.choice("0123456789. -+") for _ in range(80)) for _ in range(4000)]
    texts += ["1" * 4000, "a" * 4000 + "@", "a@b.c" * 2000, "4532015112830366 " * 50, "+1 (212) 555-0100", "001.002.3.4"]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t)
    assert pii.base_spans(None) == pii.base_spans("") == []


def test_contexts_of_seeds_find_other_identifiers(spark):
    known = [f"write me at user{i}@mail{i}.example.com soon" for i in range(12)]
    hidden = ["write me at user_at_home99 soon", "number 12345 stands alone"]
    docs = frame(spark, [None, "", *known, *hidden, hidden[0]])
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert [s["kind"] for s in got[2]["spans"]] == ["email"]
    for i in (14, 16):
        assert [(s["kind"], got[i]["text"][s["start"]:s["end"]]) for s in got[i]["spans"]] == [("email", "user_at_home99")]
        assert got[i]["base_spans"] == []
    assert got[15]["spans"] == [] and got[0]["spans"] == []
    masked = {r["doc_id"]: r["text"] for r in pii.redact(pii.find(docs.drop("spans"))).collect()}
    assert masked[14] == "write me at <EMAIL> soon" and masked[15] == hidden[1] and masked[0] is None
    assert pii.find(docs.limit(0)).count() == 0


# ---- toxicity


def test_words_are_learned_from_document_labels_and_located(spark):
    rng = random.Random(6)
    plain = [f"w{i}" for i in range(60)]
    letters = dict(zip(plain, ("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in plain)))
    sentence = lambda bad="": " ".join(rng.choice(list(letters.values())) for _ in range(8)) + bad + "."
    rows = []
    for i in range(400):
        y = i % 4 == 0
        parts = [sentence() for _ in range(rng.randint(2, 9))]
        if y:
            parts[rng.randrange(len(parts))] = sentence(rng.choice([" nasty", " vileone", " viletwo"]))
        rows.append((i, " ".join(parts), int(y)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(1000, None, "x"), (1001, "", "x"), (1002, "nasty " * 20_000, "x")], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:300]] + [(5000, 1), (None, 1), (301, None)], "doc_id long, toxic int")
    model = toxicity.trained(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([(got[i]["toxicity"] >= 0.5) == bool(y) for i, _, y in rows[300:]]) == 1.0
    for i, text, y in rows[300:]:
        if y:
            at = [k for k, s in enumerate(toxicity.sentences(text)) if "nasty" in s or "vile" in s]
            assert [h["sentence"] for h in got[i]["offending"]] == at
    assert got[1000]["toxicity"] == got[1001]["toxicity"] < 0.5 < got[1002]["toxicity"]
    assert toxicity.score(docs.limit(0), model).count() == 0
    blank = toxicity.trained(docs, labels.limit(0))
    assert toxicity.score(docs, blank).filter("toxicity > 1e-6").count() == 0


# ---- languages


def brute_marginals(x, first, step):
    """Sum over all label sequences."""
    from itertools import product

    t, k = x.shape
    total = np.zeros((t, k))
    for path in product(range(k), repeat=t):
        p = first[path[0]] * np.prod([x[i, y] for i, y in enumerate(path)]) * np.prod([step[a, b] for a, b in zip(path, path[1:])])
        for i, y in enumerate(path):
            total[i, y] += p
    return total / total.sum(1, keepdims=True)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    x, first, step = rng.uniform(0.1, 1, (3, 5, 3)), rng.uniform(0.1, 1, 3), rng.uniform(0.1, 1, (3, 3))
    sizes = np.array([5, 3, 1])
    for got in (language.forward_backward(x, sizes, first, step)[0], language.smoothed(x, sizes, first, step)):
        for i, n in enumerate(sizes):
            assert np.allclose(got[i, :n], brute_marginals(x[i, :n], first, step))


def test_languages_and_switches(spark):
    rng = random.Random(8)
    stems = {"aa": ["the", "thing", "oning", "wash"], "bb": ["der", "ungen", "keit", "schen"]}
    text = lambda y, n=30: " ".join(rng.choice(stems[y]) for _ in range(n))
    rows = [(i, text(y), y, "x") for i, y in enumerate(["aa", "bb"] * 40)]
    odd = [(100, None, None, "x"), (101, "", "aa", "x"), (102, "12 !?", "aa", "x"), (103, text("bb", 20_000), None, "x"), (104, text("aa") + " " + text("bb"), None, "x"), (105, "²³", None, "x")]
    docs = spark.createDataFrame(rows + odd + rows[:2], "doc_id long, text string, lang string, lang_pred string")
    model = language.trained(docs)
    got = {r["doc_id"]: r for r in language.detect(docs, model).collect()}
    assert all(got[i]["lang_pred"] == y and 0.5 < got[i]["lang_score"] <= 1 for i, _, y, _ in rows)
    assert [got[i]["lang_pred"] for i in (100, 101, 102, 105)] == ["und"] * 4 and got[103]["lang_pred"] == "bb"
    runs = language.label_words(docs.filter("doc_id = 104"), model).first()["lang_runs"]
    assert [r["lang"] for r in runs] == ["aa", "bb"] and abs(runs[0]["end"] - 30) <= 1
    none = language.trained(docs.limit(0))
    assert {r["lang_pred"] for r in language.detect(docs, none).collect()} == {"und"}
    assert language.detect(docs.limit(0), model).count() == 0


def test_long_and_empty_texts_take_no_language_out_of_the_sample(spark):
    rng = random.Random(9)
    stems = {"aa": ["the", "thing", "oning", "wash"], "bb": ["der", "ungen", "keit", "schen"], "cc": ["que", "cion", "mente", "llor"]}
    text = lambda y, n=30: " ".join(rng.choice(stems[y]) for _ in range(n))
    rows = [(i, text(y), y) for i, y in enumerate(["aa", "bb", "cc"] * 20)]
    # The smallest ids by hash of a language are a text beyond the bound in all, or have no letters.
    ranked = [r["id"] for r in spark.range(1000, 5000).orderBy(F.xxhash64("id")).limit(230).collect()]
    book = "12 " * 9000 + text("bb", 700_000)
    odd = [(ranked[0], book, "bb"), *[(i, None, "cc") for i in ranked[1:116]], *[(i, "12 !?", "cc") for i in ranked[116:]]]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    found = language.sample(docs)
    assert {y: sum(z == y for _, z in found) for y in stems} == {"aa": 20, "bb": 21, "cc": 20}
    assert max(len(t) for t, _ in found) == language.SAMPLE_CHARS // language.SAMPLE
    assert len(language.sample(docs, most=5, chars=50)) == 15 and max(len(t) for t, _ in language.sample(docs, most=5, chars=50)) == 10
    got = {r["doc_id"]: r["lang_pred"] for r in language.detect(docs, language.trained(docs)).collect()}
    assert all(got[i] == y for i, _, y in rows) and got[ranked[0]] == "bb"
