"""Operators over many rows: urls, neighbours, language model, repeats, near copies, pipeline."""

import collections
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from vesselspark.llm import lm, neardup, neighbours, substrings, urls

# ---- urls


def test_parts_and_rules(spark):
    rows = [
        ("https://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        ("http://example.com/de", "example.com", "/de", "com/", "allow"), ("x://b.net/fr/1://", "b.net", "/fr/1://", "net/fr/", "block"),
        ("http://notcom", "notcom", "", None, None), ("http://example.com?en/", "example.com", "", None, None),
        ("no scheme", "", "", None, None), (None, "", "", None, None), ("http://com/", "com", "/", "com/", "allow"),
    ]
    pages = spark.createDataFrame([(i, r[0], "x") for i, r in enumerate(rows)], "page_id long, url string, host string")
    got = urls.with_rules(urls.with_parts(pages)).orderBy("page_id").collect()
    assert [(r["url"], r["host"], r["path"], r["rule"], r["rule_verdict"]) for r in got] == rows


def brute_rank(edges, seed, damping=urls.DAMPING):
    hosts = sorted({h for e in edges for h in e[:2]} | set(seed))
    out = collections.Counter()
    for a, _, n in edges:
        out[a] += n
    score, total = dict(seed), sum(seed.values())
    for _ in range(300):
        got = collections.Counter()
        for a, b, n in edges:
            got[b] += score.get(a, 0) * n / out[a]
        back = (total - sum(got.values())) / total
        score = {h: damping * got[h] + seed.get(h, 0) * (1 - damping + damping * back) for h in hosts}
    return score


def test_ranks_equal_plain_iteration(spark):
    rng = random.Random(1)
    hosts = [f"h{i}" for i in range(12)]
    edges = sorted({(a, b): (a, b, rng.randint(1, 4)) for a, b in (rng.sample(hosts, 2) for _ in range(25))}.values())
    seeds = [("h0", 1.0, 0.0), ("h1", 0.25, 0.75), ("h2", 0.0, 1.0), ("alone", 0.0, 1.0)]
    got = urls.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, trust double, distrust double"), damping=0.5, tolerance=1e-6)
    trust = brute_rank(edges, {h: t for h, t, _ in seeds if t}, 0.5)
    distrust = brute_rank([(b, a, n) for a, b, n in edges], {h: d for h, _, d in seeds if d}, 0.5)
    for r in got.collect():
        assert math.isclose(r["trust"], trust.get(r["host"], 0), abs_tol=1e-5) and math.isclose(r["distrust"], distrust.get(r["host"], 0), abs_tol=1e-5)


def test_hosts_that_link_to_blocked_hosts_are_blocked(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    rows = [
        (1, "http://bad.net/es/", ""), (2, "http://near.org/a", link("bad.net", "BAD.net")), (3, "http://far.org/", link("good.com")), (4, "http://good.com/", link("liked.org")),
        (5, "http://liked.org/", None), (6, None, link("bad.net")), (7, "http://bad.net/de/", "<a href='/es/'>"), (7, "http://bad.net/de/", ""),
    ]
    got = urls.judge(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, verdict string"))
    found = collections.Counter((r["page_id"], r["verdict"]) for r in got.collect())
    assert found == {(1, "block"): 1, (2, "block"): 1, (3, "allow"): 1, (4, "allow"): 1, (5, "allow"): 1, (6, "allow"): 1, (7, "block"): 2}
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- neighbours


def test_hilbert_keys_are_a_walk_over_all_cells():
    for d, bits in ((2, 3), (3, 2), (1, 4)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), -1).reshape(-1, d)
        key = neighbours.hilbert_keys(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def brute_near(rows, q, k):
    v = dict(rows)[q]
    d = sorted((float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, x in rows if i != q)
    return d[:k]


def test_neighbours_with_ties_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, np.float32(rng.normal(size=6)).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)]
    odd = [(400, None), (500, [0.0] * 6), (600, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (700, [float("nan")] * 6), (800, [1.0]), (rows[3][0], rows[3][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, rank string")
    asks = spark.createDataFrame([(i,) for i in (0, 7, 100, 305, 339, 400, 500, 600, 700, 800, 999)], "vec_id long")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, asks, n_curves=4, window=400).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert set(got) == {0, 7, 100, 305, 339}
    for q, found in got.items():
        want = brute_near(rows, q, 10)
        assert [i for _, i in found] == [i for _, i in want] and np.allclose([s for s, _ in found], [s for s, _ in want])
    few = neighbours.nearest(df.filter("vec_id in (1, 2, 3)"), asks.limit(0).union(spark.createDataFrame([(1,)], "vec_id long"))).collect()
    assert sorted(r["vec_id"] for r in few) == [2, 3]
    assert neighbours.nearest(df.limit(0), asks).count() == 0


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(9)
    x = np.float32(rng.normal(size=(4000, 32)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = neighbours.nearest(df, df.filter("vec_id % 100 = 0").select("vec_id"), window=400).collect()
    near = collections.defaultdict(set)
    for r in found:
        near[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, 4000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(near[q] & set(np.argsort(d)[:10].tolist()))
    assert hits / 400 >= 0.9


def test_nothing_beyond_the_windows_is_lost(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.float32(rng.normal(size=(3000, 16)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(neighbours, "PACK", 16 * 20)  # several passes
    for window in (2, 40):  # fewer than k candidates in all, and a small part of the table
        got = collections.defaultdict(list)
        for r in neighbours.nearest(df, df.filter("vec_id % 60 = 0").select("vec_id"), n_curves=1, window=window).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append(r["vec_id"])
        assert set(got) == set(range(0, 3000, 60))
        for q, found in got.items():
            d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
            d[q] = np.inf
            assert found == np.argsort(d)[:10].tolist()


# ---- language model


def test_base_scores_counts_and_both_ways_of_probing(spark):
    rng = random.Random(2)
    texts = [None, "", " \n", "A a a" * 3000, *(" ".join(rng.choice(["a", "B", "cc\u00a0d", "é", f"r{rng.randint(0, 40)}"]) for _ in range(rng.randint(1, 60))) for _ in range(80))]
    rows = [(i, t, i % 5 == 0, "x") for i, t in enumerate(texts)] + [(7, texts[7], False, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean, score string")
    got = lm.score(docs, F.col("held")).orderBy("doc_id", "score").collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + ["\n"]
    c = collections.Counter(w for _, t, h, _ in rows if not h for w in words(t))
    total = sum(c.values())
    assert len(got) == len(rows)
    for r in got:
        w = words(texts[r["doc_id"]])
        base = sum(math.log10((c[x] + 0.1) / (total + 0.1 * (len(c) + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] <= 0
    again = lm.score(docs, F.col("held"), broadcast=0).orderBy("doc_id", "score").collect()
    assert np.allclose([r["score"] for r in got], [r["score"] for r in again])
    nothing = lm.score(docs, F.lit(True)).first()
    assert nothing["train_tokens"] == 0 and nothing["n_known"] == 0 and math.isfinite(nothing["score"])
    assert lm.score(docs.limit(0), F.col("held")).count() == 0


def test_filter_holds_levels_and_errs_upwards_rarely():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 2**48, 20_000, dtype=np.uint64))
    counts = rng.geometric(0.3, len(keys))
    part = lm.Shard(*lm.Shard.of(keys[::2], counts[::2]))
    want = lm.levels_of(counts[::2])
    assert (part.level(keys[::2]) >= want).all() and (part.level(keys[::2]) == want).mean() > 0.97
    assert (part.level(keys[1::2]) > 0).mean() < 0.03


# ---- repeats


def brute_removed(texts):
    docs = [substrings.words_of(t) for t in texts]
    starts = collections.Counter(tuple(d[i:i + 35]) for d in docs for i in range(len(d) - 34))
    out = []
    for d in docs:
        gone = {p for i in range(len(d) - 34) if starts[tuple(d[i:i + 35])] > 1 for p in range(i, i + 35)}
        out.append((len(d), len(gone), b" ".join(w for p, w in enumerate(d) if p not in gone).decode()))
    return out


def test_repeats_match_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    new = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    shared = [new(34), new(35), new(36), new(52), new(120)]
    texts = [None, "", "\u00a0", new(34), "x " * 80, "y " * 35, shared[1], new(5000) + " " + shared[4]]
    for s in shared:
        texts += [f"{new(rng.randint(0, 60))} {s}\n{new(rng.randint(0, 60))}" for _ in range(3)]
    texts += [f"{shared[4]} {shared[3]}", texts[-1], texts[-1]]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, n_words string, row string")
    got = substrings.without_repeats(substrings.repeats(docs.repartition(3, "doc_id").sortWithinPartitions("doc_id"))).orderBy("doc_id").collect()
    assert [(r["n_words"], sum(s["end"] - s["start"] for s in r["repeat_spans"]), r["kept"]) for r in got] == brute_removed(texts)
    assert substrings.repeats(docs.limit(0)).count() == 0


# ---- near copies


def brute_classes(rows):
    bags = []
    for _, t in rows:
        w = neardup.WORD.findall((t or "").lower())
        bags.append(collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            if a and b:
                met = sum((a & b).values())
                if met >= 0.8 * (sum(a.values()) + sum(b.values()) - met):
                    at[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[root(i)].append(d)
    return sorted((d, min(g), len(g)) for g in groups.values() for d in g)


def near_rows():
    rng = random.Random(12)
    new = lambda n: [f"w{rng.randint(0, 300)}" for _ in range(n)]
    texts = [None, None, "", " .", "one two", "One, two", "one two three", "z " * 3000, "z " * 2800, "z " * 1000]
    for _ in range(6):
        base = new(120)
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = "x"
            texts.append(" ".join(w))
        base = w  # a chain: each copy of the one before
        for _ in range(6):
            base = list(base)
            for _ in range(2):
                base[rng.randrange(len(base))] = f"y{rng.random()}"
            texts.append(" ".join(base))
    texts += [" ".join(new(50)) for _ in range(20)] + texts[12:15]
    return list(enumerate(texts))


def test_classes_match_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string")
    got = sorted(tuple(r) for r in neardup.classify(docs).select("doc_id", "class_id", "class_size").collect())
    assert got == brute_classes(rows)
    assert neardup.classify(docs.limit(0)).count() == 0
    kept = neardup.keep_one(docs.union(docs.filter("doc_id = 20")))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _ in got})


def test_buckets_in_blocks_lose_no_link(spark):
    """Three bands of one place: large mixed buckets, whole and in blocks of a few texts or bytes."""
    rows = near_rows()[10:80]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = lambda df: sorted(sorted(r["k"]) for r in df.groupBy("comp").agg(F.collect_list("text_key").alias("k")).collect())
    whole = groups(neardup.text_classes(docs, bands=3, rows=1, agree=0, block=10**9))
    assert groups(neardup.text_classes(docs, bands=3, rows=1, agree=0, block=5)) == whole
    assert groups(neardup.text_classes(docs, bands=3, rows=1, agree=0, block_bytes=4000)) == whole


def test_bucket_links_match_pairs_and_join_components_once():
    rng = random.Random(14)
    texts = [t for _, t in near_rows()[10:60]]
    owner, key, weight = neardup.Shingler()(texts)
    n = len(texts)
    shingles, counts = [[x[owner == i] for i in range(n)] for x in (key, weight)]
    total = np.array([c.sum() for c in counts])
    comp, asks = np.arange(n), np.array([rng.random() < 0.6 for _ in range(n)])
    asks[0] = False
    bands, sketch = np.full((n, 2), 7, np.int64), np.zeros((n, 10), np.uint8)
    bands[:, 0] = np.arange(n)
    got = neardup.bucket_links(np.arange(n), bands, 7, comp, asks, np.ones(n, bool), sketch, total, shingles, counts, 0.5, 0.8)
    near = lambda i, j: neardup.overlap(*[x for k in (i, j) for x in (shingles[k].tobytes(), neardup.squeeze(counts[k].astype("<u4")))])
    links = [(i, j) for i in range(n) for j in range(n) if i != j and asks[i] and near(i, j) >= 0.8 * (total[i] + total[j] - near(i, j))]

    def pieces(edges):
        at = list(range(n))
        for i, j in edges:
            at = [at[j] if a == at[i] else a for a in at]
        return len(set(at)), at

    assert links and set(got) <= set(links) and pieces(got)[0] == pieces(links)[0] == n - len(got)
    bands[:, 0] = 1  # every pair shares an earlier bucket
    assert neardup.bucket_links(np.arange(n), bands, 7, comp, asks, np.ones(n, bool), sketch, total, shingles, counts, 0.5, 0.8) == []


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(1)
    a = [f"w{rng.randint(0, 60)}" for _ in range(200)]
    b = list(a)
    for i in (30, 90, 150):
        b[i] = "zz"
    texts = [" ".join(a + a[:40] * 3), " ".join(b + a[:40] * 2)]
    owner, key, weight = neardup.Shingler()(texts)
    bags = [collections.Counter(dict(zip(key[owner == i].tolist(), weight[owner == i].tolist()))) for i in (0, 1)]
    true = sum((bags[0] & bags[1]).values()) / sum((bags[0] | bags[1]).values())
    sig = neardup.bag_signatures(owner, key, weight, 2, 8000)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.02


# ---- pipeline


def test_pipeline_keeps_clean_documents_and_applies_its_stages(spark, tmp_path):
    rng = random.Random(13)
    stems = {"aa": ["the", "thing", "oning", "wash", "thorn"], "bb": ["der", "ungen", "keit", "schen", "laub"]}
    text = lambda y, n=40: " ".join(rng.choice(stems[y]) + rng.choice("abcdefgh") for _ in range(n))
    rows = [(i, text(y), y, "s", 0) for i, y in enumerate(["aa", "bb"] * 30)]
    item = text("aa", 20)
    rows += [(100, rows[4][1], "aa", "s", 0), (101, rows[5][1].replace(" ", ", ", 3), "bb", "s", 0), (102, text("aa") + " " + item, "aa", "s", 0)]
    rows += [(103, None, "aa", "s", 0), (104, "12 34 5", "aa", "s", 0), (105, text("aa") + " write a@b.example now", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == before
        if name == "personal_data":
            row = docs.filter("doc_id = 105").first()
            assert row["text"].endswith("write <EMAIL> now") and row["lang"] == "aa" and row["n_chars"] == len(row["text"])
    got = {r["doc_id"]: r for r in docs.collect()}
    assert set(got) == {*range(60), 105} and all(r["round_trip"] for r in got.values())
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], bytes(r["token_ids"])) for r in whole) == sorted((i, bytes(r["token_ids"])) for i, r in got.items())


def test_pipeline_keeps_texts_that_switch_and_texts_without_known_languages(spark):
    rng = random.Random(21)
    stems = {"aa": ["the", "thing", "oning", "wash"], "bb": ["der", "ungen", "keit", "schen"], "cc": ["que", "cion", "mente", "llor"]}
    text = lambda y, n=32: " ".join(rng.choice(stems[y]) for _ in range(n))
    rows = [(i, text(y), y) for i, y in enumerate(["aa", "bb", "cc"] * 20)] + [(100, " ".join(map(text, stems)), None), (101, None, None), (102, "12 !?", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.keep_languages(spark, docs, "").collect()} == {*range(60), 100}
    blank = corpus_pipeline.keep_languages(spark, docs.withColumn("lang", F.lit(None).cast("string")), "")
    assert blank.columns == docs.columns and {(r["doc_id"], r["lang"]) for r in blank.collect()} == {(i, None) for i in (*range(60), 100)}


def test_pipeline_passes_columns_with_names_of_its_own(spark, tmp_path):
    """Further columns named as the operators name theirs come out unchanged; a long text, repeated rows and no rows at all go through."""
    rng = random.Random(15)
    text = lambda stems, n=30: " ".join(rng.choice(stems) + rng.choice("abcdefgh") for _ in range(n))
    texts = [text(["the", "thing", "wash"]) for _ in range(12)] + [text(["der", "ungen", "keit"]) for _ in range(12)]
    texts += [text(["the", "thing", "wash"], 20_000), texts[0], None, ""]
    names = ["spans", "mentions", "__row", "__key", "lang_pred", "lang_sure", "n_words", "hit_spans", "hit_items", "Hits", "bands", "rep"]
    rows = [(i, t, "aa" if i % 2 else "bb", "s", 0, *[f"{c}{i}" for c in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    spark.createDataFrame([(1, "no such words here at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for label, some in (("full", docs), ("none", docs.limit(0))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = some.columns
            stage(spark, some, str(tmp_path)).write.parquet(f"{tmp_path}/{label}{k}")
            some = spark.read.parquet(f"{tmp_path}/{label}{k}")
            if k < 4:
                assert some.columns == before
                held = some.select("doc_id", *names).collect()
                assert all(r[c] == f"{c}{r['doc_id']}" for r in held for c in names)
                assert label == "none" or {r["doc_id"] for r in held} >= set(range(1, 12)) and not {r["doc_id"] for r in held} & {26, 27}
        ids = sorted(r["doc_id"] for r in some.collect())
        assert ids == (sorted(set(range(25))) if label == "full" else [])
