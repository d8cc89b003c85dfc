r"""Personal data by base patterns and by contexts learned from what they find.

Base spans: e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone
numbers, leftmost and without overlap within a kind, as code points, end exclusive.

Bootstrapping: a mention is a base span, or another word with a digit or an @
(a candidate). Its pattern is the two words before it, digits as 0, letters
lower-cased. Patterns and instances form a graph of distinct (pattern, instance)
edges. Base instances hold score 1 for their kind for good. In each of ``ROUNDS``
rounds a pattern's confidence for a kind is the sum of its instances' scores over
the number of its instances plus ``DOUBT``, and a candidate instance gets the best
confidence among its patterns that reach ``LEVEL``. In the end the candidates that
stand in patterns of at least ``LEVEL`` with ``SUPPORT`` distinct base instances
become spans of the pattern's kind; base spans stay and candidates never overlap them.

Everything after the scan works on mentions, not on texts: edges are made distinct
before scoring, so a pattern or an instance that fills a third of a corpus is one
row in each list. Null and empty texts have no spans; repeated rows are scanned one
by one; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselspark.llm.batches import with_columns
from vesselspark.llm.catalog import query, table
from vesselspark.session import stored

KINDS = ["email", "ip", "card", "phone"]
ROUNDS = 3
LEVEL = 0.8
SUPPORT = 3
DOUBT = 0.5

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match never starts within a run of digits whose start is free, which keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
CANDIDATE = re.compile(r"[0-9@]\S*")

SPAN = "struct<kind:string,start:int,end:int>"
MENTION = "struct<kind:string,start:int,end:int,pattern:string,instance:string>"


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 8 <= len(DIGITS.findall(m.group())) <= 15:
            yield m.span()


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    if not text:
        return []
    out = []
    if "@" in text:
        out += [("email", *s) for s in emails(text)]
    if DIGITS.search(text):
        out += [("ip", *s) for s in addresses(text)]
        out += [("card", *s) for s in cards(text)]
    if "+" in text:
        out += [("phone", *s) for s in phones(text)]
    return out


def context(text: str, start: int) -> str:
    """The two words before a position, lower-cased, digits as 0."""
    before = text[max(0, start - 200):start].split()[-2:]
    return DIGITS.sub("0", " ".join(before).lower())


def mentions(text: str | None, spans: list[tuple[str, int, int]]) -> list[dict]:
    out = [
        {"kind": k, "start": s, "end": e, "pattern": context(text, s), "instance": text[s:e]}
        for k, s, e in spans
    ]
    if text:
        taken = sorted((s, e) for _, s, e in spans)
        free, k = 0, 0
        for m in CANDIDATE.finditer(text):
            start, end = m.span()
            if start < free:
                continue
            while start > free and not text[start - 1].isspace():
                start -= 1
            free = end
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            if any(s < end and start < e for s, e in taken[k:k + 8]):
                continue
            out.append({"kind": None, "start": start, "end": end, "pattern": context(text, start), "instance": text[start:end]})
    return out


def scan(docs: DataFrame, text_col: str = "text", keep: bool = True) -> DataFrame:
    """``docs`` with ``mentions``: base spans (with a kind) and candidates (without)."""

    def start():
        return lambda texts: [[mentions(t, base_spans(t)) for t in texts]]

    return with_columns(docs, [text_col], [("mentions", f"array<{MENTION}>")], start, keep)


def confident_patterns(found: DataFrame, rounds: int = ROUNDS, level: float = LEVEL, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind) learned from a table of mentions, by rounds over the pattern-instance graph."""
    edges = stored(
        found.select(F.explode("mentions").alias("m")).select("m.pattern", F.sha2("m.instance", 256).alias("instance"), "m.kind")
        .filter("pattern != ''").distinct(),
        "pii-edges",
    )
    size = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("n"))
    seeds = edges.filter("kind is not null").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    score = seeds
    plain = edges.select("pattern", "instance").distinct()
    for k in range(rounds):
        best = (
            plain.join(score, "instance").groupBy("pattern", "kind")
            .agg(F.sum("score").alias("sum"), F.sum(F.when(F.col("score") == 1.0, 1).otherwise(0)).alias("seeds"))
            .join(size, "pattern").withColumn("confidence", F.col("sum") / (F.col("n") + DOUBT))
            .filter((F.col("confidence") >= level) & (F.col("seeds") >= support))
        )
        best = stored(best.select("pattern", "kind", "confidence"), "pii-patterns")
        if k + 1 < rounds:
            learned = plain.join(best, "pattern").groupBy("instance", "kind").agg(F.max("confidence").alias("score"))
            score = seeds.unionByName(learned).groupBy("instance", "kind").agg(F.max("score").alias("score"))
    top = F.max(F.struct("confidence", "kind")).alias("top")
    return best.groupBy("pattern").agg(top).select("pattern", F.col("top.kind").alias("found_kind"))


def find(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``, each sorted by kind as listed, then start."""
    scanned = scan(docs, text_col)
    if not keep_text:
        scanned = scanned.drop(text_col)
    scanned = stored(scanned.withColumn("__row", F.monotonically_increasing_id()), "pii-scan")
    patterns = confident_patterns(scanned)
    more = (
        scanned.select("__row", F.explode("mentions").alias("m")).filter("m.kind is null")
        .select("__row", "m.start", "m.end", "m.pattern").join(patterns, "pattern")
        .groupBy("__row").agg(F.collect_list(F.struct(F.col("found_kind").alias("kind"), "start", "end")).alias("__more"))
    )
    base = F.transform(F.filter("mentions", lambda m: m["kind"].isNotNull()), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    order = F.array(*map(F.lit, KINDS))
    both = F.concat("base_spans", F.coalesce("__more", F.array().cast(f"array<{SPAN}>")))
    keyed = F.array_sort(F.transform(both, lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return scanned.join(more, "__row", "left").withColumn("base_spans", base).withColumn("spans", spans).drop("__row", "__more", "mentions")


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """``text`` with every span replaced by its kind in angle brackets; drops the span columns."""

    def start():
        def work(texts, spans):
            out = []
            for text, own in zip(texts, spans):
                for s in reversed(apart(own)):
                    text = f"{text[:s['start']]}<{s['kind'].upper()}>{text[s['end']:]}"
                out.append(text)
            return [out]

        return work

    order = found.drop("base_spans", "spans").columns
    return with_columns(found, [text_col, "spans"], [(text_col, "string")], start, drop=("base_spans", "spans")).select(*[F.col(f"`{c}`") for c in order])


def apart(own: list[dict] | None) -> list[dict]:
    """Spans of one text by their start; those that overlap are one of the first kind."""
    kept: list[dict] = []
    for s in sorted(own or (), key=lambda s: (s["start"], -s["end"])):
        if kept and s["start"] < kept[-1]["end"]:
            kept[-1]["end"] = max(kept[-1]["end"], s["end"])
        else:
            kept.append(dict(s))
    return kept


def disjoint(found: DataFrame) -> DataFrame:
    """Spans of different kinds that overlap are joined into one of the first kind."""

    def start():
        return lambda spans: [[apart(own) for own in spans]]

    return with_columns(found, ["spans"], [("spans", f"array<{SPAN}>")], start)


def joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str):
    return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")


@query()
def op6_pii(spark, sf_dir):
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    counts = [count_of(kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))
