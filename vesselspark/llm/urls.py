"""URL filter: host rules first, then trust and distrust that spread over links.

Rules are (host, path, verdict); a rule fits its host and all subdomains if the
url's path starts with the rule's, and the longest wins (at equal length block
wins). Hosts whose pages rules allow are trusted seeds, hosts whose pages rules
block are distrusted seeds; a host with both is either by its share of pages.

Host edges come from absolute links in the pages, one row for each pair of hosts
with its number of links (links within a host are left out). Personalised PageRank
carries trust along the edges and distrust against them: each round a host passes
``DAMPING`` of its score to its neighbours by their share of links, what a host
without links would pass returns to the seeds, and the seeds get the rest. Rounds
end when no score moves by ``TOLERANCE``, and the scores count seeds (they sum to the
number of seeds). A page without a rule is blocked if its host's distrust is larger
than its trust times ``MARGIN``; a host that neither reaches is allowed.

A null url, one without ``://`` and an empty host have empty host and path; such
pages take no part in the graph. Repeated rows are judged one by one; null html has
no links; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselspark.llm.batches import with_columns
from vesselspark.llm.catalog import query, table
from vesselspark.session import stored

DAMPING = 0.85
TOLERANCE = 1e-4
MARGIN = 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path``."""
    url = F.col(url_col)
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return pages.withColumn("__rest", F.coalesce(rest, F.lit(""))).withColumns({
        "host": F.translate(F.regexp_extract("__rest", r"^[^/?#]*", 0), UPPER, LOWER),
        "path": F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1),
    }).drop("__rest")


def with_rules(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` (with host and path) with ``rule`` and ``rule_verdict`` of the longest rule, else null.

    The rules are a list held by the caller; a host's suffixes are looked up in it.
    """
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host.translate(str.maketrans(UPPER, LOWER)), []).append((path, verdict))

    def start():
        def best(host, path):
            top = None
            suffix = host
            while suffix:
                for start, verdict in by_host.get(suffix, ()):
                    if path.startswith(start):
                        rank = (len(suffix) + len(start), verdict == "block")
                        if top is None or rank > top[0]:
                            top = (rank, suffix + start, verdict)
                suffix = suffix.partition(".")[2]
            return top[1:] if top else (None, None)

        def work(hosts, paths):
            return list(map(list, zip(*map(best, hosts, paths))))

        return work

    return with_columns(pages, ["host", "path"], [("rule", "string"), ("rule_verdict", "string")], start)


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, n): links from pages of one host to another; needs ``host``."""
    links = pages.filter("host != ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))).alias("dst"))
    return (
        links.withColumn("dst", F.translate("dst", UPPER, LOWER)).filter("src != dst and dst != ''")
        .groupBy("src", "dst").agg(F.count("*").alias("n"))
    )


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from ``edges`` (src, dst, n) and ``seeds`` (host, trust, distrust)."""
    forward = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), "n")
    backward = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), "n")
    both = forward.unionByName(backward)
    degree = both.groupBy("kind", "from").agg(F.sum("n").alias("all"))
    links = stored(both.join(degree, ["kind", "from"]).select("kind", "from", "to", (F.col("n") / F.col("all")).alias("share")), "url-links")
    start = stored(
        seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "seed"))
        .filter("seed > 0").groupBy("host", "kind").agg(F.max("seed").alias("seed")), "url-seeds",
    )
    state = start.select("host", "kind", F.col("seed").alias("score"))
    if not links.isEmpty():
        total = start.groupBy("kind").agg(F.sum("seed").alias("total"))
        moved = 1.0
        while moved > tolerance:
            passed = (
                state.join(links, (state["kind"] == links["kind"]) & (state["host"] == links["from"]))
                .groupBy(links["kind"], F.col("to").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
            )
            # What is not passed on returns to the seeds: the score that no link carried.
            back = total.join(passed.groupBy("kind").agg(F.sum("got").alias("sent")), "kind", "left").select(
                "kind", ((F.col("total") - F.coalesce("sent", F.lit(0.0))) / F.col("total")).alias("back")
            )
            seeded = start.join(F.broadcast(back), "kind").select("host", "kind", (F.col("seed") * ((1 - damping) + damping * F.col("back"))).alias("got"))
            gained = passed.select("host", "kind", (damping * F.col("got")).alias("got")).unionByName(seeded)
            new = gained.groupBy("host", "kind").agg(F.sum("got").alias("score"))
            old = state.withColumnRenamed("score", "old")
            both = stored(new.join(old, ["host", "kind"], "full").select("host", "kind", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("old", F.lit(0.0)).alias("old")), "url-round")
            moved = both.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0
            state = both.select("host", "kind", "score")
    pick = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return state.groupBy("host").agg(pick("trust"), pick("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url_col: str = "url", html_col: str = "html", margin: float = MARGIN, keep_html: bool = False) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the host's trust and distrust; without the html unless asked for."""
    ruled = with_rules(with_parts(pages if keep_html else pages.drop(html_col), url_col), rules)
    seen = lambda v: F.sum(F.when(F.col("rule_verdict") == v, 1.0).otherwise(0.0))
    seeds = (
        ruled.filter("rule is not null and host != ''").groupBy("host").agg(seen("allow").alias("a"), seen("block").alias("b"))
        .select("host", (F.col("a") / (F.col("a") + F.col("b"))).alias("trust"), (F.col("b") / (F.col("a") + F.col("b"))).alias("distrust"))
    )
    scores = propagate(host_edges(with_parts(pages, url_col), html_col), seeds)
    out = ruled.drop("trust", "distrust", "verdict").join(scores, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    by_graph = F.when(F.col("distrust") > F.col("trust") * margin, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("rule_verdict", by_graph)).drop("rule_verdict")


@query()
def op3_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")
