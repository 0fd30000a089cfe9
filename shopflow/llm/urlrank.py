"""Operator 4: URL filter by link-graph propagation.

Listed rules decide the urls they fit. All other urls get their host's verdict: trust spreads
from hosts that rules allow along the links (personalised PageRank), distrust from hosts that
rules block against the links (reversed), and a host whose distrust outweighs its trust is blocked.

Edges lie between hosts: links in a page's html, and both ways between a host and its parent domain (a
subdomain answers for its site). They are aggregated per host pair before anything is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.llm.common import ascii_lower, materialise

# (verdict, host, path): the rules of the contract.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``pages(host, html)`` -> ``(src, dst, weight)`` between different hosts."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?([a-z][a-z0-9+.-]*://[^"'\s>]*)"""), F.lit(1))
    linked = (pages.select(F.col("host").alias("src"), F.explode(links).alias("url"))
              .select("src", url_host(F.col("url")).alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    hosts = pages.select("host").distinct()
    parent = F.regexp_extract("host", r"\A[^.]*\.([^.]+\..+)\z", 1)
    site = hosts.select(F.col("host").alias("src"), parent.alias("dst"), F.lit(1.0).alias("weight"))
    both = linked.union(site).union(site.select("dst", "src", "weight")).where("src <> dst and src <> '' and dst <> ''")
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


EACH = 4  # rounds between two written tables
TASK_EDGES = 1 << 18  # edges of a task, so that rounds over a small graph don't leave a file for each of many partitions


def personalised_rank(edges: DataFrame, seeds: DataFrame, rounds: int | None, damping: float, tolerance: float = 1e-6) -> DataFrame:
    """``edges(src, dst, weight)``, ``seeds(host, seed)`` (shares that sum to 1) -> ``(host, score)``.

    Scores only grow, and what a round adds is at most ``damping`` times what the one before added: rounds end when
    all that further ones could add, over all hosts together, is below ``tolerance``; or after ``rounds``, if given.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    few = max(1, -(-edges.count() // TASK_EDGES))
    steps = materialise(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("all")).alias("share")).coalesce(few), "steps")
    start = materialise(seeds.select("host", (F.col("seed") * (1 - damping)).alias("score")).coalesce(few), "start")
    rank, total, done = start, 0.0, 0
    while rounds is None or done < rounds:
        for _ in range(EACH if rounds is None else min(EACH, rounds - done)):
            sent = (rank.join(steps, rank["host"] == steps["src"])
                    .select(F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score")).coalesce(few))
            rank = sent.union(start).groupBy("host").agg(F.sum("score").alias("score")).coalesce(few)
            done += 1
        rank = materialise(rank, "rank")  # keeps the plan short
        now = rank.agg(F.sum("score")).first()[0] or 0.0
        if rounds is None and (not now or total and (now - total) * damping ** EACH / (1 - damping ** EACH) < tolerance):
            break
        total = now
    return rank


def filter_urls(pages: DataFrame, rules=RULES, tolerance: float = 1e-6, damping: float = 0.85, threshold: float = 0.0) -> DataFrame:
    """``pages(page_id, url, html, ...)`` -> one row for each row: ``page_id``, ``host``, ``path``,
    ``rule``, ``verdict``, ``score`` (trust less distrust of the host, each relative to its mean).

    A host is blocked if its score is below ``threshold``; hosts that neither reaches score 0 and are
    allowed. Scores are exact to ``tolerance`` of a direction's whole mass (some 90 links from the nearest seed
    at a damping of 0.85). An empty table gives no rows. A null url or one without ``://`` has an empty host and path, fits no rule, scores 0. A null
    html has no links. Rows that repeat a page_id are judged each. Other columns are ignored.
    """
    parsed = pages.select("page_id", url_host(F.col("url").cast("string")).alias("host"), url_path(F.col("url").cast("string")).alias("path"))
    rule, verdict = judge(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumns({"rule": rule, "listed": verdict})
    edges = materialise(host_edges(pages.select(url_host(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))), "host_edges")
    hosts = materialise(judged.where("host <> ''").groupBy("host").agg(
        F.max(F.when(F.col("listed") == "allow", 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("listed") == "block", 1).otherwise(0)).alias("bad")), "hosts")
    # a host that rules both allow and block in part is no seed
    seed = lambda own, other: hosts.where(f"{own} = 1 and {other} = 0")
    ranks = []
    for own, other, graph in (("good", "bad", edges), ("bad", "good", edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))):
        s = seed(own, other)
        n = s.count()
        rank = personalised_rank(graph, s.select("host", F.lit(1.0 / max(n, 1)).alias("seed")), None, damping, tolerance)
        ranks.append(rank.select(F.col("host").alias(own + "_host"), (F.col("score") * max(n, 1)).alias(own + "_score")))
    scores = (hosts.select(F.col("host").alias("s_host"))
              .join(ranks[0], F.col("s_host") == F.col("good_host"), "left").join(ranks[1], F.col("s_host") == F.col("bad_host"), "left")
              .select("s_host", (F.coalesce("good_score", F.lit(0.0)) - F.coalesce("bad_score", F.lit(0.0))).alias("score")))
    out = judged.join(scores, F.col("host") == F.col("s_host"), "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    by_host = F.when(F.col("score") < threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", by_host).alias("verdict"), F.round("score", 9).alias("score"))
