"""URL verdicts from host and path rules, and from trust and distrust spread over the link graph of hosts.

Pages that a rule allows make their hosts trusted seeds, pages that a rule blocks make them distrusted ones,
both weighted by the number of pages. Trust follows links (personalised PageRank from the trusted seeds),
distrust follows them backwards (a host is judged by what it links to). A page without a rule gets its
host's verdict: block, if distrust makes up more than ``threshold`` of the host's distrust, trust and pages
without a rule; else allow.

Edges are distinct host pairs with link counts, made by aggregation before anything is joined. Each round
is two equi-joins and one aggregation, and its ranks are a table in the shared folder. Rounds end when ranks
have settled; a busy host is a skewed join side that Spark splits.

Edge cases: null urls and urls without ``://`` have empty host and path, fit no rule, are no seeds and are
allowed. Null pages have no links. Links are absolute or start with ``//``; others stay on their host and
carry nothing. Repeated rows count as often as they come and each come back. Other columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.session import stored

DAMPING = 0.85
SETTLED = 1e-6
#: A round moves at most ``DAMPING`` of what the one before moved, so after so many ranks have settled.
ROUNDS = math.ceil(math.log(SETTLED) / math.log(DAMPING)) + 1
THRESHOLD = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s<>]+)"""

Rule = tuple[str, str, str]
"""action (allow or block), host, path"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def located(pages: DataFrame, url: Column) -> DataFrame:
    """``pages`` with host and path of a url."""
    host, path = host_and_path(F.coalesce(url.cast("string"), F.lit("")))
    return pages.withColumns({"host": host, "path": path})


def ruled(rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule as a string, and its action; null where none fits."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name = F.when(fits, F.lit(f"{host}{path}")).otherwise(name)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def host_edges(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """(source, target, links) between different hosts."""
    links = pages.select(F.col("host").alias("source"), F.explode(F.regexp_extract_all(
        F.coalesce(F.col(html_column), F.lit("")), F.lit(LINK), F.lit(1))).alias("link"))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    ends = located(links, full).select("source", F.col("host").alias("target"))
    return ends.where("source <> '' and target <> '' and source <> target").groupBy("source", "target").agg(
        F.count(F.lit(1)).cast("double").alias("links"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """(host, trust, distrust) in pages: a seed keeps its own and adds what reaches it.

    ``seeds`` is (host, trusted, distrusted).
    """
    outgoing = edges.groupBy("source").agg(F.sum("links").alias("out"))
    incoming = edges.groupBy("target").agg(F.sum("links").alias("into"))
    shares = stored(edges.join(outgoing, "source").join(incoming, "target").select(
        "source", "target", (F.col("links") / F.col("out")).alias("forward"), (F.col("links") / F.col("into")).alias("back")), "shares")
    known = seeds.select("host", F.col("trusted").cast("double").alias("trusted"), F.col("distrusted").cast("double").alias("distrusted"))
    linked = shares.select(F.col("source").alias("host")).union(shares.select("target")).distinct()
    ranks = stored(known.join(linked, "host", "full").select(
        "host", F.coalesce("trusted", F.lit(0.0)).alias("trusted"), F.coalesce("distrusted", F.lit(0.0)).alias("distrusted")).select(
        "*", F.col("trusted").alias("trust"), F.col("distrusted").alias("distrust"), F.lit(0.0).alias("moved")), "ranks")
    if shares.isEmpty():
        return ranks.select("host", "trust", "distrust")
    total = ranks.agg(F.sum("trusted") + F.sum("distrusted")).first()[0] or 0.0
    for _ in range(rounds):
        now = ranks.select("host", "trust", "distrust")
        sent = shares.join(now.withColumnRenamed("host", "source"), "source").where("trust > 0").select(
            F.col("target").alias("host"), (F.col("trust") * F.col("forward")).alias("trust"), F.lit(0.0).alias("distrust"))
        blamed = shares.join(now.withColumnRenamed("host", "target"), "target").where("distrust > 0").select(
            F.col("source").alias("host"), F.lit(0.0).alias("trust"), (F.col("distrust") * F.col("back")).alias("distrust"))
        got = sent.union(blamed).groupBy("host").agg(F.sum("trust").alias("more"), F.sum("distrust").alias("less"))
        trust = F.col("trusted") + damping * F.coalesce("more", F.lit(0.0))
        distrust = F.col("distrusted") + damping * F.coalesce("less", F.lit(0.0))
        ranks = stored(ranks.join(got, "host", "left").select(
            "host", "trusted", "distrusted", trust.alias("trust"), distrust.alias("distrust"),
            (F.abs(trust - F.col("trust")) + F.abs(distrust - F.col("distrust"))).alias("moved")), "ranks")
        if (ranks.agg(F.sum("moved")).first()[0] or 0.0) <= settled * max(total, 1e-12):
            break
    return ranks.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules: list[Rule], threshold: float = THRESHOLD, id_column: str = "page_id",
          url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust, one row per page."""
    placed = located(pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html")), F.col("url"))
    name, action = ruled(rules)
    marked = placed.withColumns({"rule": name, "action": action})
    tally = marked.where("host <> ''").groupBy("host").agg(
        F.count(F.when(F.col("action") == "allow", 1)).alias("trusted"), F.count(F.when(F.col("action") == "block", 1)).alias("distrusted"),
        F.count(F.when(F.col("action").isNull(), 1)).alias("open"))
    hosts = stored(tally, "hosts")
    edges = stored(host_edges(placed.select("host", "html")), "edges")
    reached = spread(edges, hosts)
    bad = F.col("distrust") > threshold * (F.col("distrust") + F.col("trust") + F.col("open"))
    verdicts = hosts.select("host", "open").join(reached, "host").select(
        "host", "trust", "distrust", F.when(bad, "block").otherwise("allow").alias("host_verdict"))
    return marked.select("page_id", "host", "path", "rule", "action").join(verdicts, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("action", "host_verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
