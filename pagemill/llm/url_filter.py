"""URL filters by propagation over the link graph.

Rules decide the urls they fit. Hosts with ruled pages seed two walks over the edges between hosts.
Trust is a personalised PageRank: it starts at allowed hosts and follows links, divided among them.
Distrust starts at blocked hosts and goes back along links: of a host's links, the share that leads
to distrusted hosts is what it takes of their distrust (the chance that a surfer who starts there
ends up at a blocked host). So a host whose links all lead to blocked ones has the same distrust
however many others do the same, and the threshold means the same in graphs of any size. A host's
seed is the share of its pages that rules allow (block); a host without an edge keeps its seed. Pages
without a rule are blocked if their host's distrust is at least `least` and greater than its trust,
where a host's own seed counts for both if it is greater: what walks on along links is not lost to it.

Edges come from absolute links in the pages' html, one for each pair of hosts, weighted by links;
links within a host are none. Both walks run as one table of scores, keyed by walk and host: a round
is one join with the edges and one sum with map-side parts, and rounds end when no score changes by
more than `tolerance` (a round shrinks changes by the damping, so they do end). The edges are
checkpointed once, the scores every round, so a lost executor costs a round at most.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule and is
allowed; null html has no links; a rule's path must start the url's, so `net/` doesn't fit a url
without a path; the longest fitting rule wins, of equally long ones the one given first; repeated
rows stay; only page_id, url and html are read; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: The rules, as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Absolute links, with a scheme or starting with //.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"'<>]*)"""


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """The rule that wins, as a struct (rule, verdict), or null."""
    longest = sorted(rules, key=lambda r: -len(r[1]) - len(r[2]))
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    said = [(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in longest]
    return reduce(lambda c, x: c.when(*x), said[1:], F.when(*said[0])) if said else F.lit(None).cast("struct<rule:string,verdict:string>")


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict), the last two null where no rule fits."""
    at = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    return at.withColumn("r", rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "r.rule", "r.verdict")


def edges(pages: DataFrame) -> DataFrame:
    """Rows (a, b, links) between different hosts."""
    urls = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))
    to = pages.select(host(F.col("url")).alias("a"), F.explode(urls).alias("to")).select("a", host(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))).alias("b"))
    return to.where("a != '' AND b != '' AND a != b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("links"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """seeds: (host, allowed, blocked) shares; links: (a, b, links). Rows (host, trust, distrust)."""
    out = links.groupBy("a").agg(F.sum("links").alias("all"))
    share = F.col("links") / F.col("all")
    both = F.array(F.struct(F.lit("trust").alias("walk"), F.col("a").alias("a"), F.col("b").alias("b"), share.alias("part")), F.struct(F.lit("distrust").alias("walk"), F.col("b").alias("a"), F.col("a").alias("b"), share.alias("part")))
    shares = links.join(out, "a").select(F.inline(both))
    start = checkpointed(seeds.select("host", F.inline(F.array(F.struct(F.lit("trust").alias("walk"), F.col("allowed").alias("seed")), F.struct(F.lit("distrust").alias("walk"), F.col("blocked").alias("seed"))))))
    # A surfer at a host without links stays there.
    hosts = seeds.select("host").union(links.select("a")).union(links.select("b")).distinct()
    ends = hosts.join(out.select(F.col("a").alias("host")), "host", "left_anti").select(F.explode(F.array(F.lit("trust"), F.lit("distrust"))).alias("walk"), F.col("host").alias("a"), F.col("host").alias("b"), F.lit(1.0).alias("part"))
    moves = checkpointed(shares.union(ends))
    seeded = start.where("seed > 0")
    now = seeded.select("walk", "host", F.col("seed").alias("score"))
    while True:
        moved = now.join(moves.withColumnRenamed("a", "host"), ["walk", "host"]).select("walk", F.col("b").alias("host"), (damping * F.col("score") * F.col("part")).alias("score"), F.lit(0.0).alias("old"))
        kept = seeded.select("walk", "host", (1 - damping) * F.col("seed"), F.lit(0.0))
        new = checkpointed(moved.union(kept).union(now.select("walk", "host", F.lit(0.0), "score")).groupBy("walk", "host").agg(F.sum("score").alias("score"), F.sum("old").alias("old")))
        change = new.agg(F.coalesce(F.max(F.abs(F.col("score") - F.col("old"))), F.lit(0.0))).first()[0]
        now = new.select("walk", "host", "score")
        if change <= tolerance:
            break
    of = lambda w: F.coalesce(F.sum(F.when(F.col("walk") == w, F.col("score"))), F.lit(0.0)).alias(w)
    return now.groupBy("host").agg(of("trust"), of("distrust"))


def filter_pages(pages: DataFrame, rules=RULES, least: float = 0.5, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, trust, distrust)."""
    known = judged(pages, rules)
    share = lambda v: (F.count_if(F.col("verdict") == v) / F.count(F.lit(1))).alias(v)
    seeds = checkpointed(known.where("host != ''").groupBy("host").agg(share("allow"), share("block")))
    scores = checkpointed(propagate(seeds.select("host", F.col("allow").alias("allowed"), F.col("block").alias("blocked")), checkpointed(edges(pages)), damping, tolerance))
    both = known.join(checkpointed(scores.join(seeds, "host", "left")), "host", "left").withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("trust", "distrust", "allow", "block")})
    good, bad = F.greatest("trust", "allow"), F.greatest("distrust", "block")
    method = F.when((bad >= least) & (bad > good), "block").otherwise("allow")
    return both.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "trust", "distrust")
