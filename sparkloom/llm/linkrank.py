"""URL filter: address rules, and trust propagated over the graph of hosts.

Pages that a rule allows make their hosts trusted seeds, pages that one blocks make distrusted
seeds. Trust follows links (personalised PageRank); distrust follows them backwards, from a
blocked host to those that link to it. A host whose share of distrust passes a threshold is
blocked where no rule speaks. Links are the absolute links of the pages, and both ways between a
host and the domain above it, up to the domain that can be registered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import ascii_lower, broadcast_if_small, hot_keys, split_join, stash

#: (verdict, host, path): a rule fits its host and all below it, where the path starts with the rule's.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
DAMPING = 0.85
ROUNDS = 60
PER_JOB = 3
TOLERANCE = 0.01
# Labels that, above a country's, stand for no site.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty if the address is null or has no ://."""
    at = F.locate("://", url) if isinstance(url, str) else F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def _rule(host: Column, path: Column, rules: tuple) -> Column:
    """The longest rule that fits, as (length, rule, verdict); null if none does. Ties go to the later text."""
    fits = [
        F.when(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def site_of(host: Column) -> Column:
    """The host as a node of the graph: without user and port."""
    return F.regexp_replace(host, r"^[^@]*@|:[0-9]*$", "")


def _links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts, summed over pages: absolute addresses in href, not in src."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)\bhref\s{0,8}=\s{0,8}["']?(?:https?:)?//([A-Za-z0-9.-]+)"""), 1)
    linked = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(found)).alias("dst")).select("src", ascii_lower(F.col("dst")).alias("dst"))
    return linked.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def ladder(hosts: DataFrame) -> DataFrame:
    """(src, dst): every host and the domain above it, and that domain and the one above, up to one that can be registered.

    Numeric addresses have nothing above them, and what is above a domain that can be registered
    (example.com, example.co.uk) belongs to nobody.
    """
    parts = F.split("host", r"\.")
    shared = (F.size(parts) > 2) & (F.length(F.element_at(parts, -1)) == 2) & F.element_at(parts, -2).isin(*SECOND_LEVEL)
    own = F.when(shared, 3).otherwise(2)  # labels of the domain that can be registered
    steps = F.when((F.size(parts) > own) & ~F.rlike("host", F.lit(r"^[0-9.]+$")), F.sequence(F.lit(1), F.size(parts) - own))
    below = lambda k: F.array_join(F.slice(parts, k, F.size(parts)), ".")
    each = F.explode(F.transform(steps, lambda k: F.struct(below(k).alias("src"), below(k + 1).alias("dst"))))
    return hosts.select("host").distinct().select(each.alias("x")).select("x.src", "x.dst").distinct()


def host_scores(pages: DataFrame, rules: tuple = RULES, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust, size) of pages(host, path, html); each sums to one over the hosts, trust and distrust if there are seeds.

    Rounds go on until the ranks of PER_JOB rounds differ by ``tolerance`` of the whole at most, or
    for ``rounds``.
    """
    own = pages.select(site_of(F.col("host")).alias("host"), _rule(F.col("host"), F.col("path"), rules).alias("r")).where("host <> ''")
    seeds = own.groupBy("host").agg(F.count("*").cast("double").alias("pages"), F.count_if(F.col("r.verdict") == "allow").cast("double").alias("trust"), F.count_if(F.col("r.verdict") == "block").cast("double").alias("distrust"))
    seeds = stash(seeds, "seeds")
    links = stash(_links(pages.select(site_of(F.col("host")).alias("host"), "html")), "links")
    hosts = seeds.select("host").union(links.select("dst"))
    rungs = ladder(hosts)
    rungs = rungs.union(rungs.select("dst", "src")).withColumn("weight", F.lit(1.0))
    nodes = stash(hosts.union(rungs.select("src")).distinct(), "nodes")
    stay = nodes.select(F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("weight"))  # keeps the mass of hosts without links
    edges = links.union(rungs).union(stay)
    # trust and distrust are two graphs over the same hosts: a node is a host in one of them
    node = lambda kind, host: F.concat(F.lit(f"{kind}:"), host)
    both = edges.select(node("t", F.col("src")).alias("node"), node("t", F.col("dst")).alias("dst"), "weight").union(edges.select(node("d", F.col("dst")).alias("node"), node("d", F.col("src")).alias("dst"), "weight"))
    both = stash(both, "edges")
    whole = both.groupBy("node").agg(F.sum("weight").alias("total"))
    hot = hot_keys(both, "node")
    both = stash(split_join(both, whole, "node", hot=hot).select("node", "dst", (F.col("weight") / F.col("total")).alias("share")), "shares")

    *mass, n_pages = seeds.agg(F.sum("trust"), F.sum("distrust"), F.sum("pages")).head()
    sizes = nodes.join(seeds, "host", "left").select("host", (F.coalesce("pages", F.lit(0.0)) / F.lit(n_pages or 1.0)).alias("size"))
    start = [seeds.select(node(k[0], F.col("host")).alias("node"), (F.col(k) / F.lit(m)).alias("seed")) for k, m in zip(("trust", "distrust"), mass, strict=True) if m]
    if not start:
        return sizes.select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"), "size")
    seed = stash(reduce(DataFrame.union, start).where("seed > 0"), "seed")
    rank = before = seed.withColumnRenamed("seed", "rank")
    back = seed.select("node", (F.col("seed") * (1 - DAMPING)).alias("rank"))
    for k in range(1, rounds + 1):
        moved = split_join(both, rank, "node", hot=hot).select(F.col("dst").alias("node"), (F.col("rank") * F.col("share") * DAMPING).alias("rank"))
        rank = moved.union(back).groupBy("node").agg(F.sum("rank").alias("rank"))
        if k % PER_JOB == 0:
            rank = stash(rank, "rank")
            change = rank.join(before.withColumnRenamed("rank", "was"), "node", "full_outer").agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))))
            if change.head()[0] <= tolerance * len(start):
                break
            before = rank
    ranks = rank.groupBy(F.substring("node", 3, 1 << 30).alias("host")).agg(*[F.coalesce(F.sum(F.when(F.left("node", F.lit(1)) == k[0], F.col("rank"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])
    return sizes.join(ranks, "host", "left").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"), "size")


def judge_urls(pages: DataFrame, rules: tuple = RULES, threshold: float = 0.5, neutral: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of pages(page_id, url, html).

    A null address or one without :// has an empty host and path and fits no rule. Where no rule
    fits, the verdict is block if the host's distrust is more than ``threshold`` of the sum of its
    trust, its distrust and ``neutral`` times its share of all pages, so that a little distrust
    does not block a large host; else allow. Hosts without distrust are allowed. Null pages have no
    links; pages of any length are read whole. Trust is that of the host without user and port.
    Repeated rows are judged alike; other columns are ignored; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    scores = stash(host_scores(split, rules), "host-scores")
    scores = scores.withColumnRenamed("host", "site")
    small = broadcast_if_small(scores)
    judged = split.select("page_id", "host", "path", site_of(F.col("host")).alias("site"), _rule(F.col("host"), F.col("path"), rules).alias("r"))
    judged = split_join(judged, scores, "site", "left") if small is scores else judged.join(small, "site", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    own = F.when(distrust > threshold * (trust + distrust + neutral * F.coalesce("size", F.lit(0.0))), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
