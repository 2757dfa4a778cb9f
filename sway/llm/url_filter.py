"""URL filters: rules for hosts and paths, and trust that spreads over links.

Rules judge pages by host and path. Where none fits, the page's host is judged by the
links between hosts: trust starts at the hosts whose pages rules allow and follows links
(a personalised PageRank), distrust starts at those whose pages rules block and follows
links backwards, from a page that is linked to the one that links. A host starts with
the share of its pages that a rule allows or blocks, and passes a part of what it has on,
divided by the numbers of links. It is blocked if its distrust exceeds its trust by more
than the threshold.

Links are read once, and pages of a host become one row a linked host before any shuffle.
A step sends only what the last one brought, by one join on the host and one aggregation
that combines before it shuffles; every step is written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sway.llm.common import saved

#: hosts with their rules up to which a join may broadcast them
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: the host of a link that names one
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]*)"""


def host_of(url) -> F.Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z
    lower-cased; empty if there is none."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), _UPPER, _LOWER)


def path_of(url) -> F.Column:
    """What follows the host up to ``?`` or ``#``; empty if there is no host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fitting(hosts: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``(host, rules)`` for the hosts that rules can fit, the longest first."""
    table = []
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {verdict} {rule}")
        table.append((host.translate(str.maketrans(_UPPER, _LOWER)), slash + path, rule, verdict))
    table = hosts.sparkSession.createDataFrame(table, "suffix string, path string, rule string, verdict string")
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = hosts.select("host", F.explode(ends).alias("suffix")).join(F.broadcast(table), "suffix")
    # a longer rule first; of two alike, the one that blocks
    return found.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(
        (-F.length("rule")).alias("order"), (F.col("verdict") == "allow").alias("allows"), "rule", "path", "verdict"))).alias("rules"))


def _shared(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def _ruled(rows: DataFrame, fitting: DataFrame) -> DataFrame:
    """``rows`` with ``fits``, the rule that decides (``rule`` and ``verdict``), or null."""
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    return rows.join(fitting, "host", "left").withColumn("fits", F.get(fits, F.lit(0))).drop("rules")


def spread(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, steps: int = 30, least: float = 1e-3) -> DataFrame:
    """``(host, trust, distrust)`` of all hosts that something reaches.

    ``edges (source, target, n)``: n links of one host to another, each pair once;
    ``seeds (host, trust, distrust)``. Trust x of a host gives ``damping * x`` to the hosts
    that it links to, by their part of its links; distrust goes to the hosts that link
    to it, by their part of the links to it. What a host holds in the end is its seed
    plus all that reached it: personalised PageRank times the sum of the seeds over
    ``1 - damping``. A host without links passes nothing on. Walks end after ``steps`` steps, or
    when a step brings less than the ``least`` part of the seeds' sum."""
    long = lambda c, kind: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value"))
    seeds = seeds.select("host", F.inline(F.array(long("trust", 0), long("distrust", 1)))).where("value > 0")
    now = reached = saved(seeds, "seeds")
    whole = now.agg(F.sum("value")).first()[0]
    moves = []
    for kind, (giver, taker) in enumerate((("source", "target"), ("target", "source"))):
        given = edges.groupBy(giver).agg(F.sum("n").alias("all"))
        moves.append(edges.join(given, giver).select(
            F.lit(kind).alias("kind"), F.col(giver).alias("host"), F.col(taker).alias("to"),
            (F.lit(damping) * F.col("n") / F.col("all")).alias("share")))
    moves = saved(moves[0].unionByName(moves[1]), "moves")
    if whole and not moves.isEmpty():
        for _ in range(steps):
            now = now.join(moves, ["kind", "host"]).groupBy(F.col("to").alias("host"), "kind").agg(
                F.sum(F.col("value") * F.col("share")).alias("value"))
            now = saved(now, "step")
            reached = reached.unionByName(now)
            if (now.agg(F.sum("value")).first()[0] or 0.0) < least * whole:
                break
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("value")).otherwise(0.0))
    return reached.groupBy("host").agg(of(0).alias("trust"), of(1).alias("distrust"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], threshold: float = 0.5, damping: float = 0.85,
                steps: int = 30, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each row of ``pages``: ``key``, ``host``, ``path``, ``rule`` (the text of the
    rule that decides, or null), ``verdict`` (allow or block), ``trust`` and ``distrust`` (of the
    host; 0 where nothing reached it).

    ``rules`` are (verdict, ``host/path``): one fits its host and all subdomains if the
    page's path starts with its path. The longest that fits wins; of two that are alike
    the one that blocks, else the first by text. Where none fits, a page is blocked if its
    host's distrust exceeds its trust by more than ``threshold``. A host that has no page
    but is linked to is judged by the rules for its path ``/``. Links of a host to itself
    don't count; links that name no host stay on theirs.

    A null url, or one without ``://``, has an empty host and path; no rule fits an empty
    host, and it's allowed. Null and empty html has no links. Rows that repeat, and null
    keys, are pages like any other; an empty table gives no rows; other columns are not
    read. ``pages`` is read once."""
    rows = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
                        F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), 1),
                                                     lambda h: F.translate(h, _UPPER, _LOWER))).alias("targets"))
    rows = saved(rows, "pages")
    edges = rows.select(F.col("host").alias("source"), F.explode("targets").alias("target"))
    edges = saved(edges.where("source <> '' and target <> '' and source <> target")
                  .groupBy("source", "target").agg(F.count("*").alias("n")), "edges")
    hosts = saved(rows.where("host <> ''").select("host").distinct(), "hosts")
    bare = edges.select(F.col("target").alias("host")).distinct().join(hosts, "host", "left_anti")
    fitting = saved(_fitting(hosts.unionByName(bare), rules), "rules")
    fitting = _shared(fitting)
    counted = rows.where("host <> ''").select("host", "path").unionByName(bare.withColumn("path", F.lit("/")))
    part = lambda verdict: F.avg(F.coalesce(F.col("fits.verdict") == verdict, F.lit(False)).cast("double"))
    seeds = _ruled(counted, fitting).groupBy("host").agg(part("allow").alias("trust"), part("block").alias("distrust"))
    scores = _shared(saved(spread(edges, seeds, damping, steps), "scores"))
    judged = _ruled(rows.drop("targets"), fitting).join(scores, "host", "left")
    judged = judged.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    own = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    return judged.select(F.col("key").alias(key), "host", "path", F.col("fits.rule").alias("rule"),
                         F.coalesce("fits.verdict", own).alias("verdict"), "trust", "distrust")
