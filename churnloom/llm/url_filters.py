"""URL rules, and trust and distrust spread over links for what no rule decides.

Hosts are nodes; an edge is weighted by the number of links. Trust starts at hosts with pages that the rules allow and
follows links; distrust starts at hosts with blocked pages and goes against links, as who links to
bad hosts is likely one. Both are personalised PageRanks, kept as rows of one table so that an
iteration is one join and one sum. A host is then judged per page by its own share of ruled pages, in
full, and by what other hosts hand to it.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnloom.plans.stages import cut


@dataclass(frozen=True)
class Rule:
    """Fits a host, its subdomains, and paths that start with ``path``."""

    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# Fixed values.
RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))
DAMPING = 0.85
# Rounds end when CUT_EVERY of them move less than RESIDUAL of all seeds. They move at most 2 * DAMPING ** rounds before them,
# so ITERATIONS are always enough.
RESIDUAL = 1e-10
ITERATIONS = 155
CUT_EVERY = 5
# Distrust a page's host must have, in blocked pages per page, to be blocked.
LEAST_DISTRUST = 0.5
# Digits to which trust and distrust are compared, so that the order of sums decides nothing.
DIGITS = 6
LINK = r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    """ASCII lower case; empty without ``://``."""
    found = F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules, hosts: Column, paths: Column, value) -> Column:
    """``value(rule)`` of the longest fitting rule. Rules come from the caller's code, so they are few."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((hosts == rule.host) | F.endswith(hosts, F.lit("." + rule.host))) & F.startswith(paths, F.lit(rule.path))
        found = F.when(fits, F.lit(value(rule))).otherwise(found)
    return found


def edges(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links between hosts. A relative link stays on its host."""
    links = F.regexp_extract_all("html", F.lit(LINK), F.lit(1))
    target = F.transform(links, lambda x: F.when(F.startswith(x, F.lit("//")), host(F.concat(F.lit("x:"), x)))
                         .when(F.rlike(x, F.lit(r"^(?i)https?://")), host(x))
                         .when(~F.rlike(x, F.lit(r"^(#|[A-Za-z][A-Za-z0-9+.-]*:)")), F.col("src")))
    return (pages.select(host(F.col("url")).alias("src"), "html").where("src != ''")
            .select("src", F.explode(target).alias("dst")).where("dst != ''")
            .groupBy("src", "dst").agg(F.count("*").alias("n")))


def link_shares(links: DataFrame) -> DataFrame:
    """``kind, giver, taker, share``: trust goes from src to dst, distrust from dst to src, in proportion to n."""
    both = links.select(F.lit("trust").alias("kind"), F.col("src").alias("giver"), F.col("dst").alias("taker"), "n").unionAll(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("giver"), F.col("src").alias("taker"), "n"))
    given = both.groupBy("kind", "giver").agg(F.sum("n").alias("all"))
    return cut(both.join(given, ["kind", "giver"]).select("kind", "giver", "taker", (F.col("n") / F.col("all")).alias("share")),
               "link-shares")


def propagate(shares: DataFrame, seeds: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """``kind, host, score`` after the rounds; ``seeds``: ``kind, host, seed``, of each kind adding up to 1.

    ``shares``: see ``link_shares``. What hosts without links hold goes nowhere.
    """
    start = seeds.select("kind", "host", (F.col("seed") * (1 - DAMPING)).alias("score"))
    scores = last = seeds.select("kind", "host", F.col("seed").alias("score"))
    for i in range(iterations):
        moved = shares.join(scores.withColumnRenamed("host", "giver"), ["kind", "giver"]).select(
            "kind", F.col("taker").alias("host"), (F.col("score") * F.col("share") * DAMPING).alias("score"))
        scores = moved.unionAll(start).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if (i + 1) % CUT_EVERY == 0 and i + 1 < iterations:
            scores = cut(scores, "link-scores")
            change = scores.unionAll(last.withColumn("score", -F.col("score"))).groupBy("kind", "host").agg(
                F.sum("score").alias("change")).agg(F.sum(F.abs("change")).alias("moved")).first()
            if (change.moved or 0.0) <= RESIDUAL:
                break
            last = scores
    return scores


def host_verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """``host, trust, distrust, host_verdict`` of the hosts that trust or distrust reaches.

    ``trust`` and ``distrust`` are the PageRanks per page. A host holds 1 - DAMPING of its own seed in them, and
    more if its links come back to it. The verdict needs both undone: times (1 - DAMPING * share of links to itself) / (1 - DAMPING)
    a score is the host's own ruled pages plus what other hosts hand to it, each link on the way counting DAMPING.
    """
    seen = pages.select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).where("host != ''")
    said = seen.select("host", rule_of(rules, F.col("host"), F.col("path"), lambda r: r.verdict).alias("said"))
    counts = cut(said.groupBy("host").agg(
        F.count("*").alias("pages"), F.count_if(F.col("said") == "allow").alias("trust"),
        F.count_if(F.col("said") == "block").alias("distrust")), "hosts")
    total = counts.agg(F.sum("trust").alias("all_trust"), F.sum("distrust").alias("all_distrust")).first()
    parts = [counts.where(F.col(kind) > 0).select(F.lit(kind).alias("kind"), "host", (F.col(kind) / F.lit(n)).alias("seed"))
             for kind, n in (("trust", total.all_trust or 1), ("distrust", total.all_distrust or 1))]
    seeds = cut(parts[0].unionAll(parts[1]), "seeds")
    shares = link_shares(cut(edges(pages), "links"))
    scores = propagate(shares, seeds)
    own = shares.where("giver = taker").select("kind", F.col("giver").alias("host"), F.col("share").alias("own_share"))
    undone = (1 - DAMPING * F.coalesce("own_share", F.lit(0.0))) / (1 - DAMPING)

    def per_page(kind, n, score):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, score)), F.lit(0.0)) * F.lit(n) / F.max("pages")

    held = [per_page(kind, n or 0, score).alias(prefix + kind) for prefix, score in (("", F.col("score")), ("whole_", F.col("score") * undone))
            for kind, n in (("trust", total.all_trust), ("distrust", total.all_distrust))]
    judged = scores.join(counts.select("host", "pages"), "host").join(own, ["kind", "host"], "left").groupBy("host").agg(*held)
    trust, distrust = F.round("whole_trust", DIGITS), F.round("whole_distrust", DIGITS)
    bad = (distrust >= LEAST_DISTRUST) & (distrust > trust)
    return judged.select("host", "trust", "distrust", F.when(bad, "block").otherwise("allow").alias("host_verdict"))


def url_filters(pages: DataFrame, rules=RULES, page_id: str = "page_id") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages`` (``page_id, url, html``).

    The longest rule that fits decides. Without one the host's verdict does, and a host that neither
    trust nor distrust reaches is allowed, as is a url without host. A null or odd url has empty host and
    path; a null html has no links. Repeated rows are judged alike and each counts as a page; ids may
    be null. Other columns are not read. An empty table gives an empty one.
    """
    hosts = cut(host_verdicts(pages.select("url", "html"), rules).select("host", "host_verdict"), "host-verdicts")
    split = pages.select(F.col(page_id).alias("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    ruled = split.select("*", rule_of(rules, F.col("host"), F.col("path"), lambda r: r.text).alias("rule"),
                         rule_of(rules, F.col("host"), F.col("path"), lambda r: r.verdict).alias("said"))
    return ruled.join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", "host_verdict", F.lit("allow")).alias("verdict"))
