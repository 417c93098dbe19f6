"""URL filters: rules first, then trust and distrust over the graph of hosts.

Hosts link to each other through the pages' absolute links. A host's trust seed is the
share of its pages that a rule allows, its distrust seed the share that a rule blocks.
Trust flows along links, divided by a host's outgoing links; distrust flows against
them, from a bad host to those that link to it, divided by the incoming links. Both are personalised PageRank
with damping `DAMPING` and seeds that are not scaled to sum 1, so values do not depend on the
size of the graph. Pages without a rule are blocked if the distrust of their host
exceeds its trust by `THRESHOLD`.

Round k adds what arrives over paths of k links. If it adds the mass m to all hosts together, all later rounds add at most
m * damping / (1 - damping), so rounds go on until that cannot turn the verdict on any host, or
is less than the rounding of the values: the number of rounds follows from the graph.

Edges are summed per pair of hosts first; every round is a join and a sum whose
result is written to the shared folder, so a hub costs no more than its edges.

Defined results: a null URL or one without `://` has an empty host and path, fits no
rule, takes no part in the graph and is allowed. Links of a host to itself are
left out. Pages repeated in the table count and are judged each. Null html has no links; very long html is searched whole.
An empty table has no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small, stored

DAMPING = 0.85
THRESHOLD = 0.05
# Values are rounded to so many digits.
DIGITS = 9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]+)"""


@dataclass(frozen=True)
class UrlRule:
    """`allow` or `block` for a host with its subdomains and the paths that start like this."""

    action: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """Struct of name and action of the longest rule that fits; of equally long ones a block."""
    found = F.lit(None).cast("struct<rule: string, action: string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.action == "block", r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.action).alias("action"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, n): on how many pages of one host there are links to another."""
    links = F.array_distinct(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)))
    rows = pages.select(host_and_path(F.col("url"))[0].alias("source"), F.explode(links).alias("link"))
    absolute = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit(":"), "link")).otherwise(F.col("link"))
    rows = rows.select("source", host_and_path(absolute)[0].alias("target"))
    rows = rows.filter((F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target")))
    return rows.groupBy("source", "target").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """(host, trust, distrust) from `seeds` (host, trust, distrust) over `edges` (source, target, n).

    Values are exact to the rounding, or as far as it takes to tell on which side of `threshold` every host's
    distrust - trust lies.
    """
    edges = stored(edges, "host-edges")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("trust", "distrust")]))
    base = seeds.select("host", kinds.alias("s")).select("host", "s.kind", (F.col("s.value") * (1 - damping)).alias("value"))
    base = stored(base.filter("value > 0"), "host-seeds")
    ranks = base
    if not edges.isEmpty():
        steps = edges.select(F.lit("trust").alias("kind"), F.col("source").alias("from"), F.col("target").alias("to"), "n").unionByName(
            edges.select(F.lit("distrust").alias("kind"), F.col("target").alias("from"), F.col("source").alias("to"), "n")
        )
        sums = steps.groupBy("kind", "from").agg(F.sum("n").alias("total"))
        steps = stored(steps.join(sums, ["kind", "from"]).select("kind", "from", "to", (F.col("n") / F.col("total")).alias("share")), "host-steps")
        added = base
        while True:
            moved = added.join(steps, (added["kind"] == steps["kind"]) & (added["host"] == steps["from"]))
            moved = moved.select(F.col("to").alias("host"), added["kind"], (F.col("value") * F.col("share") * damping).alias("value"))
            added = stored(moved.groupBy("host", "kind").agg(F.sum("value").alias("value")), "host-added")
            ranks = stored(ranks.unionByName(added).groupBy("host", "kind").agg(F.sum("value").alias("value")), "host-ranks")
            # Either kind may still grow by so much at one host.
            masses = [r["mass"] for r in added.groupBy("kind").agg(F.sum("value").alias("mass")).collect()]
            missing = max(masses, default=0.0) * damping / (1 - damping)
            if missing < 0.5 * 10**-DIGITS:
                break
            nearest = by_host(ranks).agg(F.min(F.abs(F.col("distrust") - F.col("trust") - threshold))).first()[0]
            if nearest is None or nearest > missing + 10**-DIGITS:
                break
    return by_host(ranks)


def by_host(ranks: DataFrame) -> DataFrame:
    def of(kind: str) -> Column:
        return F.round(F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("value"))), F.lit(0.0)), DIGITS).alias(kind)

    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...], damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule and verdict per row of `pages` (page_id, url, html)."""
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))

    def share(action: str, name: str) -> Column:
        return F.avg(F.when(F.col("fit.action") == action, 1.0).otherwise(0.0)).alias(name)

    seeds = judged.filter("host <> ''").groupBy("host").agg(share("allow", "trust"), share("block", "distrust"))
    found = propagate(seeds, host_edges(pages.select("url", "html")), damping, threshold)
    bad = stored(found.filter(F.col("distrust") - F.col("trust") >= threshold).select("host"), "bad-hosts")
    bad = bad.withColumn("bad", F.lit(True))
    judged = judged.join(small(bad), "host", "left")
    own = F.when(F.col("bad"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.action", own).alias("verdict"))
