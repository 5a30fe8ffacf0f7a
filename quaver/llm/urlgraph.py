"""URL filters by link-graph propagation (DataFrame functions only).

Explicit rules (host suffix and path prefix, longest wins) decide what they fit.
Everything else is judged by its host: trust is a personalised PageRank over
host -> host edges from trusted seeds, distrust the same over reversed edges
from blocked seeds, and a host whose share of distrust reaches ``ratio`` is
blocked.  A host's seed mass is the share of its pages that a rule allows or
blocks; hosts under the domains given as ``good`` or ``bad`` are seeds of mass 1.
Both walks start from these masses as they are, on one scale, so the rest of the
corpus does not sway a host that no link reaches, and both run until they settle.

Edges are the links in the pages, one for each page that links to a host, and one
from every host to each domain above it that is a host as well: a subdomain speaks
for its parents, so trust flows up to them, and a parent's distrust flows down.
Names of one label (``com``) and the address of a page's own host are no edges.

Pages are reduced to distinct weighted host edges before anything iterates; a
host that holds a third of all pages is combined on the map side.

Edge cases: a null url or one without ``://`` has an empty host and path and is
allowed; a null html has no links; a very long html is searched whole; hosts without
seeds in reach score 0 and are allowed; a tie of trust and distrust blocks; repeated
rows are judged alike, and count as often as they occur; null page ids are kept as
they are; an empty table gives no rows; columns other than page_id, url and html are
not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.llm.shared import discard, materialise


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
TOLERANCE, DAMPING, RATIO, DIGITS = 1e-6, 0.85, 0.5, 9  # significant digits
#: Rounds of a walk whose gains are kept apart before they are added up.
FOLD = 12
HREF = r"(?i)href\s*=\s*[\"']?([a-z][a-z0-9+.-]*://[^\"'\s>]+)"


def fold_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return fold_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def under(host: Column, domain: str) -> Column:
    return (host == domain) | host.endswith("." + domain)


def match_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rule`` and ``rule_verdict`` by host and path; the longest fitting rule, then the longer host."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        fits = under(F.col("host"), r.host) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def significant(c: Column) -> Column:
    """Rounded to DIGITS significant digits: no floor, however small the scores of a large graph get."""
    return F.format_string(f"%.{DIGITS - 1}e", c.cast("double")).cast("double")


def rank(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank, settled: (host, score) from ``seeds`` (host, mass), one row for each of its hosts.

    ``edges`` (src, dst, weight).  Each round sends on what the hosts got in the round before and adds it to their
    scores, so a score is a sum over walks, and a round only costs the hosts that the walk has reached.  What is on
    its way shrinks by ``damping`` at least each round; the walk ends when all of it together is at most ``tolerance``
    of the seeds' mass, or of one full seed where they hold more.  No score is then short by more than that, whatever
    the size of the graph.  Scores are in units of ``mass``.  Mass that reaches a host without outgoing edges leaves
    the walk.  What moves is rounded to DIGITS significant digits, so the result does not hang on the order of additions.
    """
    seeds = materialise(seeds.select("host", significant(F.col("mass")).alias("p")), "seeds")
    total = float(seeds.agg(F.sum("p")).first()[0] or 0.0)
    out_weight = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    norm = materialise(edges.join(out_weight, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")), "edges")
    moving = seeds.where("p > 0").select("host", ((1 - damping) * F.col("p")).alias("got"))
    parts, spent = [moving], []
    # so many rounds leave damping ** rounds of the mass; without cycles it is over earlier
    most = math.ceil(math.log(max(total, 1.0) / tolerance) / -math.log(damping)) + 1
    for _ in range(most if total else 0):
        flow = norm.join(moving, norm.src == moving.host).groupBy("dst").agg(F.sum(F.col("got") * F.col("share")).alias("sum"))
        moving = materialise(flow.select(F.col("dst").alias("host"), significant(damping * F.col("sum")).alias("got")), "moving")
        parts.append(moving)
        if float(moving.agg(F.sum("got")).first()[0] or 0.0) <= tolerance * min(total, 1.0):
            break
        if len(parts) > FOLD:
            spent += parts[:-1]
            parts = [materialise(_total(parts[:-1]), "scores"), moving]
    out = seeds.join(_total(parts).withColumnRenamed("host", "_host"), F.col("host") == F.col("_host"), "left")
    out = materialise(out.select("host", significant(F.coalesce("got", F.lit(0.0))).alias("score")), "rank")
    discard(seeds, norm, *(x for x in {id(x): x for x in [*spent, *parts]}.values() if hasattr(x, "_quaver_folder")))
    return out


def _total(parts: Sequence[DataFrame]) -> DataFrame:
    """(host, got) summed over ``parts``."""
    return reduce(DataFrame.unionAll, parts).groupBy("host").agg(F.sum("got").alias("got"))


def host_edges(df: DataFrame) -> DataFrame:
    """(src, dst, weight): links between hosts, self links by relative or own addresses left out."""
    to = df.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(HREF), 1), host_of))).alias("dst"))
    return to.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def domain_edges(hosts: DataFrame) -> DataFrame:
    """(src, dst, weight): from every host of ``hosts`` to each of its parent domains that is a host, too."""
    label = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(2), F.greatest(F.size(label) - 1, F.lit(2))), lambda i: F.array_join(F.slice(label, i, F.size(label)), "."))
    up = hosts.where(F.size(label) > 2).select(F.col("host").alias("src"), F.explode(above).alias("dst")).where(F.col("dst").contains("."))
    return up.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").select("src", "dst", F.lit(1.0).alias("weight"))


def seeds(judged: DataFrame, good: Sequence[str], bad: Sequence[str]) -> DataFrame:
    """(host, good, evil) of every host with pages: ``judged`` has host and rule_verdict."""
    share = lambda verdict: F.count_if(F.col("rule_verdict") == verdict) / F.count(F.lit(1))
    hosts = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("evil"))
    known = lambda domains: F.coalesce(*[F.when(under(F.col("host"), d), True) for d in domains], F.lit(False))
    given = known(good) | known(bad)
    one = lambda c, domains: significant(F.when(given, known(domains).cast("double")).otherwise(F.col(c))).alias(c)
    return hosts.select("host", one("good", good), one("evil", bad))


def host_scores(pages: DataFrame, rules: Sequence[Rule] = RULES, good: Sequence[str] = (), bad: Sequence[str] = (), ratio: float = RATIO) -> DataFrame:
    """(host, trust, distrust, blocked) of every host that has pages or links."""
    judged = match_rules(pages.select("html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    links = materialise(host_edges(judged), "hostlinks")
    hosts = materialise(seeds(judged, good, bad), "seeds")
    linked = links.select(F.col("dst").alias("host")).distinct().join(hosts, "host", "left_anti")
    known = lambda domains: F.coalesce(*[F.when(under(F.col("host"), d), 1.0) for d in domains], F.lit(0.0))
    hosts = materialise(hosts.unionByName(linked.select("host", known(good).alias("good"), known(bad).alias("evil"))), "hosts")
    edges = materialise(links.union(domain_edges(hosts)).groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "hostedges")
    trust = rank(edges, hosts.select("host", F.col("good").alias("mass")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = rank(back, hosts.select("host", F.col("evil").alias("mass")))
    both = hosts.select("host").join(trust.withColumnRenamed("score", "trust"), "host").join(distrust.withColumnRenamed("score", "distrust"), "host")
    total = F.col("trust") + F.col("distrust")
    return both.withColumn("blocked", (F.col("distrust") > 0) & (F.col("distrust") >= ratio * total))


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, good: Sequence[str] = (), bad: Sequence[str] = (), ratio: float = RATIO) -> DataFrame:
    """Every page with host, path, rule, verdict, and the host's trust and distrust."""
    scores = materialise(host_scores(pages, rules, good, bad, ratio), "hostscores")
    judged = match_rules(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    out = judged.join(scores.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host"), "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def q_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
