"""URL filtering by trust and distrust that travel along host links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.registry import query, table
from colonnade.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# an absolute or protocol-relative target of a link in raw HTML
LINK = r"""(?i)href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"),
         Rule("block", "net", "/fr/")]


def host_of(url: Column) -> Column:
    """From the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or null. Rules are a short list of the caller's."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def domain_edges(hosts: DataFrame) -> DataFrame:
    """One link each way between a host and its parent domain, up to domains of two labels: a domain answers for its
    subdomains and they for it."""
    labels = F.split("host", r"\.")
    size = F.size(labels)
    pair = F.explode(F.transform(F.sequence(F.lit(1), size - 2), lambda i: F.struct(
        F.array_join(F.slice(labels, i, size), ".").alias("child"), F.array_join(F.slice(labels, i + 1, size), ".").alias("parent")))).alias("p")
    pairs = hosts.where(size >= 3).select(pair).select("p.*").distinct()
    return pairs.select(F.explode(F.array(F.struct(F.col("child").alias("source"), F.col("parent").alias("target")),
                                          F.struct(F.col("parent").alias("source"), F.col("child").alias("target")))).alias("e")).select("e.*", F.lit(1).cast("long").alias("links"))


def host_edges(pages: DataFrame) -> DataFrame:
    """Hyperlinks between different hosts: source, target and their number, from `host` and `html`."""
    link = F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("url")
    absolute = F.when(F.col("url").startswith("//"), F.concat(F.lit("x:"), F.col("url"))).otherwise(F.col("url"))
    return (pages.where(F.col("html").isNotNull()).select("host", link).select(F.col("host").alias("source"), host_of(absolute).alias("target"))
            .where((F.col("target") != "") & (F.col("source") != "") & (F.col("source") != F.col("target")))
            .groupBy("source", "target").agg(F.count(F.lit(1)).alias("links")))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = 10, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """host, trust and distrust: personalised PageRank from `seeds` (host, trusted, blocked) along the links for trust, and
    against them for distrust: who links to a blocked host is suspect, whom a trusted host links to is not.

    Both walks are rounds of one join and one sum. A host without links of its own passes nothing on. The table
    is written to the shared folder every `cut_every` rounds, so that a lost executor costs a few rounds at most."""
    trust = edges.select(F.lit("trusted").alias("kind"), F.col("source").alias("giver"), F.col("target").alias("taker"), "links")
    distrust = edges.select(F.lit("blocked").alias("kind"), F.col("target").alias("giver"), F.col("source").alias("taker"), "links")
    both = trust.unionByName(distrust)
    given = both.groupBy("kind", "giver").agg(F.sum("links").alias("all"))
    shares = stage(both.join(given, ["kind", "giver"]).select("kind", "giver", "taker", (F.col("links") / F.col("all")).alias("share")), "links")
    total = seeds.agg(*[F.greatest(F.sum(c), F.lit(1)).alias("all_" + c) for c in ("trusted", "blocked")])  # one row
    start = stage(seeds.join(F.broadcast(total), how="cross").select("host", F.explode(F.create_map(
        F.lit("trusted"), F.col("trusted") / F.col("all_trusted"), F.lit("blocked"), F.col("blocked") / F.col("all_blocked"))).alias("kind", "score"))
        .where("score > 0"), "seeds")
    score = start
    if not shares.isEmpty():
        for k in range(1, rounds + 1):
            sent = (score.withColumnRenamed("host", "giver").join(shares, ["kind", "giver"])
                    .select(F.col("taker").alias("host"), "kind", (F.lit(damping) * F.col("share") * F.col("score")).alias("score")))
            kept = start.select("host", "kind", (F.lit(1 - damping) * F.col("score")).alias("score"))
            score = sent.unionByName(kept).groupBy("host", "kind").agg(F.sum("score").alias("score"))
            if k % cut_every == 0:
                score = stage(score, "ranks")
    return score.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(name)
                                       for k, name in (("trusted", "trust"), ("blocked", "distrust"))])


def filter_urls(pages: DataFrame, rules: list[Rule] = RULES, least_distrust: float = 1e-9, margin: float = 1.0) -> DataFrame:
    """Verdict of every row of `pages` (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    The longest rule that fits decides. For other urls the host does, by links in html and between a domain and its subdomains: it is blocked if its distrust is at least `least_distrust` of
    the mean score that a blocked host starts with and more than `margin` times its trust: all scores shrink as hosts are added, so both limits are shares.
    Seeds are the hosts of pages under allow and block rules, by their number of such
    pages. Scores are rounded to 12 digits, for the verdict in units of that mean, so that the order of sums does not matter.

    Null urls and urls without :// have an empty host, which takes no part in links and is allowed; null html has no links;
    repeated rows count as often as they occur; no rows give no rows; further columns are ignored. Pages are counted per host before
    anything is shuffled; the verdict of a host comes back by a join that Spark broadcasts or splits by size."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    keyed = judged.withColumns({"rule": rule, "by_rule": verdict})
    seeds = stage(keyed.where("host <> ''").groupBy("host").agg(
        F.sum((F.col("by_rule") == "allow").cast("long")).alias("trusted"), F.sum((F.col("by_rule") == "block").cast("long")).alias("blocked"))
        .select("host", F.coalesce("trusted", F.lit(0)).alias("trusted"), F.coalesce("blocked", F.lit(0)).alias("blocked")), "hosts")
    edges = stage(host_edges(judged).unionByName(domain_edges(seeds)).groupBy("source", "target").agg(F.sum("links").alias("links")), "edges")
    hosts = seeds.agg(F.greatest(F.sum((F.col("blocked") > 0).cast("long")), F.lit(1)).alias("hosts"))  # one row
    trust, distrust = [F.round(F.col(c) * F.col("hosts"), 12) for c in ("trust", "distrust")]
    suspect = (distrust >= least_distrust) & (distrust > F.lit(margin) * trust)
    scores = stage(propagate(seeds, edges).join(F.broadcast(hosts), how="cross")
                   .select("host", *[F.round(c, 12).alias(c) for c in ("trust", "distrust")], suspect.alias("suspect")), "scores")
    out = keyed.select("page_id", "host", "path", "rule", "by_rule").join(scores, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_host = F.when(F.col("suspect"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def oracle(rules: list[Rule] = RULES, rounds: int = 10, damping: float = 0.85, least: float = 1e-9, margin: float = 1.0) -> str:
    """The same in DuckDB SQL, with the rounds written out."""
    fits = [(f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r) for r in sorted(rules, key=lambda r: -len(r.text))]
    case = lambda of: "CASE " + " ".join(f"WHEN {f} THEN '{of(r)}'" for f, r in fits) + " END"
    link = LINK.replace("'", "''")
    host = lambda u: f"translate(regexp_extract({u}, '^(?s).*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    steps = "".join(f"""
    s{k} AS (SELECT host, kind, sum(score) score FROM (
        SELECT taker AS host, h.kind, {damping} * share * score AS score FROM s{k - 1} s JOIN shares h ON h.kind = s.kind AND h.giver = s.host
        UNION ALL SELECT host, kind, {1 - damping} * score FROM s0) GROUP BY ALL),""" for k in range(1, rounds + 1))
    return f"""WITH judged AS (SELECT page_id, html, coalesce({host('url')}, '') AS host,
        coalesce(regexp_extract(url, '^(?s).*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    keyed AS (SELECT *, {case(lambda r: r.text)} AS rule, {case(lambda r: r.verdict)} AS by_rule FROM judged),
    links AS (SELECT host AS source, {host("CASE WHEN starts_with(u, '//') THEN 'x:' || u ELSE u END")} AS target FROM (
        SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS u FROM judged)),
    labels AS (SELECT DISTINCT string_split(host, '.') AS l FROM judged WHERE host <> ''),
    tree AS (SELECT DISTINCT array_to_string(l[i:], '.') AS child, array_to_string(l[i + 1:], '.') AS parent
        FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM labels WHERE len(l) >= 3)),
    edges AS (SELECT source, target, sum(n) AS n FROM (
        SELECT source, target, count(*) AS n FROM links WHERE target <> '' AND source <> '' AND source <> target GROUP BY ALL
        UNION ALL SELECT child, parent, 1 FROM tree UNION ALL SELECT parent, child, 1 FROM tree) GROUP BY ALL),
    both_ways AS (SELECT 'trusted' AS kind, source AS giver, target AS taker, n FROM edges
        UNION ALL SELECT 'blocked', target, source, n FROM edges),
    shares AS (SELECT kind, giver, taker, n / sum(n) OVER (PARTITION BY kind, giver) AS share FROM both_ways),
    seeds AS (SELECT host, kind, count(*) AS n FROM (SELECT host, CASE by_rule WHEN 'allow' THEN 'trusted' WHEN 'block' THEN 'blocked' END AS kind
        FROM keyed WHERE host <> '') WHERE kind IS NOT NULL GROUP BY ALL),
    s0 AS (SELECT host, kind, n / sum(n) OVER (PARTITION BY kind) AS score FROM seeds),{steps}
    last AS (SELECT * FROM s{rounds} WHERE EXISTS (FROM shares) UNION ALL SELECT * FROM s0 WHERE NOT EXISTS (FROM shares)),
    hosts AS (SELECT greatest(count(*), 1) AS hosts FROM seeds WHERE kind = 'blocked'),
    sums AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trusted'), 0) AS t, coalesce(sum(score) FILTER (kind = 'blocked'), 0) AS d FROM last GROUP BY host),
    scores AS (SELECT host, round(t, 12) AS trust, round(d, 12) AS distrust,
        round(d * hosts, 12) >= {least} AND round(d * hosts, 12) > {margin} * round(t * hosts, 12) AS suspect FROM sums, hosts)
    SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN suspect THEN 'block' ELSE 'allow' END) AS verdict,
        coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM keyed LEFT JOIN scores USING (host)"""


@query("op10_link_propagation", oracle())
def op10_link_propagation(spark: SparkSession, folder: str) -> DataFrame:
    """Rule or link verdict of every page."""
    return filter_urls(table(spark, folder, "pages"))
