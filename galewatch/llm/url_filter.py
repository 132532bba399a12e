"""URL filtering by rules and by the reputation of hosts.

What a rule says about a url holds. Other urls are judged by their host: of labelled pages some are bad, and a host's share
of bad pages is a beta-binomial unknown whose prior comes from its registered domain, the domain's from its public suffix,
and the suffix's from all labelled pages. How strongly a level's priors hold is fitted to the data (empirical Bayes, by
moments): where a parent's children differ no more than chance, a host is judged as its domain; where they differ, by its
own pages. A host is blocked if the lower bound of its posterior share of bad pages reaches a threshold.

Everything is column expressions, aggregates and joins. What pages are joined by may be hot: the most frequent keys are
looked up in a broadcast table of as many rows at most, the others by a shuffle.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, unused

#: Keys that are joined apart by broadcast, at most, and the rows that make one worth it.
HOT, HOT_ROWS = 1000, 256
#: Rules are held in the plan.
MOST_RULES = 1000
#: Second labels below which names are registered where the last label has two letters (co.uk).
SECOND = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")
#: The bound's distance from the mean in standard deviations (one in ten lies below), and the share of bad pages that blocks.
Z, THRESHOLD = 1.2815515655446004, 0.5
#: Correlation of the pages of one parent's child: what is fitted is kept within these, and stands at DEFAULT without data.
RHO_LEAST, RHO_MOST, RHO_DEFAULT = 0.001, 0.5, 0.1

#: SQL that Spark and others read alike: derivatives of the log gamma function by six steps up and a series.
DIGAMMA = "(ln({x} + 6) - 0.5 / ({x} + 6) - 1 / (12 * ({x} + 6) * ({x} + 6)) + 1 / (120 * pow({x} + 6, 4)) - 1 / (252 * pow({x} + 6, 6)) - 1 / {x} - 1 / ({x} + 1) - 1 / ({x} + 2) - 1 / ({x} + 3) - 1 / ({x} + 4) - 1 / ({x} + 5))"
TRIGAMMA = "(1 / ({x} + 6) + 0.5 / pow({x} + 6, 2) + 1 / (6 * pow({x} + 6, 3)) - 1 / (30 * pow({x} + 6, 5)) + 1 / (42 * pow({x} + 6, 7)) + 1 / ({x} * {x}) + 1 / pow({x} + 1, 2) + 1 / pow({x} + 2, 2) + 1 / pow({x} + 3, 2) + 1 / pow({x} + 4, 2) + 1 / pow({x} + 5, 2))"


def bound_sql(a: str, b: str, z: float = Z) -> str:
    """The lower bound of Beta(a, b): of the normal distribution that has its mean and variance on the logit scale (within 0.03 of the quantile where a and b are 1 or more)."""
    mean = f"({DIGAMMA.format(x=a)} - {DIGAMMA.format(x=b)})"
    return f"1 / (1 + exp({z}D * sqrt({TRIGAMMA.format(x=a)} + {TRIGAMMA.format(x=b)}) - {mean}))"


def host_of(url: Column) -> Column:
    """What is between the first :// and the next /, ? or #, with A-Z in lower case; empty for null and without ://."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """The registered domain and the public suffix of a host, without user names, ports and final dots; addresses in digits are their own domain, with an empty suffix."""
    site = F.rtrim(F.substring_index(F.substring_index(host, "@", -1), ":", 1), F.lit("."))
    last = F.split(F.substring_index(site, ".", -3), "\\.")
    two = (F.size(last) == 3) & last[1].isin(*SECOND) & (F.length(F.element_at(last, -1)) == 2)
    number = site.rlike("^[0-9.]*$")
    domain = F.when(number | two, F.when(number, site).otherwise(F.array_join(last, "."))).otherwise(F.substring_index(site, ".", -2))
    suffix = F.when(number, "").when(two, F.substring_index(site, ".", -2)).otherwise(F.substring_index(site, ".", -1))
    return domain, suffix


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str]], host: str = "host", path: str = "path") -> DataFrame:
    """pages with rule and ruling (null without one): the longest that fits.

    rules are (verdict, "host/path"). A rule fits its host and what is below it, where the path starts with the rule's. Of
    equally long rules the one with the longer host is first, and block is before allow.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"there may be {MOST_RULES} rules at most")
    if not rules:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "ruling": F.lit(None).cast("string")})
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, rule in rules:
        name = rule.split("/", 1)[0]
        by_host.setdefault(name, []).append((rule, verdict))
    entry = lambda rule, verdict, name: F.struct(
        F.lit(len(rule)).alias("size"), F.lit(len(name)).alias("inner"), F.lit(int(verdict == "block")).alias("block"), F.lit(rule).alias("rule"), F.lit(rule[len(name) :]).alias("path"), F.lit(verdict).alias("verdict")
    )
    table = F.create_map(*(c for name, own in by_host.items() for c in (F.lit(name), F.array(*(entry(r, v, name) for r, v in own)))))
    # No more of a host's end than the longest rule has labels: a host of any length costs the same.
    most = max(name.count(".") for name in by_host) + 1
    labels = F.split(F.substring_index(F.col(host), ".", -most), "\\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.transform(ends, lambda e: F.coalesce(F.try_element_at(table, e), F.array().cast("array<struct<size:int,inner:int,block:int,rule:string,path:string,verdict:string>>"))))
    best = F.array_max(F.filter(found, lambda r: F.startswith(F.col(path), r["path"])))
    out = unused("_best", pages)
    return pages.withColumn(out, best).withColumns({"rule": F.col(out)["rule"], "ruling": F.col(out)["verdict"]}).drop(out)


def looked_up(left: DataFrame, right: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """left with right's other columns (null without a row of that key); right has a row a key.

    The most frequent keys of left, `hot` at most, are looked up by broadcast, so that no task gets a key's rows; the rest by a shuffle.
    """
    flag = unused("_hot", left, right)
    top = left.groupBy(key).agg(F.count("*").alias(flag)).filter(F.col(flag) >= HOT_ROWS).orderBy(F.desc(flag), key).limit(hot)
    top = settled(top.select(key, F.lit(True).alias(flag)))
    marked = left.join(F.broadcast(top), key, "left")
    few = right.join(F.broadcast(top.select(key)), key, "left_semi")
    often = marked.filter(F.col(flag).isNotNull()).drop(flag).join(F.broadcast(few), key, "left")
    rarely = marked.filter(F.col(flag).isNull()).drop(flag).join(right, key, "left")
    return often.unionByName(rarely)


def _spread(children: DataFrame, parent: Sequence[str], level: str) -> DataFrame:
    """level, up, down: the moments whose ratio is the correlation of pages within a child, over all parents."""
    per = children.filter("n > 0").groupBy(*parent).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("k"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("between"))
    share = F.col("bad") / F.col("n")
    v = share * (1 - share)
    up = F.col("between") - F.col("bad") * share - v * (F.col("k") - 1)
    down = v * (F.col("n") - F.col("squares") / F.col("n") - F.col("k") + 1)
    return per.agg(F.lit(level).alias("level"), F.sum(up).alias("up"), F.sum(down).alias("down"))


def _strength(up: float | None, down: float | None) -> float:
    """A prior's weight in pages."""
    rho = min(RHO_MOST, max(RHO_LEAST, up / down)) if down and down > 1e-9 else RHO_DEFAULT
    return (1 - rho) / rho


def reputations(hosts: DataFrame, outcomes: DataFrame, z: float = Z) -> DataFrame:
    """host, labelled, bad_share, bound, for each different host of hosts and outcomes.

    outcomes: host, n labelled pages of which bad are bad; several rows of a host add up. bad_share and bound are the
    posterior's mean and lower bound. A host without a labelled page is judged by its domain, that by its suffix. Null hosts
    are one without a name. Without any outcome the share is a half, with a bound below it.
    """
    rows = hosts.select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad")).unionByName(outcomes.select("host", F.col("n").cast("long").alias("n"), F.col("bad").cast("long").alias("bad")))
    per = rows.groupBy(F.coalesce("host", F.lit("")).alias("host")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domain, suffix = domain_and_suffix(F.col("host"))
    per = settled(per.withColumns({"domain": domain, "suffix": suffix}))
    add = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    # A registered domain has one suffix.
    domains = per.groupBy("domain", "suffix").agg(*add)
    suffixes = domains.groupBy("suffix").agg(*add)
    spreads = _spread(per, ["domain", "suffix"], "host").unionByName(_spread(domains, ["suffix"], "domain")).unionByName(_spread(suffixes, [], "suffix"))
    found = {r["level"]: _strength(r["up"], r["down"]) for r in spreads.collect()}
    whole = per.agg(*add).first()
    mean = ((whole["bad"] or 0) + 1.0) / ((whole["n"] or 0) + 2.0)

    def shrunk(prior: Column, weight: float) -> Column:
        return (F.col("bad") + prior * weight) / (F.col("n") + weight)

    of_suffix = suffixes.select("suffix", shrunk(F.lit(mean), found["suffix"]).alias("above"))
    of_domain = looked_up(domains, of_suffix, "suffix").select("domain", shrunk(F.col("above"), found["domain"]).alias("above"))
    weight = found["host"]
    judged = looked_up(per, of_domain, "domain").withColumns({"_a": F.col("bad") + F.col("above") * weight, "_b": F.col("n") - F.col("bad") + (1 - F.col("above")) * weight})
    return judged.select("host", F.col("n").alias("labelled"), (F.col("_a") / (F.col("_a") + F.col("_b"))).alias("bad_share"), F.expr(bound_sql("_a", "_b", z)).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), z: float = Z, threshold: float = THRESHOLD, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, labelled, bound: a row a page, repeated rows and null ids among them.

    verdict is the rule's where one fits (labelled and bound are null there); else block where the host's bound reaches
    the threshold, else allow. A url that is null, or without ://, has an empty host and path, is fitted by no rule, and is
    judged like a host without a name. Urls of any length take time that grows with it. An empty table gives no rows. Other columns aren't read.
    """
    parts = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("_url"))
    parts = parts.select("page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    parts = ruled(parts, rules)
    free = parts.filter("ruling is null")
    known = settled(reputations(free.select("host").distinct(), outcomes, z).select("host", "labelled", "bound"))
    judged = looked_up(free, known, "host").withColumn("ruling", F.when(F.col("bound") >= threshold, "block").otherwise("allow"))
    fixed = parts.filter("ruling is not null").withColumns({"labelled": F.lit(None).cast("long"), "bound": F.lit(None).cast("double")})
    return judged.unionByName(fixed).select("page_id", "host", "path", "rule", F.col("ruling").alias("verdict"), "labelled", "bound")


def outcomes_of(pages: DataFrame, labels: DataFrame, number: str = "/([0-9]+)(?:\\.[a-z]+)?/?$", url: str = "url") -> DataFrame:
    """host, n, bad: labelled pages of each host, by the number of their document that ends the path.

    labels: doc_id, quality, toxic. A document of which a label says that its quality is 0, or that it is toxic, is bad; one
    whose labels are all null isn't labelled. Pages are counted before they are joined.
    """
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    # The number is looked for in the path's end alone, so that a long path isn't searched again and again.
    numbered = pages.select(host_of(u).alias("host"), F.regexp_extract(F.right(path_of(u), F.lit(64)), number, 1).try_cast("long").alias("doc_id"))
    counts = numbered.filter("doc_id is not null").groupBy("host", "doc_id").agg(F.count("*").alias("n"))
    marks = labels.select("doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0).alias("is_bad"))
    marks = marks.filter("doc_id is not null and is_bad is not null").groupBy("doc_id").agg(F.max("is_bad").alias("is_bad"))
    met = looked_up(counts, marks, "doc_id").filter("is_bad is not null")
    return met.groupBy("host").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("is_bad")).alias("bad"))


def oracle(rules: Sequence[tuple[str, str]], z: float = Z, threshold: float = THRESHOLD, places: int = 6) -> str:
    """The same as SQL over pages and labels."""

    def fits(rule: str) -> str:
        host, path = rule.split("/", 1)
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"

    best = sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].split("/")[0]), r[0] != "block"))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in best)
    ruling = " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in best)
    second = ", ".join(f"'{s}'" for s in SECOND)
    spread = lambda table, parent, level: f"""SELECT '{level}' AS level, coalesce(CASE WHEN sum(down) > 1e-9 THEN least({RHO_MOST}, greatest({RHO_LEAST}, sum(up) / sum(down))) END, {RHO_DEFAULT}) AS rho FROM (
        SELECT s - bad * p - p * (1 - p) * (k - 1) AS up, p * (1 - p) * (n - q / n - k + 1) AS down FROM (SELECT *, bad::DOUBLE / n AS p FROM (
        SELECT sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, count(*) AS k, sum(n::DOUBLE * n) AS q, sum(bad::DOUBLE * bad / n) AS s FROM {table} WHERE n > 0 {'GROUP BY ' + parent if parent else 'HAVING count(*) > 0'})))"""  # noqa: E731
    return f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE {rule} END AS rule, try_cast(nullif(regexp_extract(right(path, 64), '/([0-9]+)(?:\\.[a-z]+)?/?$', 1), '') AS BIGINT) AS doc_id FROM h),
m AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS is_bad FROM labels GROUP BY doc_id),
o AS (SELECT r.host, count(*) AS n, sum(is_bad)::BIGINT AS bad FROM r JOIN m ON r.doc_id = m.doc_id WHERE is_bad IS NOT NULL GROUP BY 1),
d0 AS (SELECT DISTINCT host FROM r WHERE rule IS NULL UNION SELECT host FROM o),
d1 AS (SELECT d0.host, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, rtrim(string_split(string_split(d0.host, '@')[-1], ':')[1], '.') AS site FROM d0 LEFT JOIN o ON d0.host = o.host),
d2 AS (SELECT *, string_split(site, '.') AS l, regexp_matches(site, '^[0-9.]*$') AS number FROM d1),
d3 AS (SELECT *, len(l) >= 3 AND l[-2] IN ({second}) AND length(l[-1]) = 2 AS two FROM d2),
per AS (SELECT host, n, bad, CASE WHEN number THEN site WHEN two THEN l[-3] || '.' || l[-2] || '.' || l[-1] WHEN len(l) > 1 THEN l[-2] || '.' || l[-1] ELSE site END AS domain,
    CASE WHEN number THEN '' WHEN two THEN l[-2] || '.' || l[-1] ELSE l[-1] END AS suffix FROM d3),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM per GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains GROUP BY 1),
rho AS ({spread('per', 'domain, suffix', 'host')} UNION ALL {spread('domains', 'suffix', 'domain')} UNION ALL {spread('suffixes', '', 'suffix')}),
w AS (SELECT max(CASE WHEN level = 'host' THEN (1 - rho) / rho END) AS wh, max(CASE WHEN level = 'domain' THEN (1 - rho) / rho END) AS wd, max(CASE WHEN level = 'suffix' THEN (1 - rho) / rho END) AS ws FROM rho),
top AS (SELECT (coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2.0::DOUBLE) AS mean FROM per),
s AS (SELECT suffix, (bad + mean * ws) / (n + ws) AS above FROM suffixes, top, w),
d AS (SELECT domain, (bad + above * wd) / (n + wd) AS above FROM domains, s, w WHERE domains.suffix = s.suffix),
ab AS (SELECT host, n AS labelled, bad + above * wh AS a, n - bad + (1 - above) * wh AS b FROM per, d, w WHERE per.domain = d.domain),
k AS (SELECT host, labelled, {bound_sql('a', 'b', z).replace(f'{z}D', f'{z}::DOUBLE')} AS bound FROM ab)
SELECT page_id, r.host, path, rule, CASE rule {ruling} ELSE CASE WHEN bound >= {threshold} THEN 'block' ELSE 'allow' END END AS verdict,
    CASE WHEN rule IS NULL THEN labelled END AS labelled, round(CASE WHEN rule IS NULL THEN bound END, {places}) + 0.0 AS bound
FROM r LEFT JOIN k ON r.host = k.host"""
