import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from galewatch.llm import url_filter
from galewatch.llm.queries import URL_RULES


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def names(host):
    site = host.split("@")[-1].split(":")[0].rstrip(".")
    labels = site.split(".")
    if re.fullmatch(r"[0-9.]*", site):
        return site, ""
    if len(labels) > 2 and labels[-2] in url_filter.SECOND and len(labels[-1]) == 2:
        return ".".join(labels[-3:]), ".".join(labels[-2:])
    return ".".join(labels[-2:]), labels[-1]


def psi(x, order):
    """Derivatives of the log gamma function, far up by recurrence."""
    total = 0.0
    while x < 60:
        total += -1 / x if not order else 1 / x**2
        x += 1
    return total + (math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) if not order else 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5))


def bound(a, b, z=url_filter.Z):
    m, v = psi(a, 0) - psi(b, 0), psi(a, 1) + psi(b, 1)
    return 1 / (1 + math.exp(z * math.sqrt(v) - m))


def strength(groups):
    up = down = 0.0
    for rows in groups:
        n, bad = sum(r[0] for r in rows), sum(r[1] for r in rows)
        p = bad / n
        v = p * (1 - p)
        up += sum(k * (b / k - p) ** 2 for k, b in rows) - v * (len(rows) - 1)
        down += v * (n - sum(k * k for k, _ in rows) / n - len(rows) + 1)
    rho = min(0.5, max(0.001, up / down)) if down > 1e-9 else 0.1
    return (1 - rho) / rho


def plain(hosts, outcomes):
    """host -> (labelled, share, bound), with dictionaries."""
    own = {h or "": [0, 0] for h in hosts}
    for h, n, bad in outcomes:
        one = own.setdefault(h or "", [0, 0])
        one[0] += n
        one[1] += bad
    domains, suffixes = {}, {}
    for h, (n, bad) in own.items():
        d, s = names(h)
        domains.setdefault((d, s), []).append((n, bad))
    for (_, s), rows in domains.items():
        suffixes.setdefault(s, []).append((sum(r[0] for r in rows), sum(r[1] for r in rows)))
    some = lambda groups: [g for g in ([r for r in rows if r[0]] for rows in groups) if g]
    add = lambda rows: (sum(r[0] for r in rows), sum(r[1] for r in rows))
    w_host, w_domain, w_suffix = strength(some(domains.values())), strength(some(suffixes.values())), strength(some([[add(r) for r in suffixes.values()]]))
    n, bad = add(own.values())
    mean, out = (bad + 1) / (n + 2), {}
    for h, (n, bad) in own.items():
        d, s = names(h)
        for rows, w in ((suffixes[s], w_suffix), (domains[d, s], w_domain)):
            k, b = add(rows)
            above = ((b + (mean if w is w_suffix and rows is suffixes[s] else above) * w)) / (k + w)
        a, b = bad + above * w_host, n - bad + (1 - above) * w_host
        out[h] = (n, a / (a + b), bound(a, b))
    return out


def fitting(host, path, rules):
    fits = [(len(r), len(r.split("/")[0]), v == "block", r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]) :])]
    return max(fits)[3:] if fits else (None, None)


ODD_URLS = [
    None, "", "no scheme.com/a", "http://", "http://Ex.Example.NET/en/5?x#y", "https://a.b.co.uk/fr/1", "http://net/", "http://xnet/", "http://a.net", "http://a.net?x=/", "http://user@host.org:80/fr/2", "x://y://z/p",
    "http://ä.org/fr/ß", "http://EXAMPLE.com/de/", "http://sub.example.com/DE/", "http://sub.example.com./de/", "http://1.2.3.4/de/3", "http://example.net/en/../", "http://a.example.net/en", "http://" + "a." * 3000 + "org/fr/" + "p/" * 3000,
]


def test_urls_and_rules(spark):
    rows = [(i, u, "clash", "x") for i, u in enumerate(ODD_URLS)] + [(None, ODD_URLS[4], "clash", "x"), (3, ODD_URLS[3], "clash", "x"), (3, ODD_URLS[3], "clash", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, ruling string")
    nothing = spark.createDataFrame([], "host string, n long, bad long")
    out = url_filter.judge(pages, nothing, URL_RULES).collect()
    found = sorted(((r["page_id"] is None, r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in out)
    want = []
    for i, u, *_ in rows:
        host, path = split_url(u)
        rule, verdict = fitting(host, path, URL_RULES)
        want.append(((i is None, i), host, path, rule, verdict or "allow"))
    assert found == sorted(want)
    assert len({r[3] for r in want}) == 5


def test_ties_of_rules(spark):
    rules = [("allow", "b.c/x/"), ("block", "b.c/x/"), ("block", "c/xx/y"), ("allow", "a.b.c/")]
    assert url_filter.ruled(spark.createDataFrame([("q.b.c", "/x/1"), ("d.c", "/xx/y"), ("a.b.c", "/x/z")], "host string, path string"), rules).select("rule", "ruling").collect() == [("b.c/x/", "block"), ("c/xx/y", "block"), ("a.b.c/", "allow")]
    with pytest.raises(ValueError, match="rules at most"):
        url_filter.ruled(spark.range(1), [("allow", f"h{i}/") for i in range(1001)])


def test_reputations_as_a_plain_version(spark):
    rng = np.random.default_rng(4)
    hosts, outcomes = [], []
    for d in range(30):
        rate = rng.beta(0.6, 2)
        for h in range(int(rng.integers(1, 9))):
            host = f"h{h}.d{d}.{('com', 'co.uk', 'org')[d % 3]}"
            hosts.append(host)
            if rng.random() < 0.8:
                n = int(rng.integers(1, 60))
                outcomes += [(host, n, int(rng.binomial(n, rate))), (host, 1, 0)]
    hosts += [None, "", "10.0.0.7", "alone", "unseen.d3.com", "unseen.elsewhere.net"]
    got = url_filter.reputations(spark.createDataFrame([(h,) for h in hosts], "host string"), spark.createDataFrame(outcomes, "host string, n long, bad long")).collect()
    want = plain(hosts, outcomes)
    assert {r["host"] for r in got} == set(want) and len(got) == len(want)
    for r in got:
        n, share, low = want[r["host"]]
        assert r["labelled"] == n and r["bad_share"] == pytest.approx(share, rel=1e-9) and r["bound"] == pytest.approx(low, rel=1e-7)


def test_shrinking_beats_shares_as_counted(spark):
    rng = np.random.default_rng(8)
    truth, outcomes = {}, []
    for d in range(60):
        mean = rng.beta(0.8, 2)
        for h in range(12):
            p = rng.beta(mean * 15, (1 - mean) * 15)
            truth[f"h{h}.d{d}.com"] = p
            n = int(rng.integers(1, 6))
            outcomes.append((f"h{h}.d{d}.com", n, int(rng.binomial(n, p))))
    table = spark.createDataFrame(outcomes, "host string, n long, bad long")
    got = {r["host"]: r["bad_share"] for r in url_filter.reputations(table.select("host"), table).collect()}
    error = lambda share: np.mean([(share(h) - p) ** 2 for h, p in truth.items()])
    raw = {h: bad / n for h, n, bad in outcomes}
    assert error(got.get) < 0.6 * error(raw.get)


@pytest.mark.parametrize("a,b", [(1.0, 1.0), (2.5, 7.0), (9.0, 1.5), (40.0, 60.0), (400.0, 20.0)])
def test_bound_is_near_the_quantile(spark, a, b):
    x = np.linspace(0, 1, 200_001)[1:-1]
    w = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - ((a - 1) * np.log(x) + (b - 1) * np.log1p(-x)).max())
    exact = x[np.searchsorted(np.cumsum(w) / w.sum(), 0.1)]
    found = spark.range(1).select(F.lit(a).alias("a"), F.lit(b).alias("b")).select(F.expr(url_filter.bound_sql("a", "b"))).first()[0]
    assert found == pytest.approx(exact, abs=0.03)


def test_bad_hosts_and_domains_are_blocked_and_clean_ones_kept(spark):
    outcomes = [(f"h{i}.bad.com", 20, 19) for i in range(8)] + [(f"h{i}.good.org", 20, 1) for i in range(40)] + [("one.good.org", 9, 9), ("few.org", 1, 1)]
    pages = [(i, f"http://{h}/p/{i}") for i, h in enumerate(["h1.bad.com", "new.bad.com", "h3.good.org", "new.good.org", "few.org", "new.net"])]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "host string, n long, bad long"))
    assert [r["verdict"] for r in got.orderBy("page_id").collect()] == ["block", "block", "allow", "allow", "allow", "allow"]


def test_labelled_outcomes(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/5"), (2, "http://A.com/x/5.html?y"), (3, "http://b.com/7/"), (4, "http://b.com/8"), (5, "http://b.com/99999999999999999999"), (6, None), (7, "http://b.com/6x")], "page_id long, url string")
    labels = spark.createDataFrame([(5, 0, 0), (5, 1, None), (7, 1, 1), (8, None, None), (None, 0, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, url_filter.outcomes_of(pages, labels).collect())) == [("a.com", 2, 2), ("b.com", 1, 1)]
    assert url_filter.judge(pages.limit(0), url_filter.outcomes_of(pages, labels.limit(0)), URL_RULES).count() == 0


def test_hot_keys_are_looked_up_apart(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") < 2000, "hot").when(F.col("id") < 2900, F.concat(F.lit("k"), F.col("id") % 300)).alias("key"))
    right = spark.createDataFrame([("hot", 1), ("k5", 2), (None, 9)], "key string, v int")
    out = url_filter.looked_up(left, right, "key")
    assert out.count() == 3000
    assert {(r["key"], r["v"]): r["count"] for r in out.groupBy("key", "v").count().collect() if r["v"]} == {("hot", 1): 2000, ("k5", 2): 3}
    assert out.filter("key is null and v is null").count() == 100
