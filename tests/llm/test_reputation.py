import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hostledger.llm import queries
from hostledger.llm.reputation import Prior, Rule, domain_of, host_reputation, judge_urls, suffix_of, url_host, url_path


def column(spark, expr, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_parts(spark):
    urls = ["HTTP://A.Com/x?y#z", "http://ÄB.com", "http://h:80?q", "x://u@h#f", "no", None, "", "a://b://c/d", "http:///p", "://h\n/p"]
    assert column(spark, url_host, urls) == ["a.com", "Äb.com", "h:80", "u@h", "", "", "", "b:", "", "h\n"]
    assert column(spark, url_path, urls) == ["/x", "", "", "", "", "", "", "//c/d", "/p", "/p"]
    hosts = ["a.b.example.com", "x.co.uk", "www.x.co.uk", "localhost", "u@h.net:81", "10.0.0.1", ""]
    assert column(spark, domain_of, hosts) == ["example.com", "x.co.uk", "x.co.uk", "localhost", "h.net", "10.0.0.1", ""]
    assert column(spark, suffix_of, hosts) == ["com", "co.uk", "co.uk", "localhost", "net", "", ""]


def test_longest_rule_wins(frame):
    urls = {
        "http://example.com/en/x": ("example.com/en/", "block"), "http://www.example.com/en/": ("www.example.com/en/", "allow"),
        "http://a.www.example.com/en/": ("www.example.com/en/", "allow"), "http://myexample.com/en/": ("com/", "allow"),
        "http://com/": ("com/", "allow"), "http://x.com": (None, None), "http://x.com/en": ("com/", "allow"),
        "http://a.net/es/": ("net/es/", "block"), "http://a.net/es": (None, None), "http://a.org/fr/": (None, None), None: (None, None),
    }
    rows = judge_urls(frame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), queries.URL_RULES).collect()
    assert len(rows) == len(urls)
    for r in rows:
        rule, verdict = list(urls.values())[r.page_id]
        assert r.rule == rule and (verdict is None or r.verdict == verdict) and r.verdict in ("allow", "block")


def by_hand(hosts, prior):
    """host -> (mean, upper) for host -> (domain, suffix, n, good)."""
    levels = [defaultdict(lambda: [0, 0]) for _ in range(3)]
    for host, (domain, suffix, n, good) in hosts.items():
        for level, key in zip(levels, (suffix, (domain, suffix), host), strict=True):
            level[key][0] += n
            level[key][1] += good
    strengths = []
    for level in levels:
        seen = [(n, k) for n, k in level.values() if n]
        a = sum(n for n, _ in seen)
        p = sum(k for _, k in seen) / a
        room = a - sum(n * n for n, _ in seen) / a - (len(seen) - 1)
        if 0 < p < 1 and len(seen) > 1 and room > 1e-9:
            rho = (sum(n * (k / n - p) ** 2 for n, k in seen) / (p * (1 - p)) - (len(seen) - 1)) / room
            strengths.append(1 / min(prior.most_rho, max(prior.least_rho, rho)) - 1)
        else:
            strengths.append(prior.default_strength)
    out = {}
    for host, (domain, suffix, _, _) in hosts.items():
        mean = p
        for level, key, s in zip(levels, (suffix, (domain, suffix), host), strengths, strict=True):
            mean = (s * mean + level[key][1]) / (s + level[key][0])
        out[host] = (mean, mean + prior.z * math.sqrt(mean * (1 - mean) / (s + level[host][0] + 1)))
    return out


def test_shrinkage(frame):
    hosts = {
        "a.good.com": ("good.com", "com", 40, 39), "b.good.com": ("good.com", "com", 0, 0), "a.bad.com": ("bad.com", "com", 30, 1),
        "b.bad.com": ("bad.com", "com", 1, 1), "c.bad.com": ("bad.com", "com", 0, 0), "x.net": ("x.net", "net", 9, 2), "y.org": ("y.org", "org", 0, 0),
    }
    got = host_reputation(frame([(h, n, k) for h, (_, _, n, k) in hosts.items()], "host string, n long, good long")).collect()
    want = by_hand(hosts, Prior())
    assert {r.host: (r["mean"], r.upper) for r in got} == {h: pytest.approx(v) for h, v in want.items()}
    mean = {r.host: r["mean"] for r in got}
    assert mean["b.good.com"] > 0.8 > 0.5 > mean["c.bad.com"] and mean["b.bad.com"] > mean["c.bad.com"]


def test_outcomes_from_a_table(frame):
    pages = frame([(i, f"http://{h}/{i}", "x") for i, h in enumerate(["spam.test", "fine.test", "new.test", "spam.test"])], "page_id long, url string, host string")
    labelled = [(f"http://spam.test/{i}", 0) for i in range(40)] + [(f"http://fine.test/{i}", 1) for i in range(40)] + [(None, 1), ("http://fine.test/", None)]
    got = judge_urls(pages, [Rule("allow", "spam.test/3")], outcomes=frame(labelled, "url string, good int")).collect()
    assert {r.page_id: r.verdict for r in got} == {0: "block", 1: "allow", 2: "allow", 3: "allow"}


def test_nothing_labelled_and_empty_tables(frame):
    schema = "page_id long, url string"
    got = judge_urls(frame([(1, "http://a.test/"), (1, "http://a.test/"), (None, None)], schema), queries.URL_RULES).collect()
    assert [r.verdict for r in got] == ["allow"] * 3
    assert judge_urls(frame([], schema), queries.URL_RULES).count() == 0
