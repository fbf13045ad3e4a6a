"""Host, path and rules against plain string handling; held-out accuracy."""

import re

from pyspark.sql import functions as F

from corpusdelta.llm import urls
from corpusdelta.llm.queries import URL_RULES
from tests.conftest import SF_SMALL


def slow(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max((r for r in URL_RULES if (host == r[1].split("/")[0] or host.endswith("." + r[1].split("/")[0]))
                and path.startswith("/" + r[1].split("/", 1)[1])), key=lambda r: len(r[1]), default=(None, None))
    return host, path, best[1], best[0]


def _check(got, rows):
    for r in got:
        host, path, rule, verdict = slow(rows[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_rules_on_whole_table_and_odd_urls(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "url")
    odd = [None, "", "no scheme", "http://", "HTTP://A.NET", "http://a.NET/x?y://z", "x://y://z", "http://example.org/fr/a#b", "http://É.net/",
           "http://xorg/fr/", "http://org/fr/", "//a.net/", "http://a.net?/", "http://example.net/en/", "http://a.example.com/de/\nx?1", "http://b.com/" + "a/" * 3000]
    rows = {r.page_id: r.url for r in pages.collect()} | {10_000 + i: u for i, u in enumerate(odd)}
    df = spark.createDataFrame([(i, u, "h", 1.0) for i, u in rows.items()], "page_id long, url string, host string, features double")
    got = urls.judge(df, URL_RULES).collect()
    assert len(got) == len(rows)
    _check(got, rows)


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://a.com/x"), (None, None), (1, "http://a.com/x")], "page_id long, url string")
    assert [r.verdict for r in urls.judge(df, URL_RULES).collect()] == ["allow"] * 3
    assert urls.judge(df.limit(0), URL_RULES).count() == 0


def test_trees_learn_from_rules(spark):
    """Hide the rules' hosts: the shape of a URL alone tells the two kinds apart."""
    bad = [(i, f"http://x{i}.b-{i}-9.info/a/{i * 7919}/{i}?q={i}&r=2") for i in range(300)]
    good = [(1000 + i, f"http://www.site{chr(97 + i % 26)}.org/page") for i in range(300)]
    rules = [("block", f"b-{i}-9.info/") for i in range(0, 300, 2)] + [("allow", f"site{c}.org/") for c in "acegikmoqsuwy"]
    df = spark.createDataFrame(bad + good, "page_id long, url string")
    got = urls.judge(df, rules).where(F.col("rule").isNull()).collect()
    right = [r.verdict == ("block" if r.page_id < 1000 else "allow") for r in got]
    assert len(right) > 200 and sum(right) / len(right) > 0.95
