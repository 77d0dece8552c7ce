import pytest
from pyspark.sql import functions as F

from affinis.llm import urls
from tests.conftest import SF

ODD = [
    None, "", "no scheme", "://", "http://", "http://Example.ORG", "http://example.org/", "http://EXAMPLE.org/es/1", "http://x.example.org/en/12",
    "http://example.org/EN/1", "http://notexample.org/es/", "http://a.com/fr/x?y=/de/", "http://a.com/de/", "http://com/fr/", "http://a.com.net/fr/",
    "http://..org/x", "http://a.org:80/x", "a://b://c.org/x", "http://É.org/ü#x", "http://www.spam-farm.example.org/es/x",
    "http://www.spam-farm.example.com/zz", "http://spam-farm.example.com", "http://example.org?x/es/", "http://a.com/fr", "x" * 5000 + "://a.org/" + "y" * 50000]


def judge(url, rules, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut], rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = lambda r: (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])
    fitting = [r for r in rules if fits(r)]
    if fitting:
        rule = max(fitting, key=len)
        return host, path, rule, rules[rule]
    return host, path, None, "block" if any(map(fits, listed)) else "allow"


@pytest.mark.parametrize("mounted", [True, False])
def test_odd_urls(spark, mounted):
    pages = spark.createDataFrame([(i if i % 7 else None, u, "x", "x") for i, u in enumerate(ODD)] * 2, "page_id long, url string, host string, verdict string")
    got = urls.judged(pages, urls.compiled(urls.rule_table(spark), mounted)).collect()
    assert sorted(map(repr, ((r["host"], r["path"], r["rule"], r["verdict"]) for r in got))) == sorted(
        repr(judge(u, urls.RULES, urls.BLOCKED)) for u in ODD * 2)


def test_table_and_many_rules(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rules = {f"h{i}.example.net/{'abc'[: i % 4]}": "allow" if i % 2 else "block" for i in range(3000)} | urls.RULES
    table = urls.compiled(urls.rule_table(spark, rules))
    own = spark.createDataFrame([(i, f"https://sub.h{i}.example.net/{'abcd'[: i % 5]}?q") for i in range(3000)], "page_id long, url string")
    for df in (pages.select("page_id", "url"), own):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(df, table).collect()}
        assert got == {r["page_id"]: judge(r["url"], rules, urls.BLOCKED) for r in df.collect()}


def test_equal_digests_are_told_apart(spark):
    """All rules under one key: only the stored strings can decide."""
    pages = spark.createDataFrame(list(enumerate(ODD)), "page_id long, url string")
    table = urls.compiled(urls.rule_table(spark))
    stored = spark.read.parquet(table.table.paths[0].rsplit("/", 1)[0])
    one = urls.publish(stored.withColumn("key", F.xxhash64(F.lit("com/fr/"))), stored.count(), table.table.columns, "one-key")
    got = urls.judged(pages.where(F.col("url").contains("fr")), urls.Filter(one, table.lengths)).collect()
    assert got and all(r["rule"] == judge(ODD[r["page_id"]], {"com/fr/": "allow"}, [])[2] for r in got)


def test_no_rules_and_no_pages(spark):
    nothing = urls.compiled(urls.rule_table(spark).limit(0))
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert [(r["rule"], r["verdict"]) for r in urls.judged(pages, nothing).collect()] == [(None, "allow")]
    assert urls.judged(pages.limit(0), nothing).count() == 0
