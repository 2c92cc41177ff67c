import re

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import url_filter as uf
from lodestrata.llm.queries import URL_RULES
from lodestrata.llm.url_filter import Rule

URLS = [
    "http://a.example.org/en/12?q=1#x", "https://EXAMPLE.ORG/es/", "http://example.org/en/2", "http://notexample.org/es/1", "http://x.com/fr/a", "http://com/de/", "http://b.c.com/de/x://y",
    "http://org", "http://org/", "http://org?/x", "ftp://user@sub.org:80/", "http://example.net/de/", "no scheme.org/", None, "", "://", "http:///path", "http://a..org/x", "HTTP://Ünï.ORG/Pfad", "http://example.org/en/1", "http://x.org/\nnew/line",
]


def brute(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if c.isascii() else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    best = None
    for r in rules:
        if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.key) > len(best.key)):
            best = r
    return host, path, best and best.key, best.action if best else "allow"


def table(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def judged(df):
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()}


def test_equals_brute_force(spark):
    got = judged(uf.judge(table(spark, URLS), URL_RULES))
    assert got == {i: brute(u, URL_RULES) for i, u in enumerate(URLS)}


@pytest.mark.parametrize("rate", [0.9, 0.5, 0.05])
def test_coarse_first_levels_stay_exact(spark, rate):
    """False positives abound at level 0, so that several levels are needed."""
    keys = [f"key{i}" for i in range(600)]
    universe = spark.createDataFrame([(k,) for k in keys] + [(None,), (keys[0],)], "key string")
    listed = universe.filter("key like '%7'")
    cascade = uf.build_cascade(listed, universe, rate)
    assert len(cascade.levels) >= 2
    got = {r["key"] for r in universe.na.drop().filter(uf.contains(cascade, F.col("key"))).collect()}
    assert got == {k for k in keys if k.endswith("7")}


def test_many_rules(spark):
    rules = [Rule("block" if i % 3 else "allow", f"h{i}.org", "/a/" if i % 2 else "/") for i in range(200)]
    urls = [f"http://{'w.' if i % 5 else ''}h{i}.org/{'a/' if i % 4 else ''}p{i}" for i in range(400)]
    got = judged(uf.judge(table(spark, urls), rules, level0_rate=0.3))
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_no_join_and_no_python_when_judging(spark):
    plan = uf.judge(table(spark, URLS), URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Join|Exchange|Python|Arrow|Pandas", plan)


def test_odd_tables(spark):
    empty = table(spark, URLS).limit(0)
    assert uf.judge(empty, URL_RULES).count() == 0
    assert {v[2:] for v in judged(uf.judge(table(spark, URLS), [])).values()} == {(None, "allow")}
    clash = table(spark, ["http://x.com/de/"] * 2).withColumns({"host": F.lit(1), "rule": F.lit(2), "key": F.lit(3), "__keys": F.lit(4)})
    clash = clash.withColumns({"__host": F.lit(5), "Verdict": F.lit(6), "keys": F.lit(7), "__path": F.lit(8)})
    got = uf.judge(clash, URL_RULES, default="block")
    assert got.columns == ["page_id", "url", "key", "__keys", "__host", "keys", "__path", "host", "path", "rule", "verdict"]
    assert {(r["key"], r["__keys"], r["__host"], r["keys"], r["__path"]) for r in got.collect()} == {(3, 4, 5, 7, 8)}
    assert got.filter("rule = 'com/de/' and verdict = 'block'").count() == 2
    for bad in (Rule("maybe", "a", "/"), Rule("block", "A", "/"), Rule("block", "a", "x")):
        with pytest.raises(ValueError, match="not a rule"):
            uf.judge(clash, [bad])
    assert judged(uf.judge(table(spark, ["http://x.com/"]), [Rule("allow", "com", "/"), Rule("block", "com", "/")]))[0][3] == "block"


def test_no_python_in_the_whole_run(spark, tmp_path):
    table(spark, URLS).write.parquet(f"{tmp_path}/pages")
    pages = spark.read.parquet(f"{tmp_path}/pages")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    uf.judge(pages, URL_RULES, level0_rate=0.5).count()
    plans = [store.execution(i).get().physicalPlanDescription() for i in range(before, store.executionsCount()) if store.execution(i).isDefined()]
    assert len(plans) > 5
    assert not any(re.search("Python|Arrow|ExistingRDD", p) for p in plans)
