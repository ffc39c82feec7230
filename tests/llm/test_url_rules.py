import random

from reelframe.llm import url_rules
from tests.llm.helpers import empty

FIELDS = "page_id long, url string, host string, rule string, key string"


def brute(host, path, rules, default="allow"):
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fits)[3], max(fits)[4]) if fits else (None, default)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    cut = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:cut]


def judge(spark, urls, rules=url_rules.RULES, sweeps=3):
    pages = spark.createDataFrame([(i, u, "h", "r", "k") for i, u in enumerate(urls)], FIELDS)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, table, sweeps=sweeps).collect()}


def test_cases(spark):
    urls = [None, "", "no scheme", "http://net", "http://net/", "HTTP://A.NET/x", "http://example.net/en/1", "http://m.example.net/en", "http://example.com/de/", "http://notexample.com/de/", "http://a.org/fr/?x#y", "http://a..net/", "http://xnet/", "http://Ü.net/a\nb", "a://b://c.net/", "http://a.net:80/", "http://" + "a." * 3000 + "net/" + "p" * 9000]
    got = judge(spark, urls)
    for i, u in enumerate(urls):
        host, path = parts(u)
        assert got[i] == (host, path, *brute(host, path, url_rules.RULES)), u


def test_against_brute_force(spark):
    rng = random.Random(3)
    labels = ["a", "b", "ab", "net"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 3)))
    rules = list({(host(), path()): None for _ in range(60)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    urls = [f"http://{host()}{path()}" for _ in range(500)]
    got = judge(spark, urls, rules)
    for i, u in enumerate(urls):
        h, p = parts(u)
        assert got[i] == (h, p, *brute(h, p, rules)), u


def test_longest_is_the_longest_rule_string(spark):
    rules = [("net", "/en/docs/long/", "block"), ("example.net", "/", "allow")]
    got = judge(spark, ["http://example.net/en/docs/long/x", "http://example.net/en"], rules)
    assert [got[i][2:] for i in (0, 1)] == [("net/en/docs/long/", "block"), ("example.net/", "allow")]


def test_repeated_urls_are_spread(spark):
    pages = spark.range(0, 300, 1, 4).selectExpr("CAST(NULL AS long) AS page_id", "CAST(NULL AS string) AS url", "'' AS host", "'' AS rule", "'' AS key")
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    assert url_rules.judge_urls(pages, rules, sweeps=4).count() == 300
    plan = url_rules.judge_urls(pages, rules, sweeps=4)._jdf.queryExecution().toString()
    assert "monotonically_increasing_id" in plan


def test_empty_tables_and_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", "", "", ""), (None, None, None, None, None), (1, "http://a.net/", "", "", "")], FIELDS)
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    assert url_rules.judge_urls(empty(pages), rules).count() == 0
    assert [r["verdict"] for r in url_rules.judge_urls(pages, empty(rules)).collect()] == ["allow"] * 3
    assert sorted(r["verdict"] for r in url_rules.judge_urls(pages, rules).collect()) == ["allow", "block", "block"]
    odd = spark.createDataFrame([(None, "/", "block"), ("net", None, "block"), ("net", "/", None)], "host string, path string, verdict string")
    assert sorted(r["verdict"] for r in url_rules.judge_urls(pages, odd).collect()) == ["allow", "block", "block"]


def test_no_python_in_the_plan(spark, sf):
    plan = url_rules.query(spark, sf)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "Cartesian", "BroadcastNestedLoop"))
