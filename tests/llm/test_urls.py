import random
import time

from pyspark.sql import functions as F

from seriesmith.llm import urls as U
from seriesmith.llm.queries import BLOCKED_NAMES, DOMAINS, URL_RULES, url_list

BLOCKED_URLS = [f"{n}.{d}/" for n in BLOCKED_NAMES for d in DOMAINS]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:end], rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[:stop]


def fits(entry, host, path, is_rule=True):
    h, _, p = entry.partition("/")
    return bool(host) and (host == h or host.endswith("." + h)) and (path if is_rule or path.endswith("/") else path + "/").startswith("/" + p)


def brute(url, rules, blocked):
    host, path = split(url)
    best = max((r for r in rules if fits(r[0], host, path)), key=lambda r: len(r[0]), default=None)
    if best:
        return host, path, *best
    return host, path, None, "block" if any(fits(e, host, path, False) for e in blocked) else "allow"


URLS = [
    None, "", "no scheme", "http://", "://x.net/", "HTTP://A.Example.NET/en/1", "http://example.net/en/", "http://example.net/en", "http://net/", "http://net", "http://xnet/", "http://example.com/de/x#f",
    "http://m.example.org/fr/1?x=/de/", "http://org/fr/", "http://a.net?x", "http://a.net#/", "http://cheap-pills.example.com/fr/1", "http://www.cheap-pills.example.com/de/1", "http://cheap-pills.example.com", "http://notcheap-pills.example.com/",
    "http://u:p@free-bets.example.com/", "http://É.net/", "http://a..net//", "a://b://c.net/", "http://spam-farm.example.org/fr/9", "http://x.\nnet/\n", "http://example.com/de", "http://ads-track.example.org//",
]


def check(rows, got, rules=URL_RULES, blocked=BLOCKED_URLS):
    want = sorted(((i, *brute(u, rules, blocked)) for i, u in rows), key=str)
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got), key=str) == want


def test_rules(spark, table):
    rows = list(enumerate(URLS)) + [(5, URLS[5]), (None, URLS[6])]
    check(rows, U.filter_urls(table(rows, "page_id long, url string"), url_list(spark)).collect())


def test_random_lists(spark, table):
    rng = random.Random(3)
    host = lambda: ".".join(rng.choice(["a", "b", "c", "net"]) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join("/" + rng.choice(["x", "y", ""]) for _ in range(rng.randint(0, 3)))
    entries = {host() + path().rstrip("/") + "/": (rng.choice(["allow", "block"]), rng.random() < 0.5) for _ in range(60)}
    listed = table([(e, a if rule else "block", rule) for e, (a, rule) in entries.items()], "entry string, action string, is_rule boolean")
    rows = [(i, f"http://{host()}{path()}") for i in range(500)]
    check(rows, U.filter_urls(table(rows, "page_id long, url string"), listed).collect(), [(e, a) for e, (a, rule) in entries.items() if rule], [e for e, (_, rule) in entries.items() if not rule])


def test_the_filter_has_no_false_negatives(spark):
    entries = spark.range(5000).select(F.concat(F.lit("h"), "id", F.lit("/")).alias("entry"))
    bloom = U.bloom_filter(entries, 300)
    assert U.possible_hits(entries, bloom, 300).count() == 5000
    others = spark.range(5000, 25000).select(F.concat(F.lit("h"), "id", F.lit("/")).alias("entry"))
    assert U.possible_hits(others, bloom, 300).count() < 1500


def test_native_plan(spark, table):
    plan = U.filter_urls(table(list(enumerate(URLS)), "page_id long, url string"), url_list(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_edges(spark, table):
    pages = table(list(enumerate(URLS)), "page_id long, url string")
    assert U.filter_urls(pages.limit(0), url_list(spark)).count() == 0
    assert U.filter_urls(pages, url_list(spark).limit(0)).filter("verdict = 'allow' AND rule IS NULL").count() == len(URLS)
    clash = pages.withColumn("host", F.lit(1)).withColumn("entry", F.lit(2)).withColumn("action", F.lit(3))
    assert U.filter_urls(clash, url_list(spark)).count() == len(URLS)
    long = table([(1, "http://" + "a." * 200 + "net/" + "x/" * 200)], "page_id long, url string")
    assert U.filter_urls(long, url_list(spark)).first()["rule"] == "net/"


def test_long_urls_cost_no_more_than_the_list(spark, table):
    longest = table([(1, "http://" + "a." * 20_000 + "net/" + "x/" * 20_000), (2, "http://cheap-pills.example.org/" + "y" * 40_000)], "page_id long, url string")
    began = time.perf_counter()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.filter_urls(longest, url_list(spark)).collect()}
    assert got == {1: ("net/", "block"), 2: (None, "block")} and time.perf_counter() - began < 20


def test_a_list_of_urls(spark, table, monkeypatch):
    """A list with many blocks, whether the filter and the verdicts are broadcast or not."""
    pages = table([(i, f"http://h{i % 700}.example.com/a/{i}" + ("/" if i % 3 else "?q")) for i in range(3000)], "page_id long, url string")
    entries = [f"h{i % 700}.example.com/a/{i}/" for i in range(0, 6000, 2)]
    listed = table([(e, "block", False) for e in entries] + [(e, a, True) for e, a in URL_RULES], "entry string, action string, is_rule boolean")
    rows = [(r["page_id"], r["url"]) for r in pages.collect()]
    first = U.filter_urls(pages, listed).collect()
    assert {r["page_id"] for r in first if r["verdict"] == "block"} == set(range(0, 3000, 2))
    check(rows[:200], [r for r in first if r["page_id"] < 200], blocked=entries[:150])
    monkeypatch.setattr(U, "BROADCAST_BLOCKS", 0)
    monkeypatch.setattr(U, "VERDICT_BYTES", 0)
    assert sorted(U.filter_urls(pages, listed).collect()) == sorted(first)
