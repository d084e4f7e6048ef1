import random

from docloom.llm import queries, url_filter


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    m = next((i for i, c in enumerate(rest) if i >= n and c in "?#"), len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:m]


def judge(url, rules, default="allow"):
    host, path = split(url)
    fit = [r for r in rules if r[0] and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[0], r[1]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


def test_random(spark):
    r = random.Random(6)
    labels = ["a", "b", "a-b", "ab", "é", "net", "com"]
    host = lambda: ".".join(r.choice(labels) for _ in range(r.randrange(1, 5)))
    path = lambda: "".join("/" + r.choice(["x", "xy", "é", ""]) for _ in range(r.randrange(0, 4)))
    rules = {(host(), path()): r.choice(["allow", "block"]) for _ in range(150)}
    rules = [(h, p, v) for (h, p), v in rules.items()] + [("", "/", "block")]
    urls = [f"{r.choice(['http', 'HTTPS'])}://{host().upper() if r.random() < 0.3 else host()}{path()}{r.choice(['', '?q=/x', '#f', '?a#b'])}" for _ in range(900)]
    urls += [None, "", "no scheme", "://", "a://", "http://?x", "http://a", "http://net.", "http://.net/x", "http://u@net:80/x", "x://y://z"] + ["http://hot.net/x"] * 400
    pages = spark.createDataFrame([(i if i % 50 else None, u, i) for i, u in enumerate(urls)], "page_id long, url string, key int")
    out = url_filter.judge(pages.repartition(5), rules, parts=7).collect()
    want = sorted([(str(i if i % 50 else None), *judge(u, rules)) for i, u in enumerate(urls)], key=repr)
    assert sorted([(str(x.page_id), x.host, x.path, x.rule, x.verdict) for x in out], key=repr) == want
    assert len({w[3] for w in want}) > 20


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(pages, queries.URL_RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge(one, []).collect()] == [(1, "a.net", "/x", None, "allow")]


def test_native(spark, sf_dir):
    plan = queries.op9_url_filter(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
