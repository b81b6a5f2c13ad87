import random
import re

from plumbline.llm import url_rules as U


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fit = [(len(h) + len(p), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    fit.sort(key=lambda r: (-r[0], -r[1], r[3]))
    return (host, path, fit[0][2], fit[0][3]) if fit else (host, path, None, default)


def urls():
    rnd = random.Random(1)
    hosts = ["example.com", "www.example.com", "EXAMPLE.com", "notexample.com", "example.net", "a.b.example.net", "com", "net", "x.org", "org", "", ".com", "com.", "ex-ample.com", "communs", "m.com:80"]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/75?x=/en/", "/de/8#a", "/de/", "/es/x", "/EN/", "?/en/", "#/en/"]
    return [f"{rnd.choice(['http', 'https', ''])}://{rnd.choice(hosts)}{rnd.choice(paths)}" for _ in range(400)] + [None, "", "no scheme", "a://b://c/en/", "mailto:x@com/en/", "https://é.com/en/ü"]


RULES = U.RULES + [("é.com", "/en/", "allow"), ("", "", "block"), ("b.example.net", "/", "allow"), ("example.net", "/de/8", "allow"), ("x.org", "", "block")]


def run(spark, rules, **kw):
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls())], "page_id long, url string, host string").repartition(5)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(df, rules, **kw).collect()}


def test_equals_brute_force(spark):
    for rules in (U.RULES, RULES):
        assert run(spark, rules) == {i: brute(u, rules) for i, u in enumerate(urls())}


def test_listed_rules_equal_those_in_rows(spark):
    odd = [("É.CoM", "/A", "block"), ("É.com", "/A", "allow"), ("", "", "block"), (None, "/", "allow"), ("a", None, "allow"), ("a", "/", None), ("x.Y.z", "/é", "allow")]
    table = spark.createDataFrame(odd, "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://É.com/A", "http://q.x.y.z/é/", "z", None, "http://w.É.com/a"])], "page_id long, url string")
    rows = [sorted(map(tuple, U.judge(pages, r, most_sent=m).collect())) for r in (odd, table) for m in (U.MOST_SENT, 0)]
    assert rows[0] == rows[1] == rows[2] == rows[3]


def test_rules_as_rows(spark):
    upper = [(h.replace("com", "CoM"), p, v) for h, p, v in RULES] + [("É.com", "/en/", "block")]
    table = spark.createDataFrame([*upper, (None, "/", "block"), ("com", None, "block"), ("org", "/es/", None)], "host string, path string, verdict string")
    lower = [(h.lower() if h.isascii() else h.replace("CoM", "com"), p, v) for h, p, v in upper]
    want = {i: brute(u, lower) for i, u in enumerate(urls())}
    assert run(spark, table) == want
    assert run(spark, table, most_sent=0) == want


def test_many_rules_and_one_hot_host(spark):
    rnd = random.Random(4)
    hosts = ["hot.com", "www.hot.com", "a.b.hot.com", "x.hot.com.", "net", "q.net", "com", "", "hot.co", "hot.com-x"]
    rules = [(rnd.choice(hosts), "/" + "".join(rnd.choice("ab/") for _ in range(rnd.randint(0, 4))), rnd.choice(["allow", "block"])) for _ in range(300)]
    once = {}
    for h, p, v in rules:
        once[h, p] = min(v, once.get((h, p), v))
    pages = [(i, f"http://{'hot.com' if i % 3 == 0 else rnd.choice(hosts)}/{''.join(rnd.choice('ab/') for _ in range(6))}") for i in range(900)]
    df = spark.createDataFrame(pages, "page_id long, url string").repartition(5)
    want = {i: brute(u, [(*k, v) for k, v in once.items()]) for i, u in pages}
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for most in (U.MOST_SENT, 0):
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(df, table, most_sent=most).collect()} == want
    assert U.judge(df.limit(0), table, most_sent=0).count() == 0


def test_no_rows_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "http://a.com/en/"), (None, "http://a.com/en/")], "page_id long, url string")
    assert [r.rule for r in U.judge(df).collect()] == ["com/en/"] * 2
    assert U.judge(df.limit(0)).count() == 0
