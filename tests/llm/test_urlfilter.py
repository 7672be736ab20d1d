import random

from docloom.llm.urlfilter import Automaton, Rule, url_filter

RULES = [Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow")]


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:at])
        path = rest[at:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == (h := r.pattern.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + r.pattern.partition("/")[2])]
    best = max(fits, key=lambda r: len(r.pattern), default=None)
    return host, path, best and best.pattern, best.verdict if best else default


def test_against_brute_force(spark):
    r = random.Random(1)
    urls = [None, "", "no scheme", "http://", "http://NET/", "http://net", "http://net?x", "http://a.Net/p#f", "x://anet/", "http://example.net/en/1", "http://xexample.net/en/", "http://a.org/fr/", "http://a.org/FR/", "http://a.com/x.net/", "http://a.net:80/", "http://\u00c4.net/\u00e4", "http://q.org/\n.net/", "a://b://c.net/", "http://" + "l" * 5000 + ".net/" + "p" * 5000]
    urls += [f"http://{r.choice(['', 'a.', 'b.a.'])}{r.choice(['example.net', 'example.com', 'x.org', 'net'])}{r.choice(['', '/', '/en/', '/de/1', '/fr/?q', '#x'])}" for _ in range(300)]
    rows = [(None if i == 3 else i, u, "clash", "clash") for i, u in enumerate(urls)] + [(0, None, "clash", "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = sorted(map(tuple, url_filter(df, RULES).collect()), key=str)
    assert got == sorted(((i, *brute(u, RULES)) for i, u, *_ in rows), key=str)
    assert url_filter(df.limit(0), RULES).count() == 0
    assert url_filter(df, []).where("rule is not null or verdict <> 'allow'").count() == 0


def test_globs_and_many_words():
    rules = [Rule("ads*.example.com/*/x?z", "block"), *[Rule(f"host{i}.test/path{i}/", "block") for i in range(40)], Rule("*/only", "allow")]
    a = Automaton(rules)
    assert a.words > 5
    hosts = ["ads12.example.com", "w.ads.example.com", "ads.other.com", "host7.test", "a.host39.test", "host39.test.x", "q"]
    paths = ["/a/b/xyz/", "/a/x/z", "/a/xyz", "/path7/1", "/path39/", "/path39/", "/only/1"]
    found = [a.rules[k].pattern if k >= 0 else None for k in a.match(hosts, paths)]
    assert found == [rules[0].pattern, rules[0].pattern, None, rules[8].pattern, rules[40].pattern, None, "*/only"]
