import random
import re

from pyspark.sql import functions as F

from ledgerloom.llm import url_filters as uf

RULES = [("block", "bad.com", "/"), ("allow", "good.org", "/ok/"), ("block", "good.org", "/"), ("block", "x.y", "/a"), ("allow", "x.y", "/a")]


def slow(urls, links, rules):
    def split(u):
        m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")

    def fit(u):
        h, p = split(u)
        ok = [(len(rh + rp), v == "allow", rh + rp) for v, rh, rp in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        return max(ok, default=None)

    def key(u):
        h, p = split(u)
        if not re.sub(r"^(?:www|m)\.", "", h):
            return None
        q = (re.search(r"(?s)^.*?://[^?#]*\?([^#]*)", u) or [0, ""])[1]
        q = sorted(x for x in q.split("&") if x and not re.match(uf.TRACKING, x))
        return re.sub(r"^(?:www|m)\.", "", h) + re.sub(uf.PAGE_END, "", p) + "?" + "&".join(q)

    nodes = {}
    for u in [*urls, *(x for e in links for x in e)]:
        if key(u):
            nodes.setdefault(key(u), []).append(fit(u))
    comp = {k: k for k in nodes}
    for _ in nodes:
        for a, b in links:
            if key(a) and key(b):
                low = min(comp[key(a)], comp[key(b)])
                comp[key(a)] = comp[key(b)] = low
    out = []
    for u in urls:
        f = fit(u)
        if f:
            out.append(("allow" if f[1] else "block", f[2]))
            continue
        all_ = [x for k in nodes if key(u) and comp[k] == comp[key(u)] for x in nodes[k] if x]
        out.append(("allow" if any(x[1] for x in all_) or not all_ else "block", None))
    return out


def test_decisions_spread_over_redirects_like_brute_force(spark):
    rng = random.Random(4)
    hosts = ["a.com", "www.a.com", "m.b.com", "bad.com", "sub.BAD.com", "good.org", "e.net", "x.y", "notbad.com"]
    paths = ["", "/", "/p", "/p.html", "/p/", "/ok/z", "/a/b", "/index.html", "/q"]
    make = lambda: rng.choice(["http://", "https://", "HTTP://"]) + rng.choice(hosts) + rng.choice(paths) + str(rng.choice(["", 1, 2, 3])) + rng.choice(["", "?b=1&a=2", "?utm_source=x", "#t", "?ref=1#u", "?"])
    urls = [make() for _ in range(120)] + [None, "", "no scheme", "://", "http://", "a://b://c.com/d"]
    rows, links = [], []
    for i, u in enumerate(urls):
        html = "<p>x</p>"
        if i % 5 == 0 and u and "://" in u:
            to = make()
            links.append((u, to))
            html = f"<LINK href='{to}' rel=canonical>" if i % 2 else f'<meta http-equiv="refresh" content="0; URL={to}">'
        rows.append((i, u, None if i % 11 == 3 else html, "k"))
        if i % 11 == 3 and links and links[-1][0] is u:
            links.pop()
    more = [(make(), make()) for _ in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, key string")
    red = spark.createDataFrame(more, "src string, dst string")
    got = sorted(uf.judge(df, redirects=red, rules=RULES).collect(), key=lambda r: r.page_id)
    assert [(r.verdict, r.rule) for r in got] == slow(urls, links + more, RULES)
    assert len({r.verdict for r in got if r.rule is None}) == 2


def test_hosts_and_paths(spark):
    cases = {"http://A.É.com?q": ("a.É.com", ""), "x://h#f/": ("h", ""), "no": ("", ""), None: ("", ""), "a://b://c/d?e": ("b:", "//c/d")}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id int, url string")
    got = sorted(uf.judge(df, html=None).collect(), key=lambda r: r.page_id)
    assert [(r.host, r.path) for r in got] == list(cases.values())
    assert uf.judge(df.limit(0), html=None).count() == 0


def test_relative_links(spark):
    html = '<link rel="canonical" href="{}">'
    rows = [(0, "http://s.com/d/e", html.format("../x")), (1, "http://s.com/d/e", html.format("//t.com/y")), (2, "http://s.com/d/e", html.format("/z?a=1&amp;b=2"))]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = [r.t[0] for r in df.orderBy("page_id").select(uf.link_targets(F.col("html"), F.col("url")).alias("t")).collect()]
    assert got == ["http://s.com/d/../x", "http://t.com/y", "http://s.com/z?a=1&b=2"]
