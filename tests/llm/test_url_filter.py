import re

import pytest

from pagemill.llm import url_filter as U

URLS = [
    None, "", "no scheme", "http://", "http://net", "http://NET/", "https://a.net/x?y#z", "http://example.net/en/1", "http://x.example.net/en", "http://y.Example.NET/en/a/b?q",
    "http://badexample.net/en/x", "http://example.com/de/1", "http://w.example.com/fr/1", "ftp://org/fr/", "http://a.org/fr/?x", "http://a.org?/fr/", "http://a.org#/fr/", "a://b://c.net/d", "http://user@h.org:80/fr/x", "http://x.org/en/\nq",
]


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:end])
    after = rest[end:]
    path = after[: min([after.find(c) for c in "?#" if c in after] or [len(after)])]
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, r, v = max(fits, default=(0, None, None))
    return host, path, r, v


def walk(seed, edges, hosts, damping, back):
    """Scores once nothing changes any more. back: a host takes of each host it links to the share of its links."""
    out = {h: {} for h in hosts}
    for (a, b), n in edges.items():
        out[a][b] = n
    share = {(a, b): n / sum(out[a].values()) for a in hosts for b, n in (out[a] or {a: 1}).items() for out[a] in [out[a] or {a: 1}]}
    now = dict.fromkeys(hosts, 0.0)
    for _ in range(300):
        new = {h: (1 - damping) * seed.get(h, 0) for h in hosts}
        for (a, b), x in share.items():
            to, frm = (a, b) if back else (b, a)
            new[to] += damping * now[frm] * x
        now = new
    return now


def test_rules_and_walks(spark):
    page = lambda to: "".join(f"<a HREF='{u}'>x</a> <a href=/own>y</a>" for u in to)
    rows = [(i, u, None, 1) for i, u in enumerate(URLS)]
    rows += [(100, "http://s.net/a", page(["//p.example.com/1", "http://q.io/"])), (101, "http://p.example.com/fr/1", page(["http://s.net/b", "http://s.net/c", "https://q.io/x?y"])), (102, "http://q.io/1", page([])), (103, "http://r.io/1", page(["http://S.net/", "http://a.net"])), (103, "http://r.io/1", page(["http://s.net/", "http://a.net"])), (None, "http://t.org/fr/9", page(["http://q.io/"]))]
    rows = [(*r, 1)[:4] for r in rows]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = U.filter_pages(pages, tolerance=1e-9).collect()
    assert len(got) == len(rows)
    want = {(r[0], r[1]): by_hand(r[1]) for r in rows}
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in got) == sorted((str(r[0]), *want[r[0], r[1]][:2], str(want[r[0], r[1]][2])) for r in rows)
    n, seeds, edges = {}, {"allow": {}, "block": {}}, {}
    for r in rows:
        h, _, _, v = by_hand(r[1])
        if not h:
            continue
        n[h] = n.get(h, 0) + 1
        if v:
            seeds[v][h] = seeds[v].get(h, 0) + 1
        for u in re.findall(r"HREF='([^']*)'", r[2] or ""):
            b = by_hand(u if "://" in u else "http:" + u)[0]
            if b and b != h:
                edges[h, b] = edges.get((h, b), 0) + 1
    hosts = set(n) | {h for e in edges for h in e}
    trust = walk({h: x / n[h] for h, x in seeds["allow"].items()}, edges, hosts, 0.85, False)
    bad = walk({h: x / n[h] for h, x in seeds["block"].items()}, edges, hosts, 0.85, True)
    for r in got:
        t, d = trust.get(r.host, 0.0), bad.get(r.host, 0.0)
        assert r.trust == pytest.approx(t, abs=1e-6) and r.distrust == pytest.approx(d, abs=1e-6)
        by_rule = {x for v, h, p in U.RULES if h + p == r.rule for x in [v]}
        good, ill = (max(x, seeds[k].get(r.host, 0) / n.get(r.host, 1)) for x, k in ((t, "allow"), (d, "block")))
        assert r.verdict == (by_rule.pop() if by_rule else "block" if ill >= 0.5 and ill > good else "allow")
    assert {r.verdict for r in got if r.host == "r.io"} == {"block"}
    assert U.filter_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("linkers", [0, 1, 10])
def test_a_linked_host_keeps_its_seed(spark, linkers):
    rows = [(i, f"http://spam.net/{i}", "") for i in range(3)] + [(9, "http://spam.net", "")]
    rows += [(100 + i, f"http://l{i}.io/", "<a href='http://spam.net/0'>x</a>") for i in range(linkers)]
    got = U.filter_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.verdict for r in got if r.host == "spam.net"} == {"block"}
    assert {r.rule for r in got if r.page_id == 9} == {None}
    # Who links to nothing else is distrusted, however many they are.
    assert {r.verdict for r in got if r.host.startswith("l")} <= {"block"}
