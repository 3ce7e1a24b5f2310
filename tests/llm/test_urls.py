import math
from collections import Counter

import duckdb
import pytest
from tickweave.llm import urls

RULES = urls.RULES


def brute(rows):
    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        for stop in "#?":
            rest = rest.split(stop, 1)[0]
        host, slash, path = rest.partition("/")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path

    def codes(url):
        out = [0, 0, 0]
        for c in url or "":
            c = c.lower() if "A" <= c <= "Z" else "0" if c in "0123456789" else c
            out.append(urls.SYMBOLS.index(c) + 1 if c in urls.SYMBOLS else 31)  # "_" is 31 too
        return out + [0]

    parts = []
    for page_id, url in rows:
        host, path = split(url)
        fit = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        parts.append((page_id, url, host, path, best))
    seen = {v: [Counter() for _ in range(4)] for v in ("allow", "block")}
    for *_, url, host, path, best in [(p[0], p[1], p[2], p[3], p[4]) for p in parts]:
        if best:
            x = codes(url)
            for i in range(3, len(x)):
                for k in range(4):
                    seen[best[2]][k][tuple(x[i - k : i + 1])] += 1

    def prob(v, context, c):
        p = 1 / 32
        for k in range(4):
            ctx = tuple(context[3 - k :])
            after = [n for g, n in seen[v][k].items() if g[:-1] == ctx]
            if after:
                p = (seen[v][k][ctx + (c,)] + len(after) * p) / (sum(after) + len(after))
        return p

    def score(url):
        x = codes(url)
        return sum(math.log(prob("allow", x[i - 3 : i], x[i]) / prob("block", x[i - 3 : i], x[i])) for i in range(3, len(x))) / (len(x) - 3)

    scores = [score(p[1]) for p in parts]
    both = {v: [s for s, p in zip(scores, parts) if p[4] and p[4][2] == v] for v in ("allow", "block")}
    cut = 0.0
    if all(both.values()):
        mean = {v: sum(s) / len(s) for v, s in both.items()}
        sd = {v: math.sqrt(max(sum(x * x for x in s) / len(s) - mean[v] ** 2, 1e-12)) for v, s in both.items()}
        cut = (mean["allow"] * sd["block"] + mean["block"] * sd["allow"]) / (sd["allow"] + sd["block"])
    return [(p[0], p[2], p[3], p[4] and p[4][0] + p[4][1], p[4][2] if p[4] else "allow" if s >= cut else "block", round(s, 6)) for p, s in zip(parts, scores)]


URLS = [None, "", "no scheme.com/en/", "http://Example.COM/en/x", "https://www.example.com/en/?q", "http://a.example.com/en/1#t", "http://example.com", "http://com/", "http://x.net/es/1", "http://x.net/fr/2?a=/b", "http://x.net/en/2", "http://é.org/ü/Z-9_%", "http://blog.org/en/55.html", "http://notexample.com/en/", "http://a.com?x=/en/", "x://y://z.net/es/", "http://shop.net/de/7", "http://shop.net/de/7"]


def test_rules_models_and_cut_match_brute_force(spark):
    rows = [(i if i != 4 else None, u) for i, u in enumerate(URLS)]
    df = spark.createDataFrame([(i, u, "h", 1.0) for i, u in rows], "page_id long, url string, host string, score double")
    got = sorted(map(tuple, urls.judge_urls(df).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 2e-6 for g, w in zip(got, want))
    pages = df.select("page_id", "url").toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("pages", pages)
    sql = sorted([tuple(None if x != x else x for x in r) for r in con.execute(urls.oracle()).fetchall()], key=str)
    assert [s[1:5] for s in sql] == [w[1:5] for w in sorted(want, key=lambda w: str((float(w[0]) if w[0] is not None else None, *w[1:])))] or {s[1:5] for s in sql} == {w[1:5] for w in want}


@pytest.mark.parametrize("picked", [[], [None, "http://q.org/"]])
def test_without_labels_everything_is_allowed(spark, picked):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(picked)], "page_id long, url string")
    assert [(r.verdict, r.score) for r in urls.judge_urls(df).collect()] == [("allow", 0.0)] * len(picked)
