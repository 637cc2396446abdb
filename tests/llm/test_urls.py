"""URL filtering against a brute-force version that walks the tree of each host in Python."""

import re
from collections import Counter, defaultdict

import pytest

from lamella.llm import urls
from lamella.llm.queries import QUERIES, RULES

FOLDER = "/root/testdata/sf0.01"
SETTINGS = urls.Settings()


def parse(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    if not found:
        return "", ""
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in found[1])
    return host, found[2]


def rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.name), len(r.host), r.name), default=None)


def share(blocked, labels, prior):
    return (blocked + SETTINGS.strength * prior) / (labels + SETTINGS.strength)


def walk(rows, depth, template, above, out):
    """``rows``: (path, shapes, n, blocked, labels) of a node."""
    s = SETTINGS
    goes_on = len(rows) >= s.many
    for r in rows:
        if len(r[1]) <= depth or not goes_on:
            out[r[0]] = (template + "".join("/" + x for x in r[1][depth:]), above, len(r[1]) <= depth, r)
    rows = [r for r in rows if len(r[1]) > depth] if goes_on else []
    children, spread = defaultdict(list), defaultdict(Counter)
    for r in rows:
        children[r[1][depth]].append(r)
        spread[r[1][depth]]["/" + r[1][depth + 1] if len(r[1]) > depth + 1 else ""] += r[2]
    total, all_n = sum(spread.values(), Counter()), sum(r[2] for r in rows)
    blocked, labels = sum(r[3] for r in rows), sum(r[4] for r in rows)
    joins = set()
    for c, own in children.items():
        n, own_blocked, own_labels = (sum(r[k] for r in own) for k in (2, 3, 4))
        expected = blocked / max(labels, 1)
        error = (own_labels * expected * (1 - expected) + 1) ** 0.5
        apart = 1 - sum(min(k / n, total[x] / all_n) for x, k in spread[c].items())
        like = abs(own_blocked - own_labels * expected) <= s.errors * error and apart <= s.distance
        if (n < s.few and len(children) >= s.many) or (like and len(children) > 1):
            joins.add(c)
    branches = defaultdict(list)
    for c, own in children.items():
        branches["*" if c in joins and len(joins) > 1 else c] += own
    for segment, own in branches.items():
        walk(own, depth + 1, f"{template}/{segment}", share(sum(r[3] for r in own), sum(r[4] for r in own), above), out)


def brute(pages, rules):
    seen, verdicts = Counter(), {}
    for _, url in pages:
        seen[parse(url)] += 1
    hosts = defaultdict(list)
    for (host, path), n in seen.items():
        r = rule(host, path, rules)
        shapes = re.sub("[0-9]+", "<n>", re.sub("^/", "", path)).split("/") if path else []
        hosts[host].append((path, shapes, n, n * (r is not None and not r.allowed), n * (r is not None)))
    every = [r for rows in hosts.values() for r in rows]
    total = sum(r[3] for r in every) / max(1, sum(r[4] for r in every))
    for host, rows in hosts.items():
        out = {}
        walk(rows, 0, "", share(sum(r[3] for r in rows), sum(r[4] for r in rows), total), out)
        leaves = defaultdict(list)
        for found in out.values():
            leaves[found[0]].append(found)
        for template, found in leaves.items():
            above = max(f[1] for f in found)
            if not any(f[2] for f in found):
                above = share(sum(f[3][3] for f in found), sum(f[3][4] for f in found), above)
            for f in found:
                verdicts[host, f[3][0]] = (template, above)
    for id_, url in pages:
        host, path = parse(url)
        r = rule(host, path, rules)
        template, purity = verdicts[host, path]
        if r:
            yield id_, host, path, r.name, "allow" if r.allowed else "block", None, None
        else:
            yield id_, host, path, None, "block" if purity > SETTINGS.rejected else "allow", template, round(purity, 9)


def told(df):
    return sorted(
        ((*tuple(r)[:6], None if r["share"] is None else round(r["share"], 9)) for r in df.collect()), key=repr
    )


def test_query_agrees_with_brute_force(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url").collect()]
    result = QUERIES["op12_urls"](spark, FOLDER)
    assert result.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    assert told(result) == sorted(brute(pages, RULES), key=repr)


def made(paths, host="a.net"):
    return [f"http://{host}{p}" for p in paths]


CASES = {
    # Blocked users with numbered pages: pages of users that no rule knows are as bad.
    "wildcard": (
        made([f"/u/bad{c}/{k}" for c in "abcdefghijklmnop" for k in range(3)] + [f"/u/new{c}/{k}" for c in "abc" for k in range(2)])
        + made([f"/news/{k}" for k in range(40)]),
        [*[urls.Rule("a.net", f"/u/bad{c}", False) for c in "abcdefghijklmnop"], urls.Rule("a.net", "/news/1", True)],
    ),
    # Branches whose labels differ stay apart.
    "labels": (
        made([f"/good/{k}" for k in range(30)] + [f"/bad/{k}" for k in range(30)]),
        [urls.Rule("a.net", "/good/1", True), urls.Rule("a.net", "/bad/1", False), urls.Rule("a.net", "/bad/2", False)],
    ),
    # Branches whose structures differ stay apart.
    "structure": (
        made([f"/x/{k}" for k in range(20)] + [f"/y/{k}" for k in range(20)] + [f"/z/page{k}/more" for k in range(20)]),
        [urls.Rule("a.net", "/x/1", False)],
    ),
    "no labels": (made([f"/{c}/{k}" for c in "abc" for k in range(5)]), []),
    "two hosts": (made([f"/{c}/{k}" for c in "abc" for k in range(9)]) + made(["/a/1", "/a/2"], "b.net"), [urls.Rule("net", "/a", False)]),
    "deep": (made([f"/a/b/c/d/e/f/{c}/g" for c in "abcdefghijklmn"] + ["/" + "s/" * 3000]), [urls.Rule("net", "/a/b/c/d/e/f/a", False)]),
}


@pytest.mark.parametrize("case", CASES)
def test_templates(spark, case):
    addresses, rules = CASES[case]
    pages = list(enumerate(addresses)) + [(0, addresses[0])]
    df = spark.createDataFrame(pages, "page_id long, url string")
    found = told(urls.judged(df, rules))
    assert found == sorted(brute(pages, rules), key=repr)
    verdicts = {r[2]: (r[4], r[5]) for r in found}
    if case == "wildcard":
        assert verdicts["/u/newa/0"] == ("block", "/u/*/<n>")
        assert verdicts["/news/2"][0] == "allow"
    if case == "labels":
        assert verdicts["/bad/3"] == ("block", "/bad/<n>") and verdicts["/good/3"] == ("allow", "/good/<n>")
    if case == "structure":
        assert verdicts["/z/page1/more"][1].startswith("/z/") and verdicts["/y/3"][1] == "/*/<n>"


ADDRESSES = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.org", "http://Example.ORG/es/1?x=http://com/fr/", "x://com?/fr/2", "x://com#/de/",
    "http://www.com/fr/1", "http://telecom/fr/1", "http://com/de/ä ö\n", "http://example.org:80/es/", "a://b://c/d", "http://ÄB.com/DE/", "://",
]


def test_edges(spark):
    pages = [(k, u) for k, u in enumerate(ADDRESSES)] + [(None, "http://com/fr/9"), (3, "http://")]
    df = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS share", "1 AS n")
    found = told(urls.judged(df, RULES))
    assert found == sorted(brute(pages, RULES), key=repr)
    assert {r[3] for r in found if r[1] == "com"} == {"com/fr/", "com/de/", None}
    assert next(r for r in found if r[0] == 5)[1:5] == ("example.org", "/es/1", "example.org/es/", "block")
    assert next(r for r in found if r[0] == 9)[3] is None
    assert urls.judged(df.limit(0), RULES).count() == 0


def test_plan_is_native(spark):
    plan = QUERIES["op12_urls"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
