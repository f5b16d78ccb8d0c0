from collections import Counter, defaultdict

from churnloom.llm import mixing, url_filters
from churnloom.llm import queries
from oracle import compare
from tests.llm import plain
from tests.llm.conftest import ODD, SMALL


def _near(a, b):
    return a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6 * max(1, b[3]) and a[4] == b[4]


def test_mix(spark, documents, odd, nothing):
    assert compare.differences(queries.op9_mixing(spark, SMALL), compare.connect(SMALL), mixing.ORACLE) == []
    for df, rows in ((documents, documents.select("doc_id", "text", "source").collect()), (odd, [(r[0], r[1], r[3]) for r in ODD])):
        found = sorted(map(tuple, mixing.mix(df).collect()), key=repr)
        expected = sorted((r[:5] for r in plain.mix(rows)), key=repr)
        assert len(found) == len(expected) and all(map(_near, found, expected))
        assert all(r[4] <= 3 * r[1] for r in found)
    assert mixing.mix(nothing).collect() == []
    assert sorted(mixing.mix(documents).collect()) == sorted(mixing.mix(documents.repartition(5)).collect())


def test_mix_is_one_row_of_words(documents):
    entries = mixing.merged(mixing.queue(documents)).orderBy("mix_start").collect()
    at, last = 0, 0.0
    for e in entries:
        assert e.mix_start == at and e.finish >= last
        at, last = at + e.words, e.finish
    assert at == sum(r.size for r in mixing.queue(documents).select("size").collect())
    taken, longest = Counter(), max(e.size for e in entries)
    for e in entries:
        taken[e.source_key] += e.words
    # The cut of the merged order leaves each source within a document or two of its target.
    assert all(abs(taken[e.source_key] - e.target) <= 2 * longest for e in entries)
    assert sum(e.words < e.size for e in entries) <= 1


def test_rows_of_one_id_or_none_do_not_queue_in_one_place(spark):
    rows = [(None if i % 2 else 7, f"word{i} " * (1 + i % 9), "a" if i % 3 else "b") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    assert mixing.queue(df).select("chunk").distinct().count() > 100
    found = sorted(map(tuple, mixing.mix(df).collect()), key=repr)
    expected = sorted((r[:5] for r in plain.mix(rows)), key=repr)
    assert all(map(_near, found, expected)) and len(found) == len(expected)


def test_mixed_documents(documents, odd, nothing):
    rows = documents.select("doc_id", "text", "source").collect()
    expected = {d: sum(2 * p >= size for p in parts if p) for d, size, *_, parts in plain.mix(rows)}
    found = Counter(r.doc_id for r in mixing.mixed_documents(documents).collect())
    assert found == Counter({d: n for d, n in expected.items() if n})
    got = mixing.mixed_documents(odd)
    assert got.columns == odd.columns and {r.doc_id for r in got.collect()} <= {r[0] for r in ODD}
    assert mixing.mixed_documents(nothing).collect() == []


URLS = [
    (1, "https://shop.com/a?b#c", None), (2, "http://EXAMPLE.com/en/x", ""), (3, "http://www.example.com/en/", None), (4, "ftp://a.net/es/1", None),
    (5, "http://net/fr/", None), (6, "http://a.net/de/", None), (7, "no scheme", None), (8, None, None), (9, "://", None),
    (10, "http://Ünet.net/es/#x", None), (11, "http://example.com", None), (12, "http://notexample.com/en/", None), (12, "http://sub.example.com/en/z", None),
    (None, "http://x.org/?q=://y.com/", None), (13, "http://q.org\\nr/p", "<a href=")]


def _plain_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return rest[:end].translate(plain.LOWER), path[:stop]


def test_rules(spark):
    pages = spark.createDataFrame([(*u, "x") for u in URLS], "page_id long, url string, html string, host string")
    found = Counter(map(tuple, url_filters.url_filters(pages).collect()))
    expected = Counter()
    for page, url, _ in URLS:
        host, path = _plain_url(url)
        fits = [r for r in url_filters.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text), default=None)
        expected[page, host, path, rule.text if rule else None, rule.verdict if rule else None] += 1
    loose = Counter()
    for (page, host, path, rule, verdict), n in found.items():
        assert verdict in ("allow", "block")
        loose[page, host, path, rule, verdict if rule else None] += n
    assert loose == expected
    assert url_filters.url_filters(pages.limit(0)).collect() == []


def test_trust_and_distrust(spark):
    rows, n = [], 0
    links = {"good.com": ["a.org", "b.org"], "a.org": ["b.org", "good.com"], "farm.org": ["bad.net"] * 4, "bad.net": ["bad.net"], "far.org": ["farm.org"],
             "alone.org": []}
    for host, targets in links.items():
        for path in ("/es/1", "/es/2") if host == "bad.net" else ("/en/1", "/en/2"):
            n += 1
            rows.append((n, f"http://{host}{path}", " ".join(f'<a class=x HREF="https://{t}/p">t</a>' for t in targets)))
    rows.append((99, "http://bad.net/de/", '<a href="/self"><a href="//bad.net/x"><a href="mailto:q@z.org">'))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    hosts = {r.host: r for r in url_filters.host_verdicts(pages).collect()}
    # The same by plain iteration.
    edges = Counter()
    for _, url, html in rows:
        src = _plain_url(url)[0]
        for part in html.lower().split('href="')[1:]:
            link = part.split('"')[0]
            if link.startswith("mailto"):
                continue
            edges[src, src if link.startswith("/s") else _plain_url(("x:" if link.startswith("//") else "") + link)[0]] += 1
    pages_of = Counter(_plain_url(u)[0] for _, u, _ in rows)
    for kind, seeds, moves in (("trust", {"good.com": 1.0}, edges), ("distrust", {"bad.net": 1.0}, {(b, a): k for (a, b), k in edges.items()})):
        given = Counter()
        for (a, _), k in moves.items():
            given[a] += k
        score = dict(seeds)
        for _ in range(url_filters.ITERATIONS):
            new = defaultdict(float, {h: 0.15 * s for h, s in seeds.items()})
            for (a, b), k in moves.items():
                new[b] += 0.85 * score.get(a, 0) * k / given[a]
            score = new
        for host, n in pages_of.items():
            assert abs(score.get(host, 0) * 2 / n - (hosts[host][kind] if host in hosts else 0)) < 1e-9
    verdicts = {r.page_id: r.verdict for r in url_filters.url_filters(pages).collect()}
    assert verdicts[7] == verdicts[8] == "block" or hosts["farm.org"].distrust < url_filters.LEAST_DISTRUST
    assert verdicts[3] == "allow" and verdicts[11] == "allow"


def _linked(spark, links, blocked):
    """Pages of hosts: host to the hosts that each of its pages links to, and how many of 100 pages a rule blocks."""
    rows = [(f"http://{host}{'/es/' if i < blocked.get(host, 0) else '/en/'}{i}", "".join(f'<a href="http://{t}/">' for t in targets))
            for host, targets in links.items() for i in range(100 if host in blocked else 1)]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    return {(r.host, r.path[:4]): r.verdict for r in url_filters.url_filters(pages).collect()}


def test_own_share_counts_whatever_the_links(spark):
    farms = {f"farm{i}.org": ["bad.net"] for i in range(50)}
    # Without links, linked by farms, and half linked to itself by as many links as come from the farms.
    for links in ({"bad.net": []}, {"bad.net": [], **farms}, {"bad.net": ["bad.net"], **{f: t * 2 for f, t in farms.items()}}):
        got = _linked(spark, links, {"bad.net": 99})
        assert got["bad.net", "/en/"] == "block"
        assert all(got[f, "/en/"] == "block" for f in farms if f in links)
    # Links of a host to itself do not add to its share.
    got = _linked(spark, {"fair.net": ["fair.net"], "half.net": ["half.net"]}, {"fair.net": 49, "half.net": 50})
    assert got["fair.net", "/en/"] == "allow" and got["half.net", "/en/"] == "block"


def test_rounds_end_at_the_residual(spark):
    # Two hosts that hand all to each other keep all seeds: the slowest case.
    shares = url_filters.link_shares(spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, n long"))
    seeds = spark.createDataFrame([("trust", "a", 1.0)], "kind string, host string, seed double")
    got = {r.host: r.score for r in url_filters.propagate(shares, seeds).collect()}
    a = 0.15 / (1 - 0.85 ** 2)
    assert abs(got["a"] - a) < 1e-9 and abs(got["b"] - 0.85 * a) < 1e-9
