"""URL rules and host graph, importance resampling, source divergence: edge cases and plain recomputation."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lithoscope.llm import importance_resampling, source_divergence, url_graph
from lithoscope.llm.url_graph import Rule

PAGES = "page_id long, url string, html string, host string, path string, rank int, verdict string, src string"
RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "p", 1, "v", "s") for r in rows], PAGES)


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "http://a.example.net/EN/x", "https://example.net", "https://example.net?u=/en/", "http://xexample.com/de/", "http://www.example.com/de/1", "http://org/fr/", "http://x.org/fra/", None, "",
            "no host", "x://", "a://b://c/d", "http://\u00c9.org/fr/\u00e9", "HTTP://example.com:80/de/", "http://net/"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_graph.judge_urls(pages(spark, [(i, u, None) for i, u in enumerate(urls)]), RULES).collect()}
    want = [("a.example.net", "/en/x", "example.net/en/", "allow"), ("a.example.net", "/EN/x", "net/", "block"), ("example.net", "", None, "allow"), ("example.net", "", None, "allow"),
            ("xexample.com", "/de/", None, "allow"), ("www.example.com", "/de/1", "example.com/de/", "block"), ("org", "/fr/", "org/fr/", "allow"), ("x.org", "/fra/", None, "allow"),
            *[("", "", None, "allow")] * 4, ("b:", "//c/d", None, "allow"), ("\u00c9.org", "/fr/\u00e9", "org/fr/", "allow"), ("example.com:80", "/de/", None, "allow"), ("net", "/", "net/", "block")]
    assert [got[i] for i in range(len(urls))] == want
    assert url_graph.judge_urls(pages(spark, []), RULES).count() == 0
    twice = [Rule("a", "/b", "allow"), Rule("b.a", "/", "block")]  # both are four characters long: the blocking one wins
    assert url_graph.judge_urls(pages(spark, [(1, "x://b.a/b", None)] * 3), twice).groupBy("rule", "verdict").count().collect() == [("b.a/", "block", 3)]
    with pytest.raises(ValueError, match="rules"):
        url_graph.judge_urls(pages(spark, []), [Rule("a", f"/{i}", "allow") for i in range(1001)])


def test_host_graph_against_plain_rounds(spark):
    """A made web: links of all spellings, a hub that a third of the pages belong to, blocked and trusted corners."""
    draw = random.Random(4)
    hosts = ["hub.example.com", *(f"h{i}.example.com" for i in range(30)), "bad.net", "worse.net", "good.org", "fine.org"]
    rows = []
    for i in range(400):
        host = "hub.example.com" if i % 3 == 0 else draw.choice(hosts)
        links = "".join(draw.choice(['<a HREF="http://{}/x">', "<img src='//{}'>", "<a href = https://{}?q>", '<form action="HTTPS://{}/">', "<p>http://{}</p>", '<a href="/{}">']).format(draw.choice(hosts).upper()) for _ in range(draw.choice([0, 1, 4])))
        rows.append((i, f"http://{host}/{draw.choice(['de/', 'fr/', 'x'])}", links))
    rows += [(1000 + i, f"http://near{i % 3}.com/x", '<a href="http://bad.net/">') for i in range(6)] + [(2000, None, '<a href="http://h1.example.com">'), (2001, "http://alone.com/x", None)] + [(3000, "http://h2.example.com/de/", "")] * 40
    got = url_graph.judge_urls(pages(spark, rows), RULES, rounds=9).collect()
    edges, per = Counter(), defaultdict(list)
    for _, url, html in rows:
        src = (re.match(r"http://([^/?#]*)", url or "") or [0, ""])[1]
        path = url[7 + len(src):] if url else ""
        rule = max((r for r in RULES if (src == r.host or src.endswith("." + r.host)) and path.startswith(r.path)), key=lambda r: len(r.text), default=None)
        per[src].append(rule.verdict if rule else None)
        for dst in {h.lower() for h in re.findall(r"""(?i)(?:href|src|action)\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)""", html or "")}:
            edges[src, dst] += src != "" and src != dst
    edges = +edges
    ranks = {}
    for kind, verdict in (("trust", "allow"), ("distrust", "block")):
        ways = {(a, b) if kind == "trust" else (b, a): n for (a, b), n in edges.items()}
        out = Counter()
        for (a, _), n in ways.items():
            out[a] += n
        base = {h: 10**9 * v.count(verdict) // len(v) * 15 // 100 for h, v in per.items() if h}
        now = dict(base)
        for _ in range(9):
            after = Counter(base)
            for (a, b), n in ways.items():
                after[b] += math.floor(now.get(a, 0) * (0.85 * n / out[a]))
            now = after
        ranks[kind] = now
    assert len(edges) > 100 and {r.page_id for r in got} == {r[0] for r in rows} and len(got) == len(rows)
    for r in got:
        assert (r.trust, r.distrust) == ((ranks["trust"].get(r.host, 0), ranks["distrust"].get(r.host, 0)) if r.host else (0, 0))
        assert r.rule or r.verdict == ("block" if 2 * (r.distrust - r.trust) > 15 * 10**7 else "allow")
    verdict = {r.host: r.verdict for r in got if r.rule is None}
    assert verdict["alone.com"] == "allow" and "block" in verdict.values()


DOCS = "doc_id long, text string, lang string, source string, weight double, rank int, row int, place int, word string, term string, n int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1.0, 1, 1, 1, "w", "t", 1) for r in rows], DOCS)


def drawn_by_hand(rows, bench, percent=25):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(words), [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    every, target = [(i, *features(t)) for i, t in rows], Counter(b for t in bench for b in features(t)[1])
    raw = Counter(b for _, _, f in every for b in f)
    s, t = sum(raw.values()), sum(target.values())
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1) * (s + 10_000) / ((raw[b] + 1) * (t + 10_000))))
    out = []
    for i, n, f in every:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))[: percent * sum(r[4] >= 20 for r in out) // 100]
    rank = {id(r): k for k, r in enumerate(able, 1)}
    return [(*r[:4], rank.get(id(r))) for r in out]


def test_resampling(spark):
    draw = random.Random(1)
    words = ["river", "Stone", "\u00c9cole", "na\u00efve", "x1", "7", "\u6f22\u5b57", "\U0001f600", "don't", "a-b", "\u212a"]
    rows = [(i, " ".join(draw.choices(words, k=draw.choice([0, 1, 5, 19, 25, 60])))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \x00\t.,"), (203, "long River " * 60_000), (None, "of a null id " * 9), (None, "of a null id " * 9)] + [(300, "the same text again and again for each of the twenty rows " * 3)] * 20
    bench = ["river stone \u00c9cole", None, "", "again and again x1 7 " * 9]
    got = importance_resampling.importance_resample(docs(spark, [(*r, None, None) for r in rows]), spark.createDataFrame([(t,) for t in bench], "text string")).collect()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(drawn_by_hand(rows, bench), key=key)
    some = docs(spark, [(*r, None, None) for r in rows[:40]])
    none = importance_resampling.importance_resample(some, spark.createDataFrame([], "text string"), percent=100).collect()
    assert sorted(map(tuple, none), key=key) == sorted(drawn_by_hand(rows[:40], [], 100), key=key)
    assert importance_resampling.importance_resample(some.limit(0), some).count() == 0


def test_positions_of_three_orders(spark):
    table = importance_resampling.position_table(docs(spark, [(1, "a B c a", None, None)]), "doc_id", orders=3, buckets=1 << 31)
    crc = lambda f: None if f is None else zlib.crc32(f.encode()) % (1 << 31)
    want = [("a", "a b", "a b c"), ("b", "b c", "b c a"), ("c", "c a", None), ("a", None, None)]
    assert sorted(map(tuple, table.select("b1", "b2", "b3").collect()), key=str) == sorted((tuple(map(crc, w)) for w in want), key=str)


def divergence_by_hand(rows, least, top=50):
    find = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    groups, present = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        groups[lang or "", source or ""].update(find(text))
        present[lang or ""].update(set(find(text)))
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in present.items()}
    price = lambda c, terms: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[t] for t in terms) + 5 * len(terms)) for t in terms}
    p = {g: price(c, kept[g[0]]) for g, c in groups.items()}
    out = []
    for lang, source in groups:
        whole = Counter()
        for (other, _), c in groups.items():
            if other == lang:
                whole.update(c)
        q, own = price(whole, kept[lang]), p[lang, source]
        pairs = [(-sum(abs(own[t] - p[lang, b][t]) for t in own), b) for a, b in groups if a == lang and b != source]
        terms = [(q[t] - own[t], t) for t in own if groups[lang, source][t] and own[t] > q[t]]
        for part, items in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
            out += [(lang, source, part, item, -value, rank) for rank, (value, item) in enumerate(items, 1)]
    return out


@pytest.mark.parametrize("least", [1, 3, 1000])
def test_divergence(spark, least):
    draw = random.Random(2)
    vocabulary = ["river", "Stone", "\u00c9cole", "na\u00efve", "x1y", "\u6f22\u5b57", "\U0001f600", "don't", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([0, 3, 30]))), draw.choice(["en", "de", None, ""]), "hot" if i % 3 == 0 else draw.choice(["a", "b", None, "\u00e9", "\U0001f600"])) for i in range(200)]
    rows += [(300, None, "fr", "only"), (301, "", "en", "wordless"), (302, "river stone " * 50_000, "en", "long"), (302, "river river", "en", "a"), (302, "river river", "en", "a"), (None, None, None, None)]
    got = source_divergence.source_divergence(docs(spark, rows), least_docs=least)
    assert sorted(map(tuple, got.collect())) == sorted(divergence_by_hand(rows, least))
    if least == 1:
        assert source_divergence.source_divergence(docs(spark, [])).count() == 0 and dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
