"""Phrases, URL rules and centroid clustering against brute force: nulls, empty and very long texts, ties, repeated rows, clashing
columns, empty tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from ionframe.llm import collocations, rotated, urlrules
from pyspark.sql import functions as F


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Phrases


def mined(rows, support, longest=4):
    """f of every phrase by language, and the words of each language."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            if words:
                n[lang or "und" if lang is None else lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f["und" if lang is None else lang][tuple(words[i : i + size])] += 1
    return {k: {p: c for p, c in v.items() if c >= support} for k, v in f.items()}, n


def ranked(rows, top, support):
    f, n = mined(rows, support)
    out = []
    for lang, counts in f.items():
        kept = []
        for p, a in counts.items():
            if len(p) < 2:
                continue
            cuts = [(2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            around = [c for q, c in counts.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * c >= 80 * a for c in around):
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out, key=repr)


def texts(seed, n):
    rng = np.random.default_rng(seed)
    words = "der the And of a b c é ÉÉ d' \x1c x\xa0y zu zu-zu".split(" ")
    marks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "! "]
    line = lambda k: "".join(w + m for w, m in zip(rng.choice(words, k), rng.choice(marks, k)))
    rows = [(line(rng.integers(1, 60)), str(rng.choice(["en", "de"])) if rng.random() < 0.8 else None) for _ in range(n)]
    return rows + [(None, "en"), ("", "de"), (" \t.", None), ("Only one", ""), ("the of " * 3000, "en"), ("same line here", "und")] + [("New York, new york new", "en")] * 9


def frame(spark, rows, parts):
    schema = "text string, lang string, f long, n long, phrase string, rank int, shard int, size int, words string"
    return spark.createDataFrame([(t, k, 1, 2, "p", 3, 4, 5, "w") for t, k in rows], schema).repartition(parts)


@pytest.mark.parametrize(("parts", "support", "top"), [(1, 3, 40), (7, 3, 10_000), (13, 8, 25)])
def test_phrases_equal_brute_force(spark, parts, support, top):
    rows = texts(parts, 150)
    got = collocations.collocations(frame(spark, rows, parts), top=top, support=support)
    assert rows_of(got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")) == ranked(rows, top, support)


def test_small_blocks_and_saturated_filters_change_nothing(spark, monkeypatch):
    rows = texts(5, 80)
    for name, value in (("BLOCK_WORDS", 40), ("HELD_WORDS", 90), ("HELD_KEYS", 7), ("LEAST_BITS", 8), ("MOST_BITS", 8), ("PART_WORDS", 200), ("MOST_PARTS", 4), ("ROWS", 3)):
        monkeypatch.setattr(collocations, name, value)
    got = collocations.collocations(frame(spark, rows, 6), top=500, support=4, shards=3)
    assert rows_of(got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")) == ranked(rows, 500, 4)


def test_mined_counts_are_exact(spark):
    rows = texts(8, 60)
    counts, words = collocations.mine(frame(spark, rows, 5), support=4)
    f, n = mined(rows, 4)
    assert rows_of(counts.select("lang", "size", "phrase", "f")) == sorted(((k, len(p), " ".join(p), c) for k, v in f.items() for p, c in v.items()), key=repr)
    assert {r.lang: r.n for r in words.collect()} == dict(n)


def test_no_texts(spark):
    empty = frame(spark, [], 2)
    got = collocations.collocations(empty)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.count() == 0
    assert collocations.collocations(frame(spark, [(None, None), ("rare words", "en")], 2)).count() == 0


# URL rules

RULES = [
    ("com", "/", "allow"), ("Example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/e", "block"),
    ("net", "/e", "allow"), ("a.net", "/", "allow"), ("org", "", "block"), ("x.org", None, "allow"), (None, "/", "block"), ("", "/", "block"),
    ("bad/host", "", "block"), ("info", "en", "block"), ("info", "/", "maybe"), ("aa.b", "/c/", "block"), ("b", "/c/ddd", "allow"), ("dd.b", "/c", "block"),
    ("d.dd.b", "/", "allow"), ("b", "/é/ü", "block"),
]
URLS = [
    "http://example.com/en/1", "HTTP://WWW.EXAMPLE.COM/en/x?y", "https://m.www.example.com/en", "http://com/", "http://com", "http://xcom/", "a.com/",
    None, "", "://", "http://", "http://a.net/e", "http://b.a.net/ee/", "http://net/E", "http://z.org", "http://z.x.org#f", "http://x.org?q=http://com/",
    "http://.com/", "http://com./", "http://user@h.com:80/", "http://info/en", "http://q.aa.b/c/ddd/", "http://dd.b/c/ddd", "http://d.dd.b/c", "http://b/é/üx",
    "http://b//c/ddd", "x://y://com/", "http://" + "a." * 20_000 + "com/" + "en/" * 20_000, "http://example.com/en/1", "http://Ünï.com/\n", "http://example.com/en\n/",
]


def verdict(url, rules, default="allow"):
    rest = (url or "").partition("://")[2]
    whole = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(whole) :]).group()
    host = whole.translate({c: c + 32 for c in range(65, 91)})
    best = None
    for h, p, v in rules:
        h, p = (h or "").lower(), p or ""
        if h and v in ("allow", "block") and (host == h or host.endswith("." + h)) and path.startswith(p) and (not p or p[0] == "/"):
            best = max(best or (0,), (len(h + p), len(h), v, h + p))
    return host, path, best and best[3], best[2] if best else default


def pages_of(spark, urls):
    schema = "page_id long, url string, host string, path string, rule string, prefix string, verdict int"
    return spark.createDataFrame([(k if k % 7 else None, u, "h", "p", "r", "x", 1) for k, u in enumerate(urls)], schema).repartition(3)


@pytest.mark.parametrize("default", ["allow", "block"])
def test_verdicts_equal_brute_force(spark, default):
    rules = spark.createDataFrame([(*r, 1) for r in RULES], "host string, path string, verdict string, prefix int")
    got = urlrules.judge(pages_of(spark, URLS), rules, default=default)
    assert rows_of(got) == sorted(((k if k % 7 else None, *verdict(u, RULES, default)) for k, u in enumerate(URLS)), key=repr)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b.a", "c.b.a", "b"]), st.sampled_from(["", "/", "/x", "/x/", "/x/y"]), st.sampled_from(["allow", "block"])), min_size=1, max_size=6))
def test_any_rules(spark, rules):
    urls = [f"h://{h}{p}{q}" for h in ("a", "b.a", "z.c.b.a", "ba") for p in ("", "/", "/x", "/x/", "/x/yz", "/xx/") for q in ("", "?/x")]
    got = urlrules.judge(pages_of(spark, urls), spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert rows_of(got) == sorted(((k if k % 7 else None, *verdict(u, rules)) for k, u in enumerate(urls)), key=repr)


def test_no_rules_and_no_pages(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert {(r.rule, r.verdict) for r in urlrules.judge(pages_of(spark, URLS), rules.limit(0)).collect()} == {(None, "allow")}
    empty = urlrules.judge(pages_of(spark, URLS).limit(0), rules)
    assert empty.columns == ["page_id", "host", "path", "rule", "verdict"] and empty.count() == 0


def test_main_path_is_native(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    plan = urlrules.judge(pages_of(spark, URLS).limit(3), rules)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


# Centroid clustering


def lloyd(rows, clusters, rounds, dims, scale):
    kept = []
    for key, x in rows:
        if x is not None and len(x) == dims and all(v is not None and np.isfinite(v) and abs(v * scale) < 1 << 27 for v in x):
            kept.append((key, [int(np.floor(float(np.float32(v)) * scale)) for v in x]))
    name = lambda k: hashlib.sha256(f"2:{'' if k is None else k}".encode()).hexdigest()
    centroids = [x for _, x in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centroids)) for _, x in kept]

    for _ in range(rounds):
        of = nearest()
        for k in range(len(centroids)):
            own = [x for (_, x), (_, c) in zip(kept, of) if c == k]
            if own:
                centroids[k] = [sum(v) // len(own) for v in zip(*own)]
    of = nearest()
    total = Counter()
    for d, c in of:
        total[c] += d
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted(((key, c, d, total[c], sum(total.values()), digest(c)) for (key, _), (d, c) in zip(kept, of)), key=repr)


def vectors_of(spark, rows):
    schema = "vec_id long, embedding array<float>, vector int, lead int, rest int, cluster int, distance int"
    return spark.createDataFrame([(k, x, 1, 2, 3, 4, 5) for k, x in rows], schema).repartition(3)


def vectors(seed, n, dims):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    rows = [(k, (centres[k % 5] + rng.normal(size=dims) * 0.2).astype(np.float32).tolist()) for k in range(n)]
    same = rows[3][1]
    odd = [[float("nan"), *same[1:]], [None, *same[1:]], [float("inf"), *same[1:]], [float("-inf"), *same[1:]], same[1:], None, [], [1e30, *same[1:]]]
    return rows + [(k, same) for k in range(n, n + 40)] + [(3, same), (None, same), (None, None)] + [(900 + k, x) for k, x in enumerate(odd)]


@pytest.mark.parametrize(("clusters", "rounds", "dims", "leading"), [(6, 3, 8, 2), (12, 5, 8, 8), (200, 2, 6, 1), (1, 0, 8, 3)])
def test_clusters_equal_brute_force(spark, clusters, rounds, dims, leading):
    rows = vectors(clusters, 90, dims)
    got = rotated.cluster(spark, vectors_of(spark, rows), clusters, rounds, scale=16, dims=dims, leading=leading)
    assert rows_of(got) == lloyd(rows, clusters, rounds, dims, 16)


def test_no_vectors(spark):
    empty = vectors_of(spark, [(1, None), (2, [1.0])])
    got = rotated.cluster(spark, empty)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0


def test_bounds_hold_and_rule_out():
    rng = np.random.default_rng(3)
    spread = np.array([40.0, 30, 20, 10] + [1] * 28)
    x = np.floor(rng.normal(size=(500, 32)) * spread * 10).astype(np.int64)
    _, axes = np.linalg.eigh(np.cov(x.T.astype(float)))
    to = rotated.Filter(x[:20].tolist(), axes[:, ::-1], 4)
    lead, rest = rotated.rotated(x, axes[:, ::-1], 4)
    exact = ((x[:, None, :] - to.exact) ** 2).sum(2)
    assert (to.bounds(lead, rest) <= exact * (1 + 1e-9) + 1e-6).all()
    clusters, distances, verified = to.nearest(x, lead, rest)
    assert (clusters == exact.argmin(1)).all() and (distances == exact.min(1)).all() and verified < 0.4 * exact.size


def test_large_components_stay_exact(spark):
    big = float((1 << 27) - 64)
    rows = [(k, [big * s, -big * s, float(k)]) for k, s in enumerate([1.0, -1.0, 1.0, 0.5, -0.5, 1.0])]
    got = rotated.cluster(spark, vectors_of(spark, rows), 2, 3, scale=1, dims=3)
    assert rows_of(got) == lloyd(rows, 2, 3, 3, 1)
    assert got.where(F.col("inertia").isNull()).count() == 0
