"""Url filters, vector codes and hard negatives against brute force, with the defined edge cases."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("hubcast.llm")
from hubcast.llm import codes, negatives, url_cascade  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, label int, v string, key string, at int, shard long"


def _split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def _judged(url, rules, default="allow"):
    host, path = _split(url)
    fits = []
    for rule, verdict in rules:
        if not rule or verdict not in ("allow", "block"):
            continue
        rh = rule.split("/", 1)[0]
        rp = rule[len(rh):]
        rh = rh.lower()
        if (host == rh or host.endswith("." + rh)) and path.startswith(rp):
            fits.append((len(rh + rp), len(rh), rh + rp, verdict == "block"))
    best = max(fits, default=None)
    return host, path, best and best[2], ("block" if best[3] else "allow") if best else default


URLS = [None, "", "no scheme", "://", "http://", "http:///en/x", "HTTP://WWW.Example.NET/en/1?q=://x/y", "https://example.com?de/", "http://example.com#/de/",
        "http://example.com/de/", "http://a.b.example.com/de/x#y", "http://notexample.com/de/", "http://org/fr/", "http://x.org/fr", "http://.net/", "http://net./",
        "http://é.net/ü", "http://u:p@x.net:80/", "http://x.net:80/", "http://x..net//", "http://" + "a." * 3000 + "net/", "http://x.net/" + "y" * 50_000, "http://x.net/en/\nz"]
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "block"), ("", "block"),
         ("X.net/", "allow"), ("x.net/", "block"), ("é.net", "allow"), ("y.example.com/d", "other")]


def _pages(spark, urls):
    rows = [(i // 2 if i % 9 else None, u, "h", "e", "k") for i, u in enumerate(urls)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string").repartition(3)


def _rules(spark, rules):
    return spark.createDataFrame(rules, "rule string, verdict string")


@pytest.mark.parametrize("max_bytes", [8 << 20, 4])
def test_urls_match_brute_force(spark, max_bytes):
    rows, pages = _pages(spark, URLS * 2)
    got = url_cascade.judge_urls(pages, _rules(spark, RULES), max_bytes=max_bytes).collect()
    want = [(i, *_judged(u, RULES)) for i, u, *_ in rows]
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)


def test_urls_long_lists_need_several_levels(spark, monkeypatch):
    rng = random.Random(3)
    hosts = [f"{rng.choice('abcdefgh')}{i % 40}.{rng.choice(['x', 'y', 'z'])}{i % 7}.com" for i in range(400)]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice('pqrs')}/{rng.randrange(30)}" for _ in range(3000)]
    rules = [(f"{rng.choice(hosts)}/{rng.choice(['', 'p/', 'q/1'])}", rng.choice(["allow", "block"])) for _ in range(300)]
    depths, real = [], url_cascade.build_cascade
    monkeypatch.setattr(url_cascade, "build_cascade", lambda *a: depths.append(real(*a)) or depths[-1])
    _, pages = _pages(spark, urls)
    got = url_cascade.judge_urls(pages.select("page_id", "url"), _rules(spark, rules)).select("host", "path", "rule", "verdict").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(_judged(u, rules) for u in urls)
    assert len(depths[0].levels) >= 3 and len(depths[1].levels) >= 3


def test_urls_empty_tables(spark):
    _, pages = _pages(spark, URLS[:8])
    none = _rules(spark, [])
    assert {r["verdict"] for r in url_cascade.judge_urls(pages, none, default="block").collect()} == {"block"}
    assert url_cascade.judge_urls(pages.limit(0), _rules(spark, RULES)).collect() == []
    unseen = _rules(spark, [("nowhere.example/", "block")])
    assert {r["rule"] for r in url_cascade.judge_urls(pages, unseen).collect()} == {None}


def test_urls_run_without_python_workers(spark):
    _, pages = _pages(spark, URLS[:4])
    plan = url_cascade.judge_urls(spark.range(3).select(F.col("id").alias("page_id"), F.lit("http://a.net/x").alias("url")),
                                  spark.sql("SELECT 'net/' AS rule, 'block' AS verdict"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Join", "Cartesian"))


def _vectors(spark, n=300, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=dim) * 2) / 8], int(rng.integers(0, 4)) if i % 11 else None) for i in range(n)]
    rows += [(5, rows[5][1], 2), (5, rows[6][1], 1), (None, rows[7][1], 1), (n, None, 1), (n + 1, [0.5, None] + [0.0] * (dim - 2), 1),
             (n + 2, [float("nan")] * dim, 1), (n + 3, [float("inf")] * dim, 1), (n + 4, [0.25, 0.5], 2), (n + 5, [], 2), (700, rows[0][1], 3), (700, rows[0][1], 3)]
    rows = [(i, v, y, "v", "k", 1, 2) for i, v, y in rows]
    return rows, spark.createDataFrame(rows, VECTORS).repartition(5)


def _floored(v, scale, dim):
    if v is None or any(x is None or not np.isfinite(x) for x in v):
        return None
    return [int(np.floor(float(np.float32(x)) * scale)) for x in v] + [0] * (dim - len(v))


def _codes_by_hand(rows, parts, entries, rounds, scale, dim):
    kept = [(i, y, q) for i, v, y, *_ in rows if (q := _floored(v, scale, dim)) is not None]
    wide = dim // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[2]))[:entries]
    books = [[r[2][p * wide:(p + 1) * wide] for r in first] for p in range(parts)]
    cut = lambda q, p: q[p * wide:(p + 1) * wide]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda e: (dist(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            of = collections.defaultdict(list)
            for _, _, q in kept:
                of[near(cut(q, p), books[p])].append(cut(q, p))
            books[p] = [[sum(c) // len(of[e]) for c in zip(*of[e], strict=True)] if e in of else books[p][e] for e in range(len(books[p]))]
    out, by_label = [], collections.Counter()
    for i, y, q in kept:
        at = [near(cut(q, p), books[p]) for p in range(parts)]
        error = sum(dist(cut(q, p), books[p][at[p]]) for p in range(parts))
        by_label[y] += error
        out.append((i, y, "".join(f"{e:02x}" for e in at), error))
    spelt = ",".join(str(x) for book in books for e in book for x in e)
    return [(i, c, e, by_label[y]) for i, y, c, e in out], hashlib.sha256(spelt.encode()).hexdigest()


@pytest.mark.parametrize("entries,group,scale", [(16, 4, 4096), (7, 3, 4096), (16, 16, 1 << 30)])
def test_codes_match_brute_force(spark, entries, group, scale):
    rows, table = _vectors(spark)
    made = codes.compress(table, parts=4, entries=entries, rounds=6, scale=scale, group=group, block_rows=37)
    want, digest = _codes_by_hand(rows, 4, entries, 6, scale, 8)
    got = codes.with_label_error(made.rows).select("vec_id", "code", "error", "label_error").collect()
    assert made.sha256() == digest
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    plain = codes.with_label_error(made.rows, small=0).select("vec_id", "code", "error", "label_error").collect()
    assert collections.Counter(map(tuple, plain)) == collections.Counter(want)


def test_codes_few_rows_and_none(spark):
    rows, table = _vectors(spark, n=9)
    made = codes.compress(table.where("vec_id < 3"), parts=3, entries=16, rounds=2)
    want, digest = _codes_by_hand([r for r in rows if r[0] is not None and r[0] < 3], 3, 16, 2, 4096, 9)
    assert made.sha256() == digest and sorted(r["code"] for r in made.rows.collect()) == sorted(w[1] for w in want)
    empty = codes.compress(table.limit(0))
    assert empty.spelled() == "" and codes.with_label_error(empty.rows).collect() == []


def test_bounds_agree_with_full_scans_and_spare_them():
    rng = np.random.default_rng(4)
    centres = rng.integers(-3000, 3000, (16, 8))
    x = centres[rng.integers(0, 16, 4000)] + rng.integers(-200, 200, (4000, 8))
    history = [x[:16].copy()]
    state = codes.first_assignment(x, history[0], 4)
    measured = []
    for _ in range(8):
        book = history[-1].copy()
        for e in range(16):
            if (state.own == e).any():
                book[e] = x[state.own == e].sum(axis=0) // (state.own == e).sum()
        history.append(book)
        measured.append(codes.reassign(x, history, state, 4))
        state = codes.Bounds.read(memoryview(state.write()), len(x), 4)
        assert (state.own == codes.squared(x, book).argmin(axis=1)).all()
    assert measured[-1] < 0.2 * x.shape[0] * 16


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 3), (64, 64, 64), (70, 33, 129), (100, 64, 257)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(0)
    m, k, n = shape
    for top, kind in ((1 << 28, np.int64), (1 << 60, object)):
        a, b = rng.integers(-top, top, (m, k)).astype(kind), rng.integers(-top, top, (k, n)).astype(kind)
        got = negatives.strassen(a, b, leaf=4)
        assert (got == a.astype(object) @ b.astype(object)).all()


def _mined(rows, scale, dim, k, j, modulus):
    kept = []
    for i, v, y, *_ in rows:
        q = _floored(v, scale, dim)
        if q is not None and y is not None:
            kept.append((i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, [max(-2 ** 63, min(2 ** 63 - 1, x)) for x in q]))
    out = []
    dot = lambda a, b: max(-2 ** 63, min(2 ** 63 - 1, sum(x * y for x, y in zip(a, b, strict=True))))
    order = lambda s: (-s[0], s[1] is None, s[1])
    for at, (i, y, q) in enumerate(kept):
        if i is None or i % modulus:
            continue
        others = [(dot(q, w), n, z) for b, (n, z, w) in enumerate(kept) if b != at]
        for ps, pid, _ in sorted([o for o in others if o[2] == y], key=order)[:k]:
            inside = sorted([o for o in others if o[2] != y and 30 * ps <= 100 * o[0] <= 90 * ps], key=order)[:j]
            out += [(i, pid, rank, nid, ps, ns) for rank, (ns, nid, _) in enumerate(inside, 1)]
    return out


@pytest.mark.parametrize("scale,stretch", [(256, 16), (256, 4096), (1 << 33, 64)])
def test_negatives_match_brute_force(spark, scale, stretch):
    rows, table = _vectors(spark, dim=6, seed=2)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mine_negatives(table, F.col("vec_id") % 5 == 0, label, scale=scale, shard_rows=50, anchor_rows=7, stretch=stretch).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(_mined(rows, scale, 6, 5, 10, 5))
    assert got


def test_negatives_without_rows_or_anchors(spark):
    _, table = _vectors(spark, n=20)
    assert negatives.mine_negatives(table.limit(0), F.lit(True), F.col("label")).collect() == []
    assert negatives.mine_negatives(table, F.lit(False), F.col("label")).collect() == []


def test_heaps_keep_the_best_in_order():
    from hubcast.llm.blocks import Heaps
    rng = np.random.default_rng(7)
    scores = rng.integers(-3, 3, (40, 300))
    scores[3, 10], scores[4] = -2 ** 63, -2 ** 63
    allowed = rng.random(scores.shape) < np.linspace(0, 1, 40)[:, None]
    heaps = Heaps(40, 7)
    for at in range(0, 300, 23):
        heaps.offer(scores[:, at:at + 23], allowed[:, at:at + 23], at)
    got = list(zip(*(x.tolist() for x in heaps.entries()), strict=True))
    want = [(i, j, int(scores[i, j])) for i in range(40) for j in sorted(np.flatnonzero(allowed[i]), key=lambda j: (-int(scores[i, j]), j))[:7]]
    assert got == want


def test_topk_answers_repeated_ids_row_by_row(spark):
    from hubcast.llm.topk import exact_topk
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [2.0, 0.0]), (0, [1.0, 0.0]), (2, [0.25, 9.0])] + [(3, [0.125, 0.0])] * 500
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, exact_topk(table, F.col("vec_id") == 0, k=4, shard_rows=64).collect()))
    assert got == sorted([(0, 1, 1, 131072), (0, 2, 0, 65536), (0, 3, 1, 32768), (0, 4, 2, 16384)] * 2)
