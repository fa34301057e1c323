"""Katz models in stored tables against plain counting and recursion, for texts trained on and new ones."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("hubcast.llm")
from hubcast.llm import katz, katz_tables  # noqa: E402
from hubcast.llm.common import doc_part  # noqa: E402

SCHEMA = "doc_id long, text string, row string, w1 int, p double, c long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def _rows():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(WORDS[:1 + rng.randrange(10)]) for _ in range(n))
    rows = [(i, say(rng.randrange(60))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, say(70000)), (None, "alpha beta unnamed"), (7, "a repeated id"), (104, "Twice THE same"),
             (104, "Twice THE same"), (105, "é ß 日本 unseen words here"), (106, "alpha " * 50)]
    return [(i, t, "x", 1, 0.5, 9) for i, t in rows]


def _learns(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 != 2


def _words(text):
    return [w.lower() for w in (text or "").encode().split()] + [b"</s>"]


class _Plain:
    """Counts by Counter, probabilities by recursion."""

    def __init__(self, rows, order):
        self.order = order
        self.c = [collections.Counter() for _ in range(order + 1)]
        for i, text, *_ in rows:
            if _learns(i):
                seq = [b"<s>"] * (order - 1) + _words(text)
                for at in range(order - 1, len(seq)):
                    for k in range(1, order + 1):
                        self.c[k][tuple(seq[at - k + 1:at + 1])] += 1
        self.d = [None] + [katz.discounts([sum(v == r for v in c.values()) for r in range(1, katz.K + 2)]) for c in self.c[1:]]
        self.after = [collections.defaultdict(list) for _ in range(order + 1)]
        for k in range(1, order + 1):
            for g in self.c[k]:
                self.after[k][g[:-1]].append(g[-1])
        self.total = sum(self.c[1].values())
        self.weights = {}

    def cut(self, g):
        c = self.c[len(g)][g]
        return c * (self.d[len(g)][c - 1] if c <= katz.K else 1)

    def p(self, g):
        k, h = len(g), g[:-1]
        if k == 1:
            if self.c[1][g]:
                return self.cut(g) / (self.total + 1)
            return 1 - sum(self.cut(x) for x in self.c[1]) / (self.total + 1)
        if self.c[k][g]:
            return self.cut(g) / (sum(self.c[k][(*h, w)] for w in self.after[k][h]) + 1)
        return self.weight(h) * self.p(g[1:])

    def weight(self, h):
        k = len(h) + 1
        if h not in self.weights:
            seen = self.after[k].get(h)
            self.weights[h] = 1.0 if not seen else (
                (1 - sum(self.p((*h, w)) for w in seen)) / (1 - sum(self.p((*h[1:], w)) for w in seen)))
        return self.weights[h]

    def score(self, text):
        words = _words(text)
        seq = [b"<s>"] * (self.order - 1) + words
        counts = [self.c[1][(w,)] for w in words]
        grams = collections.Counter(tuple(seq[at:at + self.order]) for at in range(len(words)))
        base = sum(math.log10((c + 1) / (self.total + len(self.c[1]) + 1)) for c in counts)
        return len(words), sum(c > 0 for c in counts), base, sum(n * math.log10(self.p(g)) for g, n in grams.items())


def _order(r):
    return r[0] is None, *(round(float(x or 0), 6) for x in r)


def _same(got, want):
    got, want = sorted(map(tuple, got), key=_order), sorted(want, key=_order)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want], rtol=1e-9)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_plain_recursion(spark, docs, order):
    model = katz_tables.train(docs, doc_part(7) != 2, order)
    plain = _Plain(_rows(), order)
    _same(katz_tables.score(model, docs).collect(), [(r[0], *plain.score(r[1])) for r in _rows()])
    new = [(1, "alpha gamma never_seen kappa alpha"), (2, None), (2, "beta beta beta"), (None, "quite other words")]
    again = katz_tables.BackoffModel(spark, model.folder)
    _same(katz_tables.score(again, spark.createDataFrame(new, "doc_id long, text string")).collect(), [(i, *plain.score(t)) for i, t in new])


def test_order_two_is_the_packed_model(docs):
    learn = doc_part(7) != 2
    _same(katz_tables.score(katz_tables.train(docs, learn, 2), docs).collect(), [tuple(r) for r in katz.katz(docs, learn).scores.collect()])


def test_probabilities_after_a_context_sum_to_one(spark, docs):
    model = katz_tables.train(docs, doc_part(7) != 2, 3)
    words = [r["w1"] for r in model.grams(1).collect()]
    for history in [("alpha", "beta"), ("kappa", "never"), ("never", "alpha")]:
        at = [int(katz.tokens(w.encode()).view(np.int64)[0]) for w in history]
        asked = spark.createDataFrame([(*at, w) for w in [*words, 12345]], "w1 long, w2 long, w3 long")
        assert abs(sum(10 ** r["lp"] for r in katz_tables._resolve(model, asked, 3).collect()) - 1) < 1e-9


def test_without_rows(spark, docs):
    none = docs.limit(0)
    assert katz_tables.score(katz_tables.train(docs, F.lit(True), 2), none).count() == 0
    empty = katz_tables.train(none, F.lit(True), 3)
    assert {r["score"] for r in katz_tables.score(empty, docs).collect()} == {0.0} and empty.words == 0
    assert katz_tables.train(docs, F.lit(None).cast("boolean"), 2).tokens == 0
    with pytest.raises(ValueError):
        katz_tables.train(docs, F.lit(True), 0)
