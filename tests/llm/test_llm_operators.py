"""Each operator against a brute-force version on small tables with the defined edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("hubcast.llm")
from hubcast.llm import decontam, katz, langid, line_dedup, packing, pii, sharding, simhash, topk, toxicity  # noqa: E402
from hubcast.llm.common import doc_part  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, component_id long, learn string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()


def _rows():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    common, long = "A shared line of text\tfor all", say(9000)
    rows = [(i, f"{say(40)}\n{common}\n{say(12)}") for i in range(1, 21)]
    rows += [(30, None), (31, ""), (32, " \n\t\n"), (33, long), (34, long + " tail"), (35, "short"), (36, f"  {common.upper()} "),
             (37, f"{common}\n{common}"), (None, common), (38, "éàü ñ ß 日本語 words"), (1, "repeated id\n" + common), (40, "same text"), (41, "same text"),
             (41, "same text")]
    return [(i, t, "en", "s", 0, 7, 7, "x") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _pairs():
    return [(r[0], r[1] or "") for r in _rows()]


def test_line_dedup(docs, none):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = collections.defaultdict(set)
    for doc, text in _pairs():
        if doc is not None:
            for line in text.split("\n"):
                holders[key(line)].add(doc)
    want = []
    for doc, text in _pairs():
        lines = text.split("\n")
        kept = [x for x in lines if doc is None or len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == doc]
        want.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    order = lambda r: (r[0] is None, *map(str, r))
    for hot in (1, 1000):  # no line is hot / the shared one is
        got = [tuple(r) for r in line_dedup.dedup_lines(docs, lines_per_shard=8, hot_lines=hot).collect()]
        assert sorted(got, key=order) == sorted(want, key=order)
    assert line_dedup.dedup_lines(docs, carry=("source",)).columns[-1] == "source"
    assert line_dedup.dedup_lines(none).count() == 0


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2 ** 63, (2, 5000), dtype=np.uint64)
    mph = line_dedup.PerfectHash.build(a, b)
    assert sorted(mph.slots(a, b).tolist()) == list(range(5000))


def _brute_katz(docs, learn):
    uni, bi, ctx = collections.Counter(), collections.Counter(), collections.Counter()
    seqs = [(i, [0, *katz.tokens(t.encode()).tolist()]) for i, t in docs]
    for i, t in seqs:
        if i is not None and learn(i):
            uni.update(t[1:])
            bi.update(zip(t, t[1:], strict=False))
            ctx.update(t[:-1])
    total = sum(uni.values())
    d = [katz.discounts([sum(v == r for v in c.values()) for r in range(1, katz.K + 2)]) for c in (uni, bi)]
    cut = lambda ds, c: c * (ds[c - 1] if c <= katz.K else 1)
    p1 = {w: cut(d[0], c) / (total + 1) for w, c in uni.items()}
    unknown = 1 - sum(p1.values())
    seen = collections.defaultdict(list)
    for (h, w), c in bi.items():
        seen[h].append((w, cut(d[1], c) / (ctx[h] + 1)))
    back = {h: (1 - sum(p for _, p in x)) / (1 - sum(p1[w] for w, _ in x)) for h, x in seen.items()}
    for h, x in seen.items():  # exactly normalised over the known words and the unknown class
        rest = sum(p for w, p in p1.items() if w not in dict(x)) + unknown
        assert math.isclose(sum(p for _, p in x) + back[h] * rest, 1, abs_tol=1e-9)
    out = []
    for i, t in seqs:
        s = sum(math.log10(cut(d[1], bi[h, w]) / (ctx[h] + 1)) if (h, w) in bi else math.log10(back.get(h, 1) * p1.get(w, unknown))
                for h, w in zip(t, t[1:], strict=False))
        base = sum(math.log10((uni[w] + 1) / (total + len(uni) + 1)) for w in t[1:])
        out.append((i, len(t) - 1, sum(w in uni for w in t[1:]), base, s))
    return out


@pytest.mark.parametrize("shard_tokens", [1 << 20, 400])
def test_katz(docs, none, shard_tokens):
    model = katz.katz(docs, doc_part(7) != 2, shard_tokens=shard_tokens)
    order = lambda r: (r[0] is None, r[0], r[1], r[3], r[4])
    got = sorted((tuple(r) for r in model.scores.collect()), key=order)
    want = sorted(_brute_katz(_pairs(), lambda i: zlib.crc32(str(i).encode()) % 7 != 2), key=order)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want], rtol=1e-9)
    assert shard_tokens > 1000 or model.constants["hot"]
    assert katz.katz(none, doc_part(7) != 2).scores.count() == 0


def test_katz_without_training(docs):
    model = katz.katz(docs, F.lit(False))
    assert {r["score"] for r in model.scores.collect()} == {0.0} and model.constants["words"] == 0


def test_toxicity(spark, docs, none):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(60)) + (" nasty insult" if i % 3 == 0 else "")) for i in range(400)]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(400)] + [(None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    learn = doc_part(4) != 2
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(many, labels, learn).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.3) == (i % 3 == 0) for i in held]) > 0.95
    scores = toxicity.score_toxicity(docs, labels, learn).collect()
    assert len(scores) == len(_rows()) and all(0 <= r["score"] <= 1 for r in scores)
    assert toxicity.score_toxicity(none, labels, learn).count() == 0
    assert max(r["score"] for r in toxicity.score_toxicity(docs, labels.limit(0), learn).collect()) < 1e-6


def test_toxicity_learns_from_one_row_of_an_id(spark, monkeypatch):
    rows = [(1, f"copy {i} of one id") for i in range(300)] + [(i, f"text of {i}") for i in range(2, 40)] + [(2, None)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda found, marks: seen.append((len(found), int(marks.sum()))))
    many = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    toxicity.train(many, labels, F.lit(True))
    toxicity.train(many, labels, F.lit(True), docs_per_class=5)
    assert seen == [(39, 20), (10, 5)]


def _luhn(d):
    return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def _base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    formats = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
               ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
               ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and _luhn(digits(m))),
               ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15)]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in formats for m in re.finditer(p, t) if ok(m.group()))


def test_pii_base_spans(spark, docs, none):
    rng = random.Random(9)
    bits = ["4111 1111 1111 1111", "4111111111111112", "1.2.3.4.5.6.7.8", "300.1.1.1", "010.0.0.1", "a@b.c%x@y.z", "a.b@c", "@x.y", "+1 (414) 555-7134",
            "+12", "12-34-56", "é日𝒳", "x", "\n", " ", "+", "..", "1", "-", "user.name+tag@mail.example.com", "4242-4242-4242-4242 1"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(["", " ", ","]) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    rows += [(301, "7" * 20000), (302, "a" * 20000), (303, "1 " * 10000), (304, "1.2.3.4 " * 500), (305, None)]
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.spelled(F.col("base")).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in got} == {i: _base_spans(t or "") for i, t in rows}
    assert pii.find_personal_data(docs).count() == len(_rows()) and pii.find_personal_data(none).count() == 0


def test_pii_patterns_discover_unseen(spark):
    rows = [(i, f"please contact phone: +1 (414) 555-{1000 + i} today, it is fine") for i in range(30)]
    rows += [(100, "please contact phone: 0414/555-9999-77 today"), (101, "the number 0414/555-9999-77 alone"), (102, "version 12345678 of it")]
    got = {r["doc_id"]: r["added"] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(x["k"], x["s"], x["e"]) for x in got[100]] == [(3, 22, 38)] and not got[101] and not got[102]


@pytest.mark.parametrize("short_list", [0, 500_000])
def test_pii_patterns_are_scored_over_all_documents(spark, monkeypatch, short_list):
    monkeypatch.setattr(pii, "_SHORT_LIST", short_list)
    rows = [(i, f"we saw u{i}@example.org there") for i in range(20)] + [(100, "we saw item-12345x there")]
    added = lambda r: {x["doc_id"]: x["added"] for x in pii.find_personal_data(spark.createDataFrame(r, "doc_id long, text string")).collect()}[100]
    assert [(x["k"], x["s"], x["e"]) for x in added(rows)] == [(0, 7, 18)]
    assert added(rows + [(200 + i, "we saw the house") for i in range(100)]) == []


def test_pii_grouped_instances(spark):
    phones = [f"please call phone: +1 (414) 555-{1000 + i} today" for i in range(10)]
    cards = ["4111 1111 1111 1111", "4242-4242-4242-4242", "5555 5555 5555 4444", "4012 8888 8888 1881", "4000 0566 5566 5556"]
    new = {100: ("phone: ", "(414) 555-7134", " today", 3), 101: ("phone: ", "414 555 7134", ".", 3), 102: ("my card ", "4111 1111 1111", ", it is", 2),
           103: ("phone: ", "414-555-66-x9", " or", 3), 104: ("phone: ", "4145557134", " 4145557135x", 3)}
    rows = list(enumerate(phones + [f"my card {c}, it is" for c in cards])) + [(i, a + v + z) for i, (a, v, z, _) in new.items()]
    rows += [(105, "1.2.3.4 414 555 7134 x"), (106, "a 12 34 b"), (107, "22 " * 5000 + "22-x")]
    got = {r["doc_id"]: [(x["k"], x["s"], x["e"]) for x in r["added"]] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i] for i in new} == {i: [(k, len(a), len(a + v))] for i, (a, v, _, k) in new.items()}
    assert not got[105] and not got[106] and not got[107]


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _classes(fps, ids, bits):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(fps))]


def test_simhash_fingerprints_and_classes(docs, none):
    got = sorted(((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs).collect()))
    pairs = _pairs()
    fps = [_fingerprint(t) for _, t in pairs]
    want = sorted((i or -1, f"{f:016x}", c) for (i, _), f, c in zip(pairs, fps, _classes(fps, [i for i, _ in pairs], 3), strict=True))
    assert got == want
    assert simhash.simhash_components(none).count() == 0


@pytest.mark.parametrize("max_bits", [1, 2, 3])
@pytest.mark.parametrize("max_bucket", [1, 1000])
def test_simhash_links_of_crowded_keys(spark, max_bits, max_bucket):
    rng = random.Random(max_bits)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(12):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash._links(nodes, max_bits, max_bucket)
    assert all(bin((r["u"] ^ r["v"]) & (2 ** 64 - 1)).count("1") <= max_bits for r in links.collect())
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    got = collections.defaultdict(set)
    for f in signed:
        got[roots.get(f, f)].add(f)
    want = collections.defaultdict(set)
    for f, c in zip(signed, _classes(fps, list(range(len(fps))), max_bits), strict=True):
        want[c].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_tokenizer_equals_whole_text_encoding():
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(packing.default_tokenizer())
    plain.encode_special_tokens = True
    texts = [r[1] or "" for r in _rows()] + ["a  b", " a", "a ", "x \ny", "x\n y", "tab\tx", "a.,b", "don't 12.5%\nNew", "\n", "a b c", "éa, b.", "<|endoftext|> a", "ª. ²,"]
    texts += [f"a{chr(c)}1{chr(c)} {chr(c)}!{chr(c)} {chr(c)} b" for c in range(0, 0x20000, 7) if not 0xD800 <= c < 0xE000]
    texts += [" " * 1_100_000 + "b", "a" * 200_000, "\n" * 60_000]
    assert packing.rank_form(packing.default_tokenizer())
    tok = packing.RankTokenizer(packing.default_tokenizer())
    assert [np.frombuffer(tok.ids(t), "<u4").tolist() for t in texts] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_vocabularies_without_a_rank_form_go_through_their_library():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.rank_form(path) is None
    plain = Tokenizer.from_file(path)
    assert np.frombuffer(packing.RankTokenizer(path).ids("Some words, twice"), "<u4").tolist() == plain.encode("Some words, twice", add_special_tokens=False).ids


def test_packing_recognises_added_tokens(spark):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>y <|endoftext", "none of it", "\n" * 60_000 + "<|endoftext|>"]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), capacity=1 << 17, keep_ids=True).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in rows} == {i: [*plain.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}


def test_packing(docs, none):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack_documents(docs, capacity=64, keep_ids=True).collect()
    held, by_doc = collections.defaultdict(list), collections.Counter()
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 64 and zlib.crc32(r["ids"]) == r["ids_crc32"] and (r["piece"] == 0) == (r["start"] == 0)
        held[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]] += r["length"]
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    want = collections.Counter()
    for doc, text in _pairs():
        want[doc] += len(tok.encode(text, add_special_tokens=False).ids) + 1
    assert by_doc == want
    assert len(held) <= 1.1 * -(-sum(want.values()) // 64) + 1
    assert packing.pack_documents(none).count() == 0


def test_plan_places_every_count_once():
    counts = {1: 40, 3: 5, 5: 7, 6: 1, 10: 2}
    plan = packing.plan_best_fit(counts, 10)
    for length, n in counts.items():
        assert sorted(r for size, lo, hi, _, _ in plan if size == length for r in range(lo, hi)) == list(range(n))


def test_sharding(spark, docs, none):
    rows = [(i, "copy of one text") for i in range(900)] + [(i, "x" * (i % 97)) for i in range(900, 1800)] + [(None, None), (3, "")]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), shards=7).collect()
    assert len(got) == len(rows)
    slots, size = collections.defaultdict(list), collections.Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(7))
    assert max(size.values()) - min(size.values()) <= 2 * max(r["size"] for r in got)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sharding.shard_by_bytes(docs).count() == len(_rows()) and sharding.shard_by_bytes(none).count() == 0


def test_topk(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(230)]
    rows += [(i, [0.5] * 6) for i in range(230, 300)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")]), (None, [1.0]), (304, []), (305, [1.0]), (2, rows[2][1])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    used = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and i not in (300, 301, 302, 303)]
    want = []
    for at, (q, w) in enumerate(used):      # row by row: a row that repeats an id is a candidate of all others
        if q % 50 == 0:
            near = sorted((-sum(a * b for a, b in zip(w, v, strict=False)), i) for n, (i, v) in enumerate(used) if n != at)[:5]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(near, 1)]
    got = topk.exact_topk(table, F.col("vec_id") % 50 == 0, shard_rows=64, query_rows=3)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.exact_topk(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_large_components(spark):
    table = spark.createDataFrame([(0, [1e15, 1.0]), (1, [1e15, 2.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.exact_topk(table, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 2 ** 63 - 1), (2, -2 ** 63)]


def test_decontamination(spark, docs, none):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(n))) for i, n in enumerate([3, 5, 6, 12, 30, 80, 200])]
    fill = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = []
    for i, (_, text) in enumerate(items):
        w = text.split()
        rows += [(10 * i, f"{fill(3000)} {text.upper()}\n{fill(2000)}"), (10 * i + 1, fill(50) + " " + " ".join(w[:len(w) // 2]) + " " + fill(20)),
                 (10 * i + 2, fill(9) + " " + " ".join(w[: max(1, len(w) * 9 // 10)]))]
    rows += [(900, None), (901, ""), (902, items[0][1])]
    items += [(50, None), (51, ""), (52, "  \n")]

    def grams(t, k):
        w = t.lower().split()
        return {" ".join(w[i:i + k]) for i in range(len(w) - k + 1)}
    want = set()
    for item, text in items:
        k = min(5, len((text or "").split()))
        if k:
            g = grams(text, k)
            want |= {(d, item, len(g), len(g & grams(t or "", k))) for d, t in rows if len(g & grams(t or "", k)) >= 0.8 * len(g)}
    table, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    for size in (1 << 24, 300):  # one pass, several passes
        got = {tuple(r)[:4] for r in decontam.contaminated(table, bench, pass_bytes=size).collect()}
        assert got == want and len(want) >= 7
    assert decontam.contaminated(none, bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_language(spark, none):
    rng = random.Random(3)
    stems = {"en": "the and ing tion her with".split(), "fr": "eau çon elle ment aux ré".split(), "de": "sch ung ein über cht ß".split()}
    rows = [(i, " ".join("".join(rng.choice(stems[lang]) for _ in range(2)) for _ in range(rng.randint(5, 400))), lang, "s", 0, 1, 1, "x")
            for i, lang in enumerate(["en", "fr", "de"] * 60)]
    odd = [(500, None), (501, ""), (502, "12 34 | -"), (None, rows[0][1])]
    table = spark.createDataFrame(rows + [(i, t, None, "s", 0, 1, 1, "x") for i, t in odd], SCHEMA)
    got = {r["doc_id"]: r for r in langid.identify(table, doc_part(4) != 2).collect()}
    held = [(i, lang) for i, _, lang, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.95
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (500, 501, 502)] == [("und", 0.0)] * 3 and got[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(none, doc_part(4) != 2).count() == 0
    assert {r["lang_pred"] for r in langid.identify(table, F.lit(False)).collect()} == {"und"}


# ------------------------------------------------------------ whole methods against plain Python

_GLUE, _WHITE = "\"'([=:", " \t\n\x0b\x0c\r"


def _words(text):
    """Words as the contexts have them: a word ends at white space or behind marks that something follows."""
    out, word = [], ""
    for i, c in enumerate(text):
        if c in _WHITE:
            out.append(word)
            word = ""
            continue
        if word and word[-1] in _GLUE and c not in _GLUE:
            out.append(word)
            word = ""
        word += c
    return [re.sub("[0-9]", "0", w.lower()) for w in [*out, word] if w]


def _contexts(gap):
    if gap and gap[-1] not in _GLUE + _WHITE:
        return []
    w = _words(gap)[-2:]
    return w[-1:] + [" ".join(w)] * (len(w) == 2)


def _with_gaps(text, matches):
    at = 0
    for m in matches:
        yield m.start(), m.end(), m.group(), text[at:m.start()]
        at = m.end()


def _bootstrapped(rows, rounds=3, min_support=5, least=0.5):
    """Added spans (kind, start, end) of every row, by the method's definition, for texts without grouped runs."""
    kinds = ["email", "phone"]
    formats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
    single = re.compile(r"""(?:(?<=[ "'(\[=:])|^)(?=[^ ]*[0-9@])[^ "'()\[\]=:,;]{5,}[^ "'()\[\]=:,;.!?]""")
    met, seen = [], collections.Counter()
    for n, text in enumerate(rows):
        w = _words(text)
        seen.update(w)
        seen.update(" ".join(p) for p in zip(w, w[1:], strict=False))
        base = [(s, e, v, g, kinds.index(k)) for k in kinds for s, e, v, g in _with_gaps(text, re.finditer(formats[k], text))
                if k == "email" or 8 <= len(re.sub("[^0-9]", "", v)) <= 15]
        other = [(s, e, v, g, -1) for s, e, v, g in _with_gaps(text, single.finditer(text)) if not any(a < e and s < b for a, b, *_ in base)]
        met += [(n, s, e, v.lower(), p, k) for s, e, v, g, k in base + other for p in _contexts(g)]
    support = collections.defaultdict(set)
    for _, _, _, v, p, k in met:
        if k >= 0:
            support[p].add(v)
    edges = collections.Counter((p, v) for _, _, _, v, p, _ in met if len(support[p]) >= min_support)
    seed = collections.defaultdict(lambda: [0.0] * len(kinds))
    for _, _, _, v, p, k in met:
        if k >= 0 and len(support[p]) >= min_support:
            seed[v][k] = 1.0
    score = {v: list(seed[v]) for _, v in edges}
    for _ in range(rounds):
        pattern = {}
        for q in {p for p, _ in edges}:
            mine = [(v, n) for (p, v), n in edges.items() if p == q]
            whole = max(sum(n for _, n in mine), seen[q]) + 1
            pattern[q] = [sum(n * score[v][k] for v, n in mine) / whole for k in range(len(kinds))]
        score = {v: list(seed[v]) if max(seed[v]) > 0 else [1 - math.prod(1 - pattern[p][k] for p, u in edges if u == v) for k in range(len(kinds))]
                 for _, v in edges}
    out = [set() for _ in rows]
    for n, s, e, v, p, k in met:
        if k < 0 and (p, v) in edges:
            best = max((pattern[p][j], score[v][j], j) for j in range(len(kinds)))
            if best[0] >= least and best[1] >= least:
                out[n].add((best[2], s, e))
    return out


def test_pii_added_spans_equal_plain_bootstrapping(spark):
    rng = random.Random(12)
    new = lambda: f"{rng.choice(['ref', 'item', 'call'])}-{rng.randrange(100, 999)}x{rng.randrange(9)}"
    places = ["tel:", "id=", "mail: ", 'name="', "see (", "the ", "write to ", "w" * 150 + " ", "ring us at ", "x"]
    rows = []
    for i in range(260):
        place = rng.choice(places)
        what = rng.choice([f"+1414555{rng.randrange(1000, 1060)}"] * 3 + [f"u{rng.randrange(40)}@example.org"] * 2 + [new(), "hello", "house"])
        rows.append(f"{rng.choice(['we', 'a b', ''])} {place}{what} {rng.choice(['and', 'or the', 'id=hello', 'tel:none'])} {rng.choice(places)}{new()} end")
    got = pii.find_personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    found = {r["doc_id"]: {({0: 0, 3: 1}[x["k"]], x["s"], x["e"]) for x in r["added"]} for r in got}
    want = _bootstrapped(rows)
    assert [found[i] for i in range(len(rows))] == want and sum(map(len, want)) > 20


@pytest.mark.parametrize("before,plain,falsely", [("id=", "id=hello", "id=BUILD-77123x"), ("tel:", "tel:none", "tel:BUILD-77123x"),
                                                  ('say "', 'say "hello"', 'say "BUILD-77123x"'), ("w" * 150 + " ", "w" * 150 + " on", "w" * 150 + " BUILD-77123x")])
def test_pii_glued_and_long_contexts_are_counted(spark, before, plain, falsely):
    seeds = [(i, f"a {before}+1414555{1000 + i} b") for i in range(10)]
    common = [(100 + i, f"a {plain} b") for i in range(300)]
    added = lambda rows: {r["doc_id"]: r["added"] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}[99]
    assert len(added([*seeds, (99, f"a {falsely} b")])) == 1      # the pattern tells, as long as nothing else follows it
    assert added([*seeds, (99, f"a {falsely} b"), *common]) == []


def test_pii_many_matches_in_one_text(spark):
    import time
    took = {}
    for n in (50, 2000, 8000):
        text = " ".join(f"1.2.3.{i % 256}" for i in range(n))
        start = time.time()
        spans = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["base"]
        took[n] = time.time() - start
        assert len(spans) == n and all(text[x["s"]:x["e"]] == x["value"] for x in spans[:: max(1, n // 50)])
    assert took[8000] < 2 * 4 * max(took[2000], 1.0)


def test_toxicity_ratios_and_fit_equal_plain_sums():
    rng = random.Random(3)
    texts = [("bad awful " if i % 3 == 0 else "fine ") + " ".join(rng.choice(WORDS) for _ in range(8)) for i in range(60)]
    labels = np.array([float(i % 3 == 0) for i in range(60)])
    mark = np.zeros(1 << toxicity.BITS, np.int32)
    rows = [toxicity.features(t.encode(), mark) for t in texts]

    def by_hand(text):
        b, out = text.encode().lower(), set()
        for n in toxicity.ORDERS:
            for i in range(len(b) - n + 1):
                code = (int.from_bytes(b[i:i + n], "big") + (n << 56)) & (1 << 64) - 1
                out.add((code * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - toxicity.BITS))
        return out
    assert all(set(r.tolist()) == by_hand(t) and len(set(r.tolist())) == len(r) for r, t in zip(rows, texts, strict=True))
    model = toxicity.fit(rows, labels, epochs=1, batch=60, rate=0.05, decay=0.0)
    # one step over all rows, in plain sums: ratio of smoothed counts, gradient of the logistic loss, AdaGrad step
    size = 1 << toxicity.BITS
    counts = [collections.Counter(f for r, y in zip(rows, labels, strict=True) if y == c for f in r.tolist()) for c in (0, 1)]
    totals = [size + sum(c.values()) for c in counts]
    ratio = {f: math.log((counts[1][f] + 1) / totals[1]) - math.log((counts[0][f] + 1) / totals[0]) for c in counts for f in c}
    share = labels.mean()
    err = [(share - y) / 60 for y in labels]
    for f in list(ratio)[::50]:
        g = ratio[f] * sum(e for e, r in zip(err, rows, strict=True) if f in r)
        assert abs(model.weights[f] - ratio[f] * -0.05 * g / math.sqrt(1e-6 + g * g)) < 1e-6
    assert abs(model.intercept - (math.log(share / (1 - share)) - 0.05 * sum(err) / math.sqrt(1e-6 + sum(err) ** 2))) < 1e-9


def test_language_letters_are_unicode_letters(spark):
    rows = [(i, f"the cat sat on mat number {i}", "en") for i in range(40)] + [(100 + i, f"die katze sass auf der matte {i}", "de") for i in range(40)]
    odd = [(900, "½ ²"), (901, "①② Ⅳ"), (902, "٣ 12_"), (903, "\u0301\u0903"), (904, "ª"), (905, "日"), (906, "ǅ 1"), (907, None), (908, "")]
    table = spark.createDataFrame([*rows, *[(i, t, None) for i, t in odd]], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(table, F.col("doc_id") < 900).collect()}
    assert {i for i in got if got[i] == "und"} == {900, 901, 902, 903, 907, 908}


def test_language_of_a_very_long_text_and_ties(spark):
    rows = [(i, f"the cat sat on the mat and {i} " * 20, "en") for i in range(40)] + [(100 + i, f"die katze sass auf der matte {i} " * 20, "de") for i in range(40)]
    long = "the cat sat on the mat and " * 40_000
    table = spark.createDataFrame([*rows, (900, long, None), (901, long, None)], "doc_id long, text string, lang string")
    got = [tuple(r)[1:] for r in langid.identify(table, F.col("doc_id") < 900).where("doc_id >= 900").collect()]
    assert got[0] == got[1] and got[0][0] == "en"
    flat = langid.ByteConvNet(["de", "en"])
    flat.out[:], flat.bias[:] = 0, 0
    assert flat.langs[int(flat.probabilities(langid.windows(b"abc"))[0].argmax())] == "de"     # equal scores: the first


def test_sharding_spreads_equal_rows(spark, monkeypatch):
    rows = [(7, "one and the same text")] * 40_000 + [(i, f"text {i}") for i in range(20_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    gathered = []
    real = sharding.Bucketizer
    monkeypatch.setattr(sharding, "Bucketizer", lambda **kw: gathered.append(len(kw["splits"])) or real(**kw))
    got = sharding.shard_by_bytes(table, shards=8, sample_keys=2000).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == 60_000 and sizes.max() - sizes.min() <= 2 * got["size"].max() and gathered[0] <= 2 * 2000
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    # the definition: records laid on a line in any order; a record's shard is the one its first byte falls in
    total, want = got["size"].sum(), collections.Counter(got["shard"])
    assert set(want) == set(range(8)) and all(abs(b - total / 8) <= 2 * got["size"].max() for b in sizes)
    one = got[got["doc_id"] == 7].groupby("shard").size()
    assert len(one) > 1      # copies of one text lie next to each other, over as many shards as they fill


@pytest.mark.parametrize("cell_rows", [1 << 18, 7])
def test_packing_takes_as_few_sequences_as_best_fit_by_documents(spark, cell_rows):
    rng = random.Random(21)
    rows = [(i, " ".join(["word"] * rng.choice([3, 20, 21, 60, 130, 300]))) for i in range(400)] + [(5, "word " * 20)] * 300
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), capacity=256, cell_rows=cell_rows).collect()
    rooms = []                                   # best fit, longest first, document by document
    for n in sorted((r["length"] for r in got), reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(256 - n)
    assert len({r["sequence_id"] for r in got}) == len(rooms)
    used = collections.defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256


@pytest.mark.parametrize("pass_bytes", [1 << 24, 100])
def test_decontamination_with_repeated_items_and_null_ids(spark, pass_bytes):
    say = lambda n: " ".join(f"{c}{n}" for c in "abcdefgh")
    bench = spark.createDataFrame([(1, say(1)), (1, say(1)), (1, say(2)), (2, say(1)), (None, say(3)), (None, say(3))], "item_id long, text string")
    docs = spark.createDataFrame([(7, f"x {say(1)} y"), (None, f"{say(2)}\n{say(3)}"), (8, "nothing"), (7, say(2))], "doc_id long, text string")
    got = [tuple(r)[:2] for r in decontam.contaminated(docs, bench, pass_bytes=pass_bytes).collect()]
    want = [(7, 1), (7, 1), (7, 2), (None, 1), (None, None), (None, None), (7, 1)]
    key = lambda p: tuple(-1 if v is None else v for v in p)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_decontamination_sketches_find_what_is_contained():
    rng = random.Random(31)
    word = lambda: f"w{rng.randrange(5000)}"
    items = [(n, " ".join(word() for _ in range(size + 4)).encode()) for n, size in enumerate([1, 2, 3, 5, 8, 13, 30, 64, 150, 600, 1500, 3000] * 8)]
    index = decontam.ContainmentIndex(items, 5, 3, 64, 512)
    assert max(len(v) for k in index.classes.values() for c in k.values() for v in [[s for s, ids in c.slots.items() if ids == [95]]]) <= 3 * 512
    missed = 0
    for n, text in items:
        w = text.decode().split()
        cut = len(w) - (len(w) - 4) // 6            # the end is lost: over 0.8 of the shingles stay
        doc = " ".join([*(word() for _ in range(400)), *w[:cut], *(word() for _ in range(400))])
        parts = set(decontam.shingles(text, 5))
        if len(parts & set(decontam.shingles(doc.encode(), 5))) >= 0.8 * len(parts):
            missed += n not in {i for i, _, _ in index.search(doc.encode(), 0.8)}
    assert missed == 0


def test_language_sample_is_the_first_by_hash_and_equal_rows_count_once(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(6)), "en") for i in range(3000)] + [(9000, "ein Satz der sich oft wiederholt", "de")] * 2000
    rows += [(9001 + i, f"noch ein Satz {i}", "de") for i in range(40)] + [(None, "ohne Nummer", "de"), (1, None, "de"), (2, "no language", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    seen = []
    monkeypatch.setattr(langid.ByteConvNet, "fit", lambda net, x, y: seen.append((net.langs, np.bincount(y).tolist(), x)) or net)
    langid.train(table, docs_per_lang=100, windows_per_doc=1)
    first = table.where("lang = 'en'").orderBy(F.xxhash64("doc_id", "text")).limit(100).collect()
    want = [langid.windows(r["text"].encode())[0] for r in sorted(first, key=lambda r: r["doc_id"])]
    (langs, counts, x), = seen
    assert langs == ["de", "en"] and counts == [42, 100]
    assert np.array_equal(x[42:], np.array(want))
    assert langid.train(table.where("false")) is None
