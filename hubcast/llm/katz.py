"""Katz backoff language model over words: counting, normalising and scoring.

Model (bigrams backing off to unigrams, unigrams to one class of unknown words)::

    P(w | h) = d2(c(h w)) c(h w) / (c(h) + 1)     if c(h w) > 0
             = a(h) P(w)                          otherwise   (a = 1 for unseen h)
    P(w)     = d1(c(w)) c(w) / (N + 1)            if c(w) > 0, the rest of the mass otherwise

d are Good-Turing discounts for counts up to ``K`` (Katz's formula; where counts
of counts do not allow it, fewer counts are discounted).  The one added to the
denominators keeps some mass for backing off even where no count is discounted.
a(h) is exact: (1 - sum of P(. | h) over seen words) / (1 - sum of P(.) over
the same words), so P(. | h) sums to one over the known words and the class.

How it runs on Spark.  Documents are read once; per block (an Arrow batch) their
bigrams are sorted and packed per *word shard* (range of the second word's
hash).  A shard counts its bigrams and words and, with the counts in hand, each
document's share of the score: sums and histograms of small counts, since the
discounts are not known before all shards have counted.  Contexts get theirs in
a second exchange by *context shard*: sums per context (for a(h)) and the
unseen bigrams asking for it.  Blocks then add up what the shards say.  Tables
(``words``, ``bigrams``, ``contexts``) are written partitioned by kind.

A word holding over twice a shard's share of all tokens is counted beforehand
and its bigrams are spread by both words, so it cannot crowd a shard.

Words are 64-bit hashes of their bytes.  Defined cases: null and empty texts
are the end token alone; repeated rows count and are scored each; rows with a
null doc_id are scored but not learned from; with no training text every token is
unknown with probability one; a very long text is read whole, as part of its
block; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, from_planes, from_rising, groups, mix, pieces, planes, record, release_memory, rising, shard_of, stage, utf8

K = 5
START, END = 0, 1
BLOCK_TOKENS = 1 << 20
HELD_BYTES = 32 << 20
_ROWS = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("block", pa.int64()), ("parts", pa.list_(pa.binary())), ("stats", pa.list_(pa.int64()))])
ROWS = "kind string, shard int, block long, parts array<binary>, stats array<long>"
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
#: stats: N, V, count of END, n_1..n_{K+1} of words, n_1..n_{K+1} of bigrams
N_STATS = 3 + 2 * (K + 1)


def tokens(text: bytes) -> np.ndarray:
    """Hashes of a text's words, then END."""
    xxh = xxhash.xxh64_intdigest
    words = text.lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxh, words), np.uint64, len(words))
    out[-1] = END
    return out


def discounts(n: list[int]) -> list[float]:
    """d_1..d_K from the counts of counts n_1..n_{K+1} (index 0 is n_1)."""
    for k in range(K, 0, -1):
        if all(n[:k + 1]) and (a := (k + 1) * n[k] / n[0]) < 1:
            d = [((r + 1) * n[r] / (r * n[r - 1]) - a) / (1 - a) for r in range(1, k + 1)]
            if all(0 < x <= 1 for x in d):
                return d + [1.0] * (K - k)
    return [1.0] * K


def _row(kind, shard, block, parts, stats=None) -> tuple:
    return kind, int(shard), int(block), parts, stats


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return record(_ROWS, **dict(zip(_ROWS.names, zip(*rows, strict=True), strict=True)))


def _ends(starts: np.ndarray, n: int) -> np.ndarray:
    return np.r_[starts, n]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys (sorted arrays)."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _blocks(shards: int, hot: np.ndarray):
    """Bigrams of every block, packed per word shard: words, bigrams per word, contexts, documents per bigram."""
    def pack(block, docs, learn, seqs):
        sizes = np.array([len(s) for s in seqs])
        cur = np.concatenate(seqs)
        prev = np.empty_like(cur)
        prev[1:] = cur[:-1]
        prev[np.r_[0, np.cumsum(sizes)[:-1]]] = START
        doc = np.repeat(np.arange(len(seqs), dtype=np.uint32), sizes)
        order = np.lexsort((prev, cur))
        cur = cur[order]
        prev = prev[order]
        doc = doc[order]
        del order
        start = _runs(cur, prev)
        per = np.diff(_ends(start, len(cur))).astype(np.uint32)
        c, p = cur[start], prev[start]
        flags = np.array(learn, np.uint8)
        valid = np.array([d is not None for d in docs], np.uint8)
        yield _row("block", block % shards, block, [planes(np.array([d or 0 for d in docs], np.int64)), valid.tobytes(), planes(sizes.astype(np.uint32))])

        def part(shard, pick):
            q = _runs(c[pick])
            words = c[pick][q]
            at = np.repeat(start[pick], per[pick]) + _within(per[pick])
            contexts, which = np.unique(p[pick], return_inverse=True)
            return _row("pairs", shard, block, [rising(words), planes(np.diff(_ends(q, len(pick))).astype(np.uint32)), rising(contexts),
                                                planes(which.astype(np.uint32)), planes(per[pick]), planes(doc[at]), flags.tobytes()])
        spread = np.isin(c, hot) if len(hot) else np.zeros(len(c), bool)
        shard = shard_of(np.where(spread, mix(c ^ mix(p, 5), 9), c), shards)
        by = np.argsort(shard, kind="stable")
        cuts = _runs(shard[by])
        for lo, hi in zip(cuts, _ends(cuts, len(by))[1:], strict=True):
            yield part(shard[by[lo]], by[lo:hi])

    def run(batches):
        at, number = TaskContext.get().partitionId() << 24, 0
        docs, learn, seqs, held = [], [], [], 0
        for batch in pieces(batches, 500):
            for doc, text, flag in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                docs.append(doc)
                learn.append(bool(flag))
                seqs.append(tokens(text))
                held += len(seqs[-1])
                if held >= BLOCK_TOKENS:
                    yield from (_batch([r]) for r in pack(at + number, docs, learn, seqs))
                    docs, learn, seqs, held, number = [], [], [], 0, number + 1
        if docs:
            yield from (_batch([r]) for r in pack(at + number, docs, learn, seqs))
        docs, learn, seqs = [], [], []
        release_memory()
    return run


def _within(sizes: np.ndarray) -> np.ndarray:
    """0..n-1 for every n of ``sizes``, concatenated."""
    total = int(sizes.sum())
    first = np.repeat(np.cumsum(sizes, dtype=np.int64) - sizes, sizes)
    return np.arange(total, dtype=np.int64) - first


def _unpack(parts):
    words, q, contexts, which, per, docs, flags = parts
    q = from_planes(q, np.uint32).astype(np.int64)
    p = from_rising(contexts)[from_planes(which, np.uint32)]
    return np.repeat(from_rising(words), q), p, from_planes(per, np.uint32).astype(np.int64), docs, np.frombuffer(flags, np.uint8)


def _histogram(counts: np.ndarray, upto: int) -> np.ndarray:
    return np.bincount(np.minimum(counts, upto + 1), minlength=upto + 2)[:upto + 2]


def _count(shards: int, hot: np.ndarray, hot_counts: np.ndarray):
    """Counts of one word shard; what it adds to its documents, contexts and tables."""
    def shard_rows(held, shard, rows):
        cur, prev, sums, sizes = [], [], [], []
        for _, parts in rows:
            c, p, per, docs, flags = _unpack(parts)
            used = flags[from_planes(docs, np.uint32)].astype(np.int64)
            starts = np.cumsum(per) - per
            cur.append(c)
            prev.append(p)
            sums.append(np.add.reduceat(used, starts))
            sizes.append(len(c))
        cur, prev, sums = np.concatenate(cur), np.concatenate(prev), np.concatenate(sums)
        order = np.lexsort((prev, cur))
        run = _runs(cur[order], prev[order])
        c2 = np.add.reduceat(sums[order], run)
        entry2 = np.empty(len(cur), np.int64)
        entry2[order] = np.repeat(c2, np.diff(_ends(run, len(order))))
        word, ctx = cur[order[run]], prev[order[run]]
        del cur, prev, sums
        wrun = _runs(word)
        w = word[wrun]
        c1 = np.add.reduceat(c2, wrun)
        crowd = np.isin(w, hot)
        c1[crowd] = hot_counts[np.searchsorted(hot, w[crowd])]
        per_pair = np.repeat(c1, np.diff(_ends(wrun, len(word))))
        entry1 = np.empty(len(entry2), np.int64)
        entry1[order] = np.repeat(per_pair, np.diff(_ends(run, len(order))))
        del order, run
        known = (c1 > 0) & ~crowd
        stats = [int(c1[known].sum()), int(known.sum()), int(c1[w == END].sum()),
                 *_histogram(c1[known], K + 1)[1:K + 2].tolist(), *_histogram(c2, K + 1)[1:K + 2].tolist()]
        seen = c2 > 0
        yield _row("words", shard, 0, [rising(w[known]), planes(c1[known])], stats)
        after, each = np.unique(word[seen], return_counts=True)
        contexts, which = np.unique(ctx[seen], return_inverse=True)
        yield _row("bigrams", shard, 0, [rising(after), planes(each.astype(np.uint32)), rising(contexts), planes(which.astype(np.uint32)), planes(c2[seen].astype(np.uint32))])
        del after, each, contexts, which
        yield from context_rows(ctx[seen], c2[seen], per_pair[seen])
        del word, ctx, c2, per_pair, seen
        lo, asks = 0, []
        for (block, parts), n in zip(rows, sizes, strict=True):
            _, p, per, docs, flags = _unpack(parts)
            asks.append(document_share(held, block, p, per, from_planes(docs, np.uint32), len(flags), entry1[lo:lo + n], entry2[lo:lo + n]))
            lo += n
        del entry1, entry2
        yield from unseen_rows(np.array([block for block, _ in rows], np.int64), asks)

    def context_rows(ctx, c2, c1):
        order = np.argsort(ctx)
        ctx, c2, c1 = ctx[order], c2[order], c1[order]
        run = _runs(ctx)
        if not len(run):
            return
        h = ctx[run]
        cols = [np.add.reduceat((c2 == r).astype(np.uint32), run) for r in range(1, K + 1)]
        cols += [np.add.reduceat((c1 == r).astype(np.uint32), run) for r in range(1, K + 1)]
        large = [np.add.reduceat(np.where(c2 > K, c2, 0), run), np.add.reduceat(np.where(c1 > K, c1, 0), run)]
        shard = shard_of(h, shards)
        cuts = _runs(shard)
        for lo, hi in zip(cuts, _ends(cuts, len(h))[1:], strict=True):
            yield _row("sums", shard[lo], 0, [rising(h[lo:hi]), planes(np.concatenate([x[lo:hi] for x in cols]).astype(np.uint32)),
                                              planes(np.concatenate([x[lo:hi] for x in large]).astype(np.int64))])

    def document_share(held, block, p, per, docs, n_docs, e1, e2):
        """Adds a block's share to ``held``; the contexts of its unseen bigrams, sorted, and their documents."""
        c1, c2 = np.repeat(e1, per), np.repeat(e2, per)

        def add(keep, weights=None):
            return np.bincount(docs[keep], None if weights is None else weights[keep], n_docs)
        every = np.ones(len(docs), bool)
        unseen = c2 == 0
        log1 = np.log10(np.maximum(c1, 1))
        real = [add(every, np.log10(c1 + 1)), add(c2 > K, np.log10(np.maximum(c2, 1))), add(unseen & (c1 > K), log1)]
        whole = [add(c1 > 0)] + [add(c2 == r) for r in range(1, K + 1)] + [add(unseen & (c1 == r)) for r in range(K + 1)] + [add(unseen & (c1 > K))]
        share = np.array(real), np.array(whole, np.uint32)
        kept = held.get(block)
        held[block] = share if kept is None else (kept[0] + share[0], kept[1] + share[1])
        ask = np.flatnonzero(np.repeat(e2 == 0, per))
        h, d = np.repeat(p, per)[ask], docs[ask]
        order = np.argsort(h, kind="stable")
        return h[order], d[order]

    def unseen_rows(blocks, asks):
        """The unseen bigrams of a word shard, one row per context shard: by block, then by context."""
        h, d = (np.concatenate(x) for x in zip(*asks, strict=True))
        at = np.repeat(np.arange(len(asks)), [len(x) for x, _ in asks])
        shard = shard_of(h, shards)
        order = np.argsort(shard, kind="stable")
        h, d, at, shard = h[order], d[order], at[order], shard[order]
        cuts = _runs(shard)
        for lo, hi in zip(cuts, _ends(cuts, len(h))[1:], strict=True):
            run, block = _runs(at[lo:hi], h[lo:hi]), _runs(at[lo:hi])
            yield _row("unseen", shard[lo], 0, [rising(h[lo:hi][run]), planes(np.diff(_ends(run, hi - lo)).astype(np.uint32)), planes(d[lo:hi]),
                                                planes(blocks[at[lo:hi][block]]), planes(np.diff(_ends(block, hi - lo)).astype(np.uint32))])

    def told(held):
        """Documents' shares added up over the shards of a task so far; only documents that have one."""
        for block, (real, whole) in held.items():
            at = np.flatnonzero(real.any(axis=0) | whole.any(axis=0))
            yield _batch([_row("shares", 0, block, [rising(at.astype(np.uint64)), planes(real[:, at].ravel()), planes(whole[:, at].ravel())])])
        held.clear()

    def run(batches):
        held: dict[int, tuple] = {}
        for shard, table in groups(batches, "shard"):
            rows = list(zip(table.column("kind").to_pylist(), table.column("block").to_pylist(), table.column("parts").to_pylist(), strict=True))
            for _, block, parts in (r for r in rows if r[0] == "block"):
                yield _batch([_row("block", 0, block, parts)])
            if pairs := [r[1:] for r in rows if r[0] == "pairs"]:
                del rows, table
                yield from (_batch([r]) for r in shard_rows(held, shard, pairs))
            if sum(real.nbytes + whole.nbytes for real, whole in held.values()) > HELD_BYTES:
                yield from told(held)
            release_memory()
        yield from told(held)
    return run


def _contexts(d1: list[float], d2: list[float], total: int):
    """Backoff weight of every context of a shard; answers for the unseen bigrams that ask."""
    ranks = np.arange(1, K + 1)

    def table_of(rows):
        h = np.concatenate([from_rising(p[0]) for p in rows])
        small = np.concatenate([from_planes(p[1], np.uint32).reshape(2 * K, -1) for p in rows], axis=1).astype(np.int64)
        large = np.concatenate([from_planes(p[2], np.int64).reshape(2, -1) for p in rows], axis=1)
        order = np.argsort(h)
        run = _runs(h[order])
        small, large = (np.add.reduceat(x[:, order], run, axis=1) for x in (small, large))
        c = large[0] + ranks @ small[:K]
        left = (1 + ((1 - np.array(d2)) * ranks) @ small[:K]) / (c + 1)
        lower = 1 - (large[1] + (np.array(d1) * ranks) @ small[K:]) / (total + 1)
        return h[order][run], c, left / lower

    def answers(held):
        """What contexts add to documents, one row per block."""
        block, doc, value = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, block))
        run = _runs(block[order], doc[order])
        value = np.add.reduceat(value[order], run)
        block, doc = block[order][run], doc[order][run].astype(np.uint64)
        cuts = _runs(block)
        for lo, hi in zip(cuts, _ends(cuts, len(block))[1:], strict=True):
            yield _batch([_row("answers", 0, block[lo], [rising(doc[lo:hi]), planes(value[lo:hi])])])

    def run(batches):
        for shard, table in groups(batches, "shard"):
            rows = list(zip(table.column("kind").to_pylist(), table.column("parts").to_pylist(), strict=True))
            sums = [parts for kind, parts in rows if kind == "sums"]
            h, c, a = table_of(sums) if sums else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))
            if sums:
                yield _batch([_row("contexts", shard, 0, [rising(h), planes(c), planes(a)])])
            worth = np.log10(a) + np.log10(c + 1)
            held, size = [], 0
            for kind, parts in rows:
                if kind != "unseen":
                    continue
                asked, docs = from_rising(parts[0]), from_planes(parts[2], np.uint32)
                at = np.minimum(np.searchsorted(h, asked), max(len(h) - 1, 0))
                value = np.where(h[at] == asked, worth[at], 0.0) if len(h) else np.zeros(len(asked))
                value = np.repeat(value, from_planes(parts[1], np.uint32))
                block = np.repeat(from_planes(parts[3], np.int64), from_planes(parts[4], np.uint32))
                told = value != 0
                held.append((block[told], docs[told], value[told]))
                size += sum(x.nbytes for x in held[-1])
                if size > HELD_BYTES:
                    yield from answers(held)
                    held, size = [], 0
            if size:
                yield from answers(held)
            release_memory()
    return run


def _finish(d1: list[float], d2: list[float], total: int, distinct: int, unknown: float):
    """Scores of a block's documents from what the shards said of them."""
    ranks = np.arange(1, K + 1)
    of_bigram = np.log10(np.array(d2) * ranks)
    of_word = np.r_[np.log10(unknown), np.log10(np.array(d1) * ranks) - np.log10(total + 1), -np.log10(total + 1)]

    def run(batches):
        for _, table in groups(batches, "block"):
            rows = list(zip(table.column("kind").to_pylist(), table.column("parts").to_pylist(), strict=True))
            head = next(parts for kind, parts in rows if kind == "block")
            n = from_planes(head[2], np.uint32).astype(np.int64)
            real, whole, answers = np.zeros((3, len(n))), np.zeros((2 * K + 3, len(n)), np.int64), np.zeros(len(n))
            for kind, parts in rows:
                if kind == "block":
                    continue
                at = from_rising(parts[0]).astype(np.int64)
                if kind == "shares":
                    real[:, at] += from_planes(parts[1], np.float64).reshape(3, -1)
                    whole[:, at] += from_planes(parts[2], np.uint32).reshape(2 * K + 3, -1)
                else:
                    answers[at] += from_planes(parts[1], np.float64)
            score = real[1] + of_bigram @ whole[1:K + 1] - real[0] + real[2] + of_word @ whole[K + 1:] + answers
            ids, valid = from_planes(head[0], np.int64), np.frombuffer(head[1], np.uint8)
            yield record(_SCORES, doc_id=pa.array(ids, pa.int64(), mask=valid == 0), n_tokens=n, n_known=whole[0],
                         base_score=real[0] - n * np.log10(total + distinct + 1), score=score)
    return run


def _hot_words(base: DataFrame, size: int, shards: int, most: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Words with over two shards' worth of tokens (at most ``most``) and their exact training counts.

    A sample of about 500 documents names them - any choice gives the same scores -
    and a full pass counts them, if there are any.  Both count in tasks; the driver
    gets the ``most`` frequent words of the sample.
    """
    picked = base.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < max(1, (500 << 20) // max(size, 1))).select("text")

    def sample(batches):
        for batch in pieces(batches, 100):
            for text in batch.column(0).to_pylist():
                words, n = np.unique(tokens(text), return_counts=True)
                # START, which is no token, tells how many there are
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[words, np.uint64(START)].view(np.int64)), pa.array(np.r_[n, n.sum()].astype(np.int64))], names=["word", "n"])
    rows = (arrow_map(picked, sample, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "word").limit(most + 1).collect())
    counts = {r["word"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in rows}
    floor = counts.pop(START, 0) * max(2 / shards, 1 / most)
    hot = np.array(sorted(w for w, n in counts.items() if n > floor), np.uint64)
    if not len(hot):
        return hot, np.zeros(0, np.int64)

    def count(batches):
        total = np.zeros(len(hot), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                t = tokens(text)
                at = np.minimum(np.searchsorted(hot, t), len(hot) - 1)
                total += np.bincount(at[hot[at] == t], minlength=len(hot))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(hot)), pa.int32()), pa.array(total)], names=["at", "n"])
    rows = arrow_map(base.where("learn").select("text"), count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(hot), np.int64)
    for r in rows:
        out[r["at"]] = r["n"]
    return hot, out


class KatzModel:
    """Tables and constants of a trained model, and the scores of the documents it was given."""

    def __init__(self, tables: DataFrame, contexts: DataFrame, scores: DataFrame, constants: dict):
        self.tables, self.contexts, self.scores, self.constants = tables, contexts, scores, constants


def katz(docs: DataFrame, learn: Column, shard_tokens: int = 2 << 20, bytes_per_token: float = 6.5) -> KatzModel:
    """Train on the rows where ``learn`` (a condition on doc_id) holds and score every row."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    size = base.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("b")).first()
    shards = max(1, round((size["b"] or 0) / bytes_per_token / shard_tokens))
    # A task takes a few shards and adds up what they say of a document before it tells.
    tasks = max(min(shards, spark.sparkContext.defaultParallelism), -(-shards // 3))
    hot, hot_counts = _hot_words(base, size["n"], shards)
    packed = arrow_map(base, _blocks(shards, hot), ROWS)
    tables = stage(arrow_map(packed.repartition(tasks, "shard").sortWithinPartitions("shard"), _count(shards, hot, hot_counts), ROWS), "katz", "kind")
    words = tables.where(F.col("kind") == "words")
    sums = words.agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(N_STATS)]).first()
    stats = np.array([x or 0 for x in sums], np.int64)
    present = hot_counts[hot_counts > 0]
    stats[0] += present.sum()
    stats[1] += len(present)
    stats[3:3 + K + 1] += _histogram(present, K + 1)[1:K + 2]
    total, distinct, n1, n2 = int(stats[0]), int(stats[1]), stats[3:4 + K].tolist(), stats[4 + K:].tolist()
    d1, d2 = discounts(n1), discounts(n2)
    unknown = (1 + sum((1 - d) * r * n for r, (d, n) in enumerate(zip(d1, n1, strict=False), 1))) / (total + 1)
    asked = tables.where(F.col("kind").isin("sums", "unseen"))
    told = stage(arrow_map(asked.select("kind", "shard", "block", "parts").repartition(tasks, "shard").sortWithinPartitions("shard"),
                           _contexts(d1, d2, total), ROWS), "katz-contexts", "kind")
    said = (tables.where(F.col("kind").isin("block", "shares")).select("kind", "block", "parts")
            .unionByName(told.where(F.col("kind") == "answers").select("kind", "block", "parts")))
    scores = arrow_map(said.repartition("block").sortWithinPartitions("block"), _finish(d1, d2, total, distinct, unknown),
                       "doc_id long, n_tokens long, n_known long, base_score double, score double")
    constants = {"tokens": total, "words": distinct, "unknown": unknown, "d1": d1, "d2": d2, "hot": dict(zip(hot.tolist(), hot_counts.tolist(), strict=True))}
    return KatzModel(tables.where(F.col("kind").isin("words", "bigrams")), told.where(F.col("kind") == "contexts"), scores, constants)
