"""Language identification by a byte convolutional network.

Texts are read as windows of ``WINDOW`` bytes over their whole length.  A byte
embedding feeds filters of several widths; each filter's maximum over the window
goes to a softmax over the languages.  A document's probabilities are the mean
of its windows', weighted by their bytes.  The network is small (a few thousand
numbers) and trained in numpy on a bounded sample of labelled documents:
``docs_per_lang`` per language by hash order, ``windows_per_doc`` windows each.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
so is every text when no labelled document exists; rows with a null lang are
never learned from; ties go to the language that sorts first; repeated rows
and null doc_ids are scored like any other; very long texts are read whole,
window by window; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pieces

WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16
UNKNOWN = "und"
#: Unicode letters (categories Lu, Ll, Lt, Lm, Lo): neither digits such as a half or a superscript, nor marks.
_LETTER = regex.compile(r"\p{L}")


def windows(text: bytes) -> np.ndarray:
    """(n, WINDOW) bytes of the whole text, A-Z lower-cased; the last window is padded with zeros."""
    raw = np.frombuffer(text.lower(), np.uint8)
    out = np.zeros(max(1, -(-len(raw) // WINDOW)) * WINDOW, np.uint8)
    out[:len(raw)] = raw
    return out.reshape(-1, WINDOW)


class ByteConvNet:
    """Embedding -> convolutions of several widths -> max over the window -> softmax."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.conv = [rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    @property
    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.conv, self.out, self.bias]

    def features(self, x: np.ndarray, where: bool = False):
        """Max-pooled filter outputs (n, filters); with ``where`` also the positions of the maxima."""
        e = self.embed[x]
        feats, at = [], []
        for w, k in zip(WIDTHS, self.conv, strict=True):
            n = WINDOW - w + 1
            flat = np.lib.stride_tricks.as_strided(e, (len(x), n, w * EMBED), e.strides[:2] + e.strides[2:])
            y = (flat.reshape(-1, w * EMBED) @ k).reshape(len(x), n, FILTERS)
            if where:
                at.append(y.argmax(axis=1))
                feats.append(np.take_along_axis(y, at[-1][:, None], axis=1)[:, 0])
            else:
                feats.append(y.max(axis=1))
        feats = np.maximum(np.concatenate(feats, axis=1), 0)
        return (feats, at, e) if where else feats

    def probabilities(self, x: np.ndarray, block: int = 64) -> np.ndarray:
        out = np.empty((len(x), len(self.langs)), np.float32)
        for lo in range(0, len(x), block):
            out[lo:lo + block] = self._softmax(self.features(x[lo:lo + block]))
        return out

    def _softmax(self, feats: np.ndarray) -> np.ndarray:
        z = feats @ self.out + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        feats, at, e = self.features(x, where=True)
        d = self._softmax(feats)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g_out, g_bias, g_feat = feats.T @ d, d.sum(axis=0), (d @ self.out.T) * (feats > 0)
        g_embed, g_conv = np.zeros_like(self.embed), []
        rows = np.arange(len(x))[:, None]
        for j, (w, k) in enumerate(zip(WIDTHS, self.conv, strict=True)):
            g = g_feat[:, j * FILTERS:(j + 1) * FILTERS]
            pos = at[j][:, :, None] + np.arange(w)                       # (n, filters, w): bytes under each maximum
            patch = e[rows[:, :, None], pos].reshape(len(x), FILTERS, w * EMBED)
            g_conv.append(np.einsum("nfk,nf->kf", patch, g))
            back = g[:, :, None] * k.T[None]                            # (n, filters, w * EMBED)
            np.add.at(g_embed, x[rows[:, :, None], pos].ravel(), back.reshape(-1, EMBED))
        return [g_embed, *g_conv, g_out, g_bias]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 3e-3, seed: int = 11) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        m = [np.zeros_like(p) for p in self.params]
        v = [np.zeros_like(p) for p in self.params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                step += 1
                part = order[lo:lo + batch]
                for p, g, a, b in zip(self.params, self._gradients(x[part], y[part]), m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= (rate / (1 - 0.9 ** step) * a / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self


def train(labelled: DataFrame, docs_per_lang: int = 300, windows_per_doc: int = 4) -> ByteConvNet | None:
    """Fit on at most ``docs_per_lang`` documents of each language (None without any).

    The first by hash.  A share of the hash space that should hold half as many again
    is cut out of every language in the tasks, by a sketch of its distinct rows (equal rows
    count once), so no task gathers a language; the driver keeps the first of these.
    """
    usable = (labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
              .select("lang", "doc_id", "text", F.xxhash64("doc_id", "text").alias("hash")))
    sizes = usable.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()
    # one row per language, as many as the network has outputs
    shares = labelled.sparkSession.createDataFrame([(r["lang"], (1.5 * docs_per_lang + 60) / max(r["n"], 1)) for r in sizes], "lang string, share double")
    raw = F.encode("text", "utf-8")
    # the windows used, cut out before anything reaches the driver
    parts = F.transform(F.sequence(F.lit(0), F.lit(windows_per_doc - 1)),
                        lambda i: F.substring(raw, (F.length(raw) * i / windows_per_doc).cast("int") + 1, WINDOW))
    picked = (usable.join(F.broadcast(shares), "lang").where(F.col("hash") / 2.0 ** 64 + 0.5 < F.col("share"))
              .groupBy("lang", "hash").agg(F.min(F.struct("doc_id", parts.alias("parts"))).alias("kept")))
    of_lang = defaultdict(list)
    for r in sorted(picked.collect(), key=lambda r: r["hash"]):
        of_lang[r["lang"]].append((r["lang"], r["kept"]["doc_id"] or 0, [bytes(p) for p in r["kept"]["parts"]]))
    rows = sorted((row for found in of_lang.values() for row in found[:docs_per_lang]), key=lambda r: r[:2])
    pairs = [(lang, p) for lang, _, parts in rows for p in parts if _LETTER.search(p.decode("utf-8", "ignore"))]
    if not pairs:
        return None
    langs = sorted({lang for lang, _ in pairs})
    x = np.concatenate([windows(p)[:1] for _, p in pairs])
    y = np.array([langs.index(lang) for lang, _ in pairs])
    return ByteConvNet(langs).fit(x, y)


def _predict(net: ByteConvNet | None):
    def run(batches):
        for batch in pieces(batches, 200):
            texts = batch.column(1).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if net is not None and t is not None and _LETTER.search(t)]
            for lo in range(0, len(known), 50):
                some = known[lo:lo + 50]
                raws = [texts[i].encode("utf-8", "replace") for i in some]
                wins = [windows(r) for r in raws]
                p = net.probabilities(np.concatenate(wins))
                at = 0
                for i, raw, win in zip(some, raws, wins, strict=True):
                    weight = np.minimum(WINDOW, len(raw) - WINDOW * np.arange(len(win)))
                    mean = weight @ p[at:at + len(win)] / weight.sum()
                    at += len(win)
                    best = int(mean.argmax())
                    langs[i], scores[i] = net.langs[best], min(1.0, max(0.0, float(mean[best])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *batch.columns[2:]],
                                             names=["doc_id", "lang_pred", "score", *batch.schema.names[2:]])
    return run


def identify(docs: DataFrame, learn: Column, docs_per_lang: int = 300, windows_per_doc: int = 4,
             carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score and the columns ``carry``: one row per row of ``docs``.

    Learned from the rows where ``learn`` (a condition on doc_id) holds.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    net = train(base.where(learn), docs_per_lang, windows_per_doc)
    # ``text`` twice: the first copy is read by the network, a carried one is passed on.
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("read"), *carry)
    types = dict(whole.dtypes)
    return arrow_map(whole, _predict(net), "doc_id long, lang_pred string, score double" + "".join(f", `{c}` {types[c]}" for c in carry))
