"""Best-fit packing planned over the histogram of lengths.

Documents are tokenised once; what is longer than a sequence is cut into full
sequences and a first, shorter piece.  Best-fit decreasing then runs over the
*counts* per length (at most ``capacity`` of them, whatever the number of
documents) and yields a plan: for every length, runs of consecutive ranks with
the sequence numbers and the offset they take.  Pieces find their slot by
joining the plan on (length, rank).  Every piece has a key of its own, written
with it; a length with more than ``cell_rows`` pieces is dealt by that key to as many
cells as needed, and ranks are made from counts per cell, so a length shared by
a third of all documents, or by very many copies of one, is ranked in many tasks.

Defined cases: a null or empty text is the end token alone; an added token of the
vocabulary written out in a text is that token; repeated rows are
packed each; ties in length are ranked by (cell, doc_id, piece, key); a null doc_id
is packed like any other; a very long text is tokenised whole; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, pieces, record, stage

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("ids", pa.binary())])
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """Byte of every character of the byte-level alphabet: printable bytes stand for themselves, the others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def rank_form(path: str) -> dict[bytes, int] | None:
    """The vocabulary as ranks of byte strings, if merging by rank provably gives the ids of ``tokenizers``.

    Merging by rank joins any two neighbours whose bytes are a token, ``tokenizers``
    only listed pairs.  Say they part for the first time at a token t covered by
    two neighbours.  No merge has crossed t's borders, so inside them both have
    done what they do on t alone; if t alone ends as t, its last two tokens are
    the listed pair, and both join them.  So it is enough that ids follow the
    order of merges, and that every token encodes to itself: both are tested here.
    """
    from tokenizers import Tokenizer, models
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if (spec.get("normalizer") or model.get("type") != "BPE" or split.get("type") != "ByteLevel"
            or not split.get("use_regex") or split.get("add_prefix_space")
            or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))):
        return None
    vocab, byte = model["vocab"], _byte_of()
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    after = [vocab.get(left + right, -1) for left, right in merges]
    alone = Tokenizer(models.BPE(vocab, merges)).encode_batch_fast(list(vocab), add_special_tokens=False)
    if (any(c not in byte for token in vocab for c in token) or not byte.keys() <= vocab.keys() or after != sorted(set(after))
            or any(e.ids != [i] for e, i in zip(alone, vocab.values(), strict=True))):
        return None
    return {bytes(byte[c] for c in token): i for token, i in vocab.items()}


class RankTokenizer:
    """Token ids (little-endian unsigned 32-bit) of whole texts, as ``tokenizers`` gives them.

    With ``added_tokens`` (as ``pack_documents`` asks for) the tokens the file adds
    to its vocabulary are recognised in a text, as ``tokenizers`` does unless told
    otherwise; without, they are encoded like any other characters.

    Vocabularies that have a ``rank_form`` are merged by rank, which takes a
    third of the time; other vocabularies, texts that hold an added token to be
    recognised, and texts with a very long run of white space (which the splitting
    pattern follows recursively), go through ``tokenizers`` itself.
    """

    #: Splitting pattern of byte-level vocabularies (fixed value).
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    LONG = 50_000
    LONG_SPACE = re.compile(rf"\s{{{LONG}}}")

    def __init__(self, path: str, added_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self._whole = Tokenizer.from_file(path)
        self._whole.encode_special_tokens = not added_tokens
        with open(path, encoding="utf-8") as f:
            found = [t["content"] for t in json.load(f).get("added_tokens") or () if added_tokens or not t.get("special")]
        self._added = re.compile("|".join(map(re.escape, found))) if found else None
        self._ranked = None
        ranks = rank_form(path)
        if ranks is not None:
            import tiktoken
            self._ranked = tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if (self._ranked is None or (self._added and self._added.search(text))
                or (len(text) >= self.LONG and self.LONG_SPACE.search(text))):
            ids = self._whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self._ranked.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


_LOADED: dict[str, RankTokenizer] = {}


def _tokenizer(path: str) -> RankTokenizer:
    if path not in _LOADED:
        _LOADED[path] = RankTokenizer(path, added_tokens=True)
    return _LOADED[path]


def _cut(path: str, capacity: int, end_id: int, keep_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        tok = _tokenizer(path)
        for batch in pieces(batches, 500):
            docs = batch.column(0).to_pylist()
            rows = []
            for doc, text in zip(docs, batch.column(1), strict=True):
                ids = tok.ids(text.as_py() or "") + end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for piece, stop in enumerate(range(first, n + 1, capacity)):
                    start = max(0, stop - capacity)
                    part = ids[4 * start:4 * stop] if n > capacity else ids
                    rows.append((doc, piece, start, stop - start, zlib.crc32(part), part if keep_ids else None))
            yield record(_PIECES, **dict(zip(_PIECES.names, zip(*rows, strict=True), strict=True)))
    return run


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, first_rank, last_rank_excl, first_sequence, offset).

    Bins are handled in groups of equal free room made of consecutive sequence
    numbers; placing c items splits at most one group, so the plan stays small.
    """
    rooms: list[int] = []                      # free rooms that occur, ascending
    by_room: dict[int, list[tuple[int, int]]] = {}  # room -> [(first_sequence, how_many)]
    plan, opened = [], 0

    def put(room: int, first: int, many: int) -> None:
        if room:
            if room not in by_room:
                insort(rooms, room)
                by_room[room] = []
            by_room[room].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            room, many = (rooms[at], 0) if at < len(rooms) else (capacity, left)
            if at < len(rooms):
                first, many = by_room[room].pop()
            else:
                first = opened
            # What a piece leaves free is the tightest room for the next one of its length, as long as that fits:
            # sequences are filled side by side with as many as they take, and one with what is left over.
            each = room // length
            took, each = (min(many, left // each), each) if left >= each else (1, left)
            if at == len(rooms):
                opened += took
            elif many > took:
                by_room[room].append((first + took, many - took))
            elif not by_room[room]:
                del by_room[room], rooms[at]
            for _ in range(each):
                plan.append((length, rank, rank + took, first, capacity - room))
                rank, left, room = rank + took, left - took, room - length
            put(room, first, took)
    return plan


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0,
                   keep_ids: bool = False, cell_rows: int = 1 << 18) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (if ``keep_ids``), sequence_id, offset: one row per piece."""
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    cut = stage(arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
                          _cut(path, capacity, end_id, keep_ids), PIECES).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    plan = plan_best_fit(counts, capacity)
    # Both tables below are bounded by capacity: runs are split at most once per length.
    runs = (spark.createDataFrame(plan, "length long, lo long, hi long, sequence0 long, offset long")
            .groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "sequence0", "offset"))).alias("runs")))
    many = spark.createDataFrame([(k, -(-n // cell_rows)) for k, n in counts.items()], "length long, cells long")
    dealt = cut.join(F.broadcast(many), "length").withColumn("cell", F.pmod(F.xxhash64("row"), F.col("cells"))).drop("cells")
    # One row a cell (pieces / cell_rows + capacity of them) with its first rank and the runs that its ranks meet.
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    meets = F.filter("runs", lambda r: (r["lo"] < F.col("rank0") + F.col("n")) & (r["hi"] > F.col("rank0")))
    cells = stage(dealt.groupBy("length", "cell").agg(F.count("*").alias("n")).withColumn("rank0", F.coalesce(F.sum("n").over(before), F.lit(0)))
                  .join(F.broadcast(runs), "length").select("length", "cell", "rank0", meets.alias("runs")), "piece-cells")
    within = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32", "row")
    ranked = (dealt.withColumn("at", F.row_number().over(within) - 1).join(cells, ["length", "cell"])
              .withColumn("rank", F.col("rank0") + F.col("at")))
    run = F.filter("runs", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"]))[0]
    placed = ranked.withColumn("run", run)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []),
            (F.col("run.sequence0") + F.col("rank") - F.col("run.lo")).alias("sequence_id"), F.col("run.offset").alias("offset")]
    return placed.select(*cols)
