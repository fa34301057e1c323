"""Personal data by bootstrapped contextual extraction, in DataFrame expressions only.

*Seeds* are what four formats recognise for certain: e-mail and IP addresses,
card numbers (Luhn) and phone numbers.  Their left contexts (one and two words)
are the lexical *patterns*.  A word ends at white space or behind a mark that an
identifier may follow without a blank (``id=``, ``tel:``, a quote or an opening bracket), here and where the
occurrences of patterns are counted, so ``id=`` is counted whatever it is glued to;
a seed that starts inside a word has no pattern.  *Instances* are the seeds and all other
identifier-like tokens (with a digit or an ``@``), where groups of digits or
capitals joined by single blanks, dots, hyphens or brackets, as the seeds'
formats join them, make one instance.  Patterns and instances form a graph that
is scored in rounds:

* a pattern's score for a kind is the weight of its instances of that kind over
  all its occurrences, whatever followed (so a common word, which identifiers
  follow by chance, scores next to nothing);
* an instance's score is the chance that at least one of its patterns is right
  (noisy or), one for seeds.

Tokens that follow a pattern scoring ``min_pattern`` or more and score
``min_instance`` or more themselves are added as spans of that kind.

Offsets come without any Python: a text split by a pattern gives the gaps, the
matches give the rest, and running sums of both lengths, made in stretches of
about the root of their number, give every position in code points.

Fixed values of the grouped form: groups of up to eight digits or capitals, up to
nine of them; longer runs are read as single tokens.

Defined cases: null and empty texts have no spans; a failing match (Luhn, a part
over 255, too few digits) is dropped without retrying; spans of one kind never
overlap; added tokens never overlap a base span (single tokens beside it stand
in for a run of groups that would); repeated rows are returned each; null
doc_ids pass through; extra columns are ignored; an empty table gives an empty
result.  Very long texts are read whole: the formats run in linear time on long runs of digits
or letters (possessive quantifiers, starts of runs only), and words are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: The four formats, written so that every match starts where the leftmost greedy one does.
FORMATS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_TOKEN = r"[^\x20\x09-\x0D]+"
#: A single identifier-like token: six characters or more with a digit or an @, less quotes, brackets and closing marks.
_START = r"""(?<![^\x20\x09-\x0D"'(\[=:])"""
_SINGLE = _START + r"""(?=[^\x20\x09-\x0D]*[0-9@])[^\x20\x09-\x0D"'()\[\]=:,;]{5,}[^\x20\x09-\x0D"'()\[\]=:,;.!?]"""
#: Two to nine groups of up to eight digits or capitals (one digit at least), joined by a blank, dot, hyphen or brackets,
#: six characters or more in all; a group after a blank has two or more.  The last one ends where a single token ends.
_GROUP = r"(?=[A-Z]{0,7}[0-9])[0-9A-Z]{1,8}+"
_JOIN = rf"(?:[.-]|\x20(?=[0-9A-Z]{{2}})|[\x20.-]?\({_GROUP}\)[\x20.-]?)"
_END = r"""(?=[.!?]*+(?:[\x20\x09-\x0D"'()\[\]=:,;]|\z))"""
_LAST = rf"{_END}(?!{_JOIN}{_GROUP})"
_GROUPED = (rf"{_START}\+?(?:(?![0-9A-Z\x20().-]{{3,5}}{_LAST}){_GROUP}{_JOIN}|"
            rf"(?!\((?:[0-9A-Z]\)(?:[\x20.-]?[0-9A-Z]|[0-9A-Z]{{2}})|[0-9A-Z]{{2}}\)[0-9A-Z]){_LAST})\({_GROUP}\)[\x20.-]?)"
            rf"{_GROUP}(?:{_JOIN}{_GROUP}){{0,7}}{_END}")
#: Marks an identifier may follow without a blank; a word ends behind them.
_GLUE = r"""["'(\[=:]"""
#: Where words end: white space, or behind marks that something follows.
_BREAK = rf"""[\x20\x09-\x0D]+|(?<={_GLUE})(?!["'(\[=:\x20\x09-\x0D])"""
_SPANS = "array<struct<k:int,s:bigint,e:bigint,left:array<string>,value:string>>"
#: Supported patterns up to this number are handed to all tasks (fixed value).
_SHORT_LIST = 500_000
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = _digits(x)
    n = F.length(d)

    def add(total, i):
        v = F.substring(d, n - i + 1, F.lit(1)).cast("int") * (F.lit(1) + (i % 2 == 0).cast("int"))
        return total + v - F.when(v > 9, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


_VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: x.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda x: F.length(_digits(x)).between(16, 19) & _luhn(x),
    "phone": lambda x: F.length(_digits(x)).between(8, 15),
}


def _is_valid(kind: str):
    return lambda x: _VALID[kind](x["value"])


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once (an expression inside a lambda is computed for every element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(sums: Column) -> Column:
    """0 and the running sums of an array of whole numbers."""
    return F.aggregate(sums, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, F.lit(-1)) + x)))


def _starts(sizes: Column) -> Column:
    """The sum of all sizes before each one: running sums within stretches, then those of the stretches."""
    def of(sizes):
        each = F.greatest(F.ceil(F.sqrt(F.size(sizes))), F.lit(1)).cast("int")
        stretches = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(sizes), F.lit(1)) - 1) / each).cast("int")),
                                lambda k: F.slice(sizes, k * each + 1, each))
        return _let(F.transform(stretches, _running), whole)

    def whole(inside):
        before = _running(F.transform(inside, lambda r: F.element_at(r, F.lit(-1))))
        return F.flatten(F.zip_with(inside, F.slice(before, F.lit(1), F.size(inside)),
                                    lambda r, b: F.transform(F.slice(r, F.lit(1), F.size(r) - 1), lambda v: v + b)))
    return _let(sizes, of)


def _ending(gap: Column) -> Column:
    """The last two words of what stands before a match, none if the match starts inside a word."""
    words = F.filter(F.split(_plain(gap), _BREAK, -1), lambda w: w != "")
    aligned = F.right(gap, F.lit(1)).rlike(r"""[\x20\x09-\x0D"'(\[=:]""")
    last = _let(words, lambda w: F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), F.lit(2)))
    return F.when(aligned, last).otherwise(F.expr("cast(array() as array<string>)"))


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[0-9]", "0")


def _places(text: Column, pattern: str, kind: int, maybe: Column) -> Column:
    """Spans of all matches; ``maybe`` is a cheap test that there can be any."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr(f"cast(array() as {_SPANS})")
    # a match more than gaps never occurs; the last gap (after the last match) is cut off
    gaps = F.split(text, pattern, -1)
    pairs = _let(gaps, lambda gaps: F.zip_with(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), found,
                                               lambda g, m: F.struct(g.alias("gap"), m.alias("m"))))

    def span(x, before):
        start = before + F.length(x["gap"])
        return F.struct(F.lit(kind).alias("k"), start.alias("s"), (start + F.length(x["m"])).alias("e"), _ending(x["gap"]).alias("left"), x["m"].alias("value"))

    def placed(pairs):
        return F.zip_with(pairs, _starts(F.transform(pairs, lambda x: (F.length(x["gap"]) + F.length(x["m"])).cast("bigint"))), span)
    return F.when(maybe, _let(pairs, placed)).otherwise(none)


def _patterns(words: Column) -> Column:
    """The contexts of one and two words, from the last two."""
    n = F.size(words)
    one = F.when(n >= 1, F.array(F.try_element_at(words, F.lit(-1))))
    two = F.when(n >= 2, F.array(F.concat_ws(" ", words)))
    empty = F.expr("cast(array() as array<string>)")
    return F.concat(F.coalesce(one, empty), F.coalesce(two, empty))


def _background(docs: DataFrame, supported: DataFrame) -> DataFrame:
    """(pattern, seen): occurrences of the supported patterns in all documents.

    A short list is handed to all tasks, so only its patterns are counted; beside a
    longer one all words and pairs are, each task adding up its own before any exchange.
    """
    w = docs.select(F.filter(F.split(_plain(F.col("text")), _BREAK, -1), lambda w: w != "").alias("w"))
    pairs = F.zip_with("w", F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
    said = w.select(F.explode(F.concat("w", F.slice(pairs, 1, F.greatest(F.size("w") - 1, F.lit(0))))).alias("pattern"))
    if supported.count() <= _SHORT_LIST:
        return said.join(F.broadcast(supported), "pattern").groupBy("pattern").agg(F.count("*").alias("seen"))
    return said.groupBy("pattern").agg(F.count("*").alias("seen")).join(supported, "pattern")


def find_personal_data(docs: DataFrame, rounds: int = 3, min_support: int = 5, min_pattern: float = 0.5, min_instance: float = 0.5) -> DataFrame:
    """doc_id, base and added: arrays of spans (k = index of the kind, s, e in code points, value) per row of ``docs``.

    ``min_support``: distinct seeds a pattern must have preceded.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = F.col("text")
    maybe = {"email": t.contains("@"), "ip": F.col("digits"), "card": F.col("digits"), "phone": t.contains("+")}
    flagged = base.withColumn("digits", t.rlike("[0-9]"))
    found = F.concat(*[F.filter(_places(t, FORMATS[k], i, maybe[k]), _is_valid(k)) for i, k in enumerate(KINDS)])
    identifier = F.col("digits") | t.contains("@")
    single = F.filter(_places(t, _SINGLE, -1, identifier), lambda x: x["value"].rlike("[0-9@]"))
    runs = F.filter(_places(t, f"{_GROUPED}|{_SINGLE}", -1, identifier), lambda x: x["value"].rlike("[0-9@]") & (F.length(x["value"]) >= 6))
    spans = stage(flagged.select("row", "doc_id", found.alias("base"), single.alias("single"), runs.alias("runs")), "pii-spans")

    # All spans in order of their starts, base ones (t = 0) first: what meets which is told by running ends and starts.
    def typed(spans, t):
        return F.transform(spans, lambda x: F.struct(F.lit(t).alias("t"), x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["left"].alias("left"), x["value"].alias("value")))
    rows = spans.select("row", F.explode(F.concat(typed(F.col("base"), 0), typed(F.col("runs"), 1), typed(F.col("single"), 2))).alias("x")).select("row", "x.*")
    forth, back = (Window.partitionBy("row").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0) for by in (("s", "t"), (F.desc("s"), F.desc("t"))))

    def meets(other):
        until = F.max(F.when(other, F.col("e"))).over(forth)
        since = F.min(F.when(other, F.col("s"))).over(back)
        return F.coalesce(until > F.col("s"), F.lit(False)) | F.coalesce(since < F.col("e"), F.lit(False))
    # where a run meets a base span, its single tokens beside the span stand in for it
    rows = rows.withColumn("hit", meets(F.col("t") == 0))
    rows = rows.withColumn("stands_in", meets((F.col("t") == 1) & F.col("hit")))
    seeds = rows.where("t = 0").drop("hit", "stands_in")
    others = rows.where("NOT hit AND (t = 1 OR (t = 2 AND stands_in))").drop("hit", "stands_in")
    met = seeds.unionByName(others).select("row", "k", "s", "e", F.lower("value").alias("instance"), F.explode(_patterns(F.col("left"))).alias("pattern"))
    met = stage(met, "pii-met")
    supported = stage(met.where(F.col("k") >= 0).select("pattern", "instance").distinct().groupBy("pattern").agg(F.count("*").alias("n"))
                      .where(F.col("n") >= min_support).select("pattern"), "pii-patterns")
    graph = stage(met.join(supported, "pattern").groupBy("pattern", "instance").agg(
        F.count("*").alias("n"), *[F.max((F.col("k") == i).cast("double")).alias(f"seed{i}") for i in range(len(KINDS))]), "pii-graph")
    seen = stage(_background(base, supported), "pii-background")
    seed = graph.groupBy("instance").agg(*[F.max(f"seed{i}").alias(f"c{i}") for i in range(len(KINDS))])
    score = seed
    for n in range(rounds):
        pattern = (graph.select("pattern", "instance", "n").join(score, "instance").groupBy("pattern")
                   .agg(F.sum("n").alias("filled"), *[F.sum(F.col("n") * F.col(f"c{i}")).alias(f"w{i}") for i in range(len(KINDS))])
                   .join(seen, "pattern", "left")
                   .select("pattern", *[(F.col(f"w{i}") / (F.greatest("filled", F.coalesce("seen", F.lit(0))) + 1)).alias(f"p{i}") for i in range(len(KINDS))]))
        pattern = stage(pattern, f"pii-round-{n}")
        miss = [(1 - F.exp(F.sum(F.log(F.greatest(1 - F.col(f"p{i}"), F.lit(1e-9)))))).alias(f"q{i}") for i in range(len(KINDS))]
        score = (graph.select("pattern", "instance").join(pattern, "pattern").groupBy("instance").agg(*miss).join(seed, "instance")
                 .select("instance", *[F.greatest(f"c{i}", F.when(F.greatest(*[F.col(f"c{j}") for j in range(len(KINDS))]) > 0, 0.0).otherwise(F.col(f"q{i}"))).alias(f"c{i}")
                                       for i in range(len(KINDS))]))
    score = stage(score, "pii-instances")
    best = F.array_max(F.array(*[F.struct(F.col(f"p{i}").alias("p"), F.col(f"c{i}").alias("c"), F.lit(i).alias("k")) for i in range(len(KINDS))]))
    new = (met.where(F.col("k") < 0).select("row", "s", "e", "instance", "pattern").join(pattern, "pattern").join(score, "instance")
           .withColumn("best", best).where((F.col("best.p") >= min_pattern) & (F.col("best.c") >= min_instance))
           .groupBy("row", "s", "e").agg(F.max("best").alias("best"))
           .groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.col("best.k").alias("k"), "s", "e"))).alias("added")))  # bounded by one text
    bare = F.transform("base", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["value"].alias("value")))
    return spans.join(new, "row", "left").select("doc_id", bare.alias("base"), F.coalesce("added", F.expr("cast(array() as array<struct<k:int,s:bigint,e:bigint>>)")).alias("added"))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined, by kind and start."""
    names = F.array(*[F.lit(k) for k in KINDS])
    short = F.array_sort(F.transform(spans, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))))
    return F.array_join(F.transform(short, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
