"""Least squares in one aggregate (M11, M19, M21): all responses from one Gram matrix.

Every row has a few non-zero design slots: the intercept, one level of each
factor (the last level is the base and has no slot) and the numeric terms.  The
products of these slots, pair by pair, are summed in one grouped aggregate (map-side
combined, so at most tasks x pairs rows are shuffled), together with the products
with every response.  Such sums merge: Gram tables of parts of the data add up
to the table of the whole (:func:`merge_gram`), so a fit can be kept up to date
without the old rows.  The table has slots^2 / 2 rows, a size set by the factors,
and is solved on the driver; nothing else is collected.

Defined cases: a row with a null response takes no part in that response's fit,
one with a null factor or term in none; a level not known at the fit predicts
null; a rank-deficient design gets the minimum-norm solution; a response without
rows gets null coefficients; more slots than ``max_slots`` raise (hash wide
factors instead, see ``hubcast.ml.hashed``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubcast.session import cut_lineage


@dataclass(frozen=True)
class Design:
    """Factors with their ordered levels (the last one is the base) and numeric terms."""
    factors: dict[str, list]
    numerics: list[str]

    @property
    def terms(self) -> list[tuple[str, object]]:
        """(column, level) of every slot: the intercept, factor levels, numeric terms."""
        return ([("(intercept)", None)] + [(f, level) for f, levels in self.factors.items() for level in levels[:-1]]
                + [(c, None) for c in self.numerics])

    def slots(self) -> Column:
        """Non-zero slots of a row as (slot, value), in slot order; null if a factor or term is null or unknown."""
        known, out, at = F.lit(True), [F.struct(F.lit(0).alias("i"), F.lit(1.0).alias("x"))], 1
        for f, levels in self.factors.items():
            index = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(f)).cast("int")
            known = known & (F.coalesce(index, F.lit(0)) > 0)
            out.append(F.struct((index + F.lit(at - 1)).alias("i"), F.when(index < len(levels), F.lit(1.0)).alias("x")))
            at += len(levels) - 1
        for c in self.numerics:
            known = known & F.col(c).isNotNull()
            out.append(F.struct(F.lit(at).alias("i"), F.col(c).cast("double").alias("x")))
            at += 1
        return F.when(known, F.filter(F.array(*out), lambda s: s["x"].isNotNull()))


def observed_design(df: DataFrame, factors: list[str], numerics: list[str], max_slots: int = 2000) -> Design:
    """Levels as the formula stages order them: text by falling frequency (ties by name), numbers by value."""
    kinds = dict(df.dtypes)
    levels = {}
    for f in factors:
        counted = df.where(F.col(f).isNotNull()).groupBy(f).agg(F.count(F.lit(1)).alias("n"))
        order = [F.desc("n"), F.col(f)] if kinds[f] == "string" else [F.col(f)]
        levels[f] = [r[f] for r in counted.orderBy(*order).limit(max_slots + 1).collect()]
    if sum(map(len, levels.values())) + len(numerics) > max_slots:
        raise ValueError(f"more than {max_slots} design slots")
    return Design(levels, list(numerics))


def gram_table(df: DataFrame, design: Design, responses: list[str]) -> DataFrame:
    """(i, j, and for each response n_, x_, y_, q_): sums of 1, of slot products, of slot times response (rows with
    i = 0) and of the squared response (i = j = 0), over the rows where the response is known."""
    s = F.col("_s")
    pairs = F.flatten(F.transform(s, lambda a: F.transform(F.filter(s, lambda b: b["i"] >= a["i"]), lambda b: F.struct(
        a["i"].alias("i"), b["i"].alias("j"), (a["x"] * b["x"]).alias("v")))))
    rows = df.select(design.slots().alias("_s"), *[F.col(r).cast("double").alias(r) for r in responses]).where("_s IS NOT NULL")
    cells = rows.select(F.explode(pairs).alias("_p"), *responses).select("_p.i", "_p.j", "_p.v", *responses)
    sums = []
    for r in responses:
        known = F.col(r).isNotNull()
        sums += [F.count_if(known).alias(f"n_{r}"), F.sum(F.when(known, F.col("v"))).alias(f"x_{r}"),
                 F.sum(F.when(F.col("i") == 0, F.col("v") * F.col(r))).alias(f"y_{r}"),
                 F.sum(F.when((F.col("i") == 0) & (F.col("j") == 0), F.col(r) * F.col(r))).alias(f"q_{r}")]
    return cells.groupBy("i", "j").agg(*sums)


def merge_gram(*tables: DataFrame) -> DataFrame:
    """The Gram table of the union of the tables' rows (same design and responses)."""
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)
    return both.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in both.columns if c not in ("i", "j")])


@dataclass
class LinearFit:
    """Coefficients of every response on one design, with the usual summary figures."""
    design: Design
    coefficients: dict[str, list[float] | None]
    summary: dict[str, dict] = field(default_factory=dict)   # n, r2, rmse, and standard errors where they exist

    def formula(self, response: str) -> str:
        """The linear form as a SQL expression (null for unknown levels)."""
        beta = self.coefficients[response]
        if beta is None:
            return "CAST(NULL AS DOUBLE)"
        lit = lambda x: f"CAST('{float(x)!r}' AS DOUBLE)"
        value = lambda v: "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else repr(v)
        out, at = [lit(beta[0])], 1
        for f, levels in self.design.factors.items():
            whens = [f"WHEN {value(v)} THEN {lit(beta[at + k]) if k < len(levels) - 1 else lit(0)}" for k, v in enumerate(levels)]
            out.append(f"CASE `{f}` {' '.join(whens)} END")
            at += len(levels) - 1
        for c in self.design.numerics:
            out.append(f"{lit(beta[at])} * `{c}`")
            at += 1
        return " + ".join(out)

    def stage(self, response: str, output: str | None = None) -> SQLTransformer:
        """The model of one response as a pipeline stage: adds ``p_<response>``; saved and streamed like any other."""
        return SQLTransformer(statement=f"SELECT *, {self.formula(response)} AS {output or 'p_' + response} FROM __THIS__")

    def predict(self, frame: DataFrame, responses: list[str] | None = None) -> DataFrame:
        return frame.withColumns({f"p_{r}": F.expr(self.formula(r)) for r in responses or list(self.coefficients)})

    def table(self, spark) -> DataFrame:
        """response, term, level, coefficient: one row per slot and response."""
        rows = [(r, term, None if level is None else str(level), None if beta is None else float(beta[k]))
                for r, beta in self.coefficients.items() for k, (term, level) in enumerate(self.design.terms)]
        return spark.createDataFrame(rows, "response string, term string, level string, coefficient double")


def solve_gram(table: DataFrame, design: Design, responses: list[str]) -> LinearFit:
    """Normal equations of every response from its Gram sums (slots^2 / 2 rows are collected)."""
    p = len(design.terms)
    rows = table.collect()
    betas, summary = {}, {}
    for r in responses:
        xx, xy, n, yy = np.zeros((p, p)), np.zeros(p), 0, 0.0
        for c in rows:
            i, j = c["i"], c["j"]
            xx[i, j] = xx[j, i] = c[f"x_{r}"] or 0.0
            if i == 0:
                xy[j] = c[f"y_{r}"] or 0.0
                if j == 0:
                    n, yy = c[f"n_{r}"], c[f"q_{r}"] or 0.0
        if not n:
            betas[r], summary[r] = None, {"n": 0}
            continue
        # Unit diagonal first: terms of different size do not spoil the condition.
        scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
        scaled = xx / np.outer(scale, scale)
        full = np.linalg.matrix_rank(scaled, hermitian=True) == p
        beta = (np.linalg.solve(scaled, xy / scale) if full else np.linalg.lstsq(scaled, xy / scale, rcond=None)[0]) / scale
        rss = max(float(yy - 2 * beta @ xy + beta @ xx @ beta), 0.0)
        tss = float(yy - xy[0] ** 2 / n)
        summary[r] = {"n": n, "rmse": float(np.sqrt(rss / n)), "r2": 1 - rss / tss if tss > 0 else None}
        if full and n > p:
            inverse = np.linalg.inv(scaled) / np.outer(scale, scale)
            summary[r]["std_errors"] = np.sqrt(np.maximum(np.diag(inverse), 0) * rss / (n - p)).tolist()
        betas[r] = beta.tolist()
    return LinearFit(design, betas, summary)


def fit_gram(df: DataFrame, responses: list[str], factors: list[str], numerics: list[str] = (), design: Design | None = None) -> LinearFit:
    """Least squares of every response on the same factors and numeric terms, from one aggregate over ``df``."""
    design = design or observed_design(df, factors, list(numerics))
    return solve_gram(cut_lineage(gram_table(df, design, list(responses))), design, list(responses))
