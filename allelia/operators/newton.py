"""Logistic regressions of all variants or groups in lockstep, for covariates, dosages and burdens of any real value."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_1_sf_sql, log10_chi2_1_sf_sql
from .logistic import logistic_null
from .phenotype import moments
from .shared import passing, table

#: Covariate patterns of a block and variants of a lane, on average: a block and a lane meet in one task.
BLOCK, LANE = 16_384, 1024
#: Variants whose probabilities are held at once, for all patterns of a block.
AT_ONCE = 64
#: Carriers of a group that a task holds as one row (groups with more take rounds over tables), and those that it steps at once.
MOST_CARRIERS, CELLS = 1024, 500_000
#: The polynomial of the zeros: its degree, its terms and the distance from the null model's logits where it is taken, at most.
DEGREE, TERMS, NEAR = 12, 1000, 0.1
#: A genotype whose information falls by this factor runs off: its carriers' fitted probabilities are 0 or 1 to six digits.
GONE = 1e-6


def _terms(coordinates, firth: bool) -> list[tuple[int, ...]]:
    """The sums of a Newton step: gradient (r), information (r, s) and, for Firth's penalty, its derivative (r, s, t)."""
    return [t for size in (1, 2, 3)[: 3 if firth else 2] for t in combinations_with_replacement(coordinates, size)]


def _name(term: tuple[int, ...]) -> str:
    return "s_" + "_".join(map(str, term))


def _blocks(people: DataFrame, z: list[str]) -> DataFrame:
    """(block, m, s, z): blocks of distinct covariate patterns as arrays, with the number of samples and of cases of each."""
    patterns = people.groupBy(*z).agg(F.count("*").cast("double").alias("m"), F.sum("y_").alias("s"))
    n_blocks = max(1, math.ceil(patterns.count() / BLOCK))
    key = F.pmod(F.xxhash64(*z), F.lit(n_blocks)) if z else F.lit(0)
    rows = patterns.groupBy(key.cast("int").alias("block")).agg(F.collect_list(F.struct("m", "s", F.array(*[F.col(c) for c in z]).cast("array<double>").alias("z"))).alias("rows"))
    return rows.select("block", "rows.m", "rows.s", F.flatten("rows.z").alias("z"))


def _zeros(group: str, kind: str, n_z: int, firth: bool):
    """The kernel and its schema: a lane's variants against a block's patterns, every sample taken as if its genotype were 0."""
    own = [0, *range(2, 2 + n_z)]
    terms = _terms(own, firth)
    first, second, third = ([t for t in terms if len(t) == k] for k in (1, 2, 3))

    def run(betas: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        names = [group, *map(_name, terms)]
        if not len(betas) or not len(block):
            return pd.DataFrame({c: [] for c in names})
        m, s = (np.asarray(block[c].iloc[0], float)[:, None] for c in ("m", "s"))
        x = np.column_stack([np.ones(len(m)), np.asarray(block["z"].iloc[0], float).reshape(len(m), n_z)])
        at = {c: i for i, c in enumerate(own)}
        product = lambda some: np.column_stack([np.prod([x[:, at[c]] for c in t], axis=0) for t in some])
        x2, x3 = product(second), product(third) if firth else None
        b = np.stack(betas["b"].to_numpy())[:, own]
        out = []
        for a in range(0, len(b), AT_ONCE):
            p = 1 / (1 + np.exp(-np.clip(x @ b[a : a + AT_ONCE].T, -700, 700)))
            w = m * p * (1 - p)
            out.append(np.vstack([x.T @ (s - m * p), x2.T @ w, *([x3.T @ (w * (1 - 2 * p))] if firth else [])]).T)
        found = pd.DataFrame(np.vstack(out), columns=names[1:])
        found.insert(0, group, betas[group].to_numpy())
        return found

    assert [len(t) for t in terms] == sorted(len(t) for t in terms) and len(first) == len(own)
    return run, ", ".join([f"`{group}` {kind}", *[f"{_name(t)} double" for t in terms]])


def _carried(k: int, firth: bool) -> tuple[dict, list]:
    """Probabilities of carriers with and without their genotype, and from these what it changes in each sum."""
    b = [F.col("b")[i] for i in range(k)]
    z = [F.col(f"z{i}_") for i in range(2, k)]
    eta = b[0]
    for beta, c in zip(b[2:], z):
        eta = eta + beta * c
    inverse = lambda e: 1.0 / (1.0 + F.exp(-e))
    probabilities = {"p0": inverse(eta), "p1": inverse(eta + b[1] * F.col("g"))}
    out = []
    for term in _terms(range(k), firth):
        z_part, g_times = F.lit(1.0), term.count(1)
        for c in term:
            if c > 1:
                z_part = z_part * F.col(f"z{c}_")
        part = []
        for p in (F.col("p1"), F.col("p0")):
            w = p * (1.0 - p)
            part.append({1: F.col("y_") - p, 2: w, 3: w * (1.0 - 2.0 * p)}[len(term)])
        g_part = F.lit(1.0)
        for _ in range(g_times):
            g_part = g_part * F.col("g")
        out.append((z_part * (g_part * part[0] - (part[1] if not g_times else F.lit(0.0)))).alias(_name(term)))
    return probabilities, out


class _Polynomial:
    """What every sample gives as if its genotype were 0, for coefficients near the null model's.

    These sums are derivatives of one function of the coefficients of the intercept and the covariates, the same for all groups: the
    negative log-likelihood. Its Taylor terms at the null model are summed over the samples once. A coefficient's change moves no logit by more
    than `reach` times it; within `near` what the polynomial leaves out is below 1e-13 a sample (the nearest pole of a logit is pi away)."""

    def __init__(self, people: DataFrame, start: np.ndarray, z: list[str], firth: bool):
        d = len(start)
        degree = next(k for k in range(DEGREE, 0, -1) if k == 1 or math.comb(d + k, k) <= TERMS)
        self.start, self.own = np.asarray(start, float), [0, *range(2, 1 + d)]
        self.near = min(NEAR, (1e-13 * math.pi ** (degree + 1) / (2 * degree)) ** (1 / (degree - 1))) if degree > 3 else 0.0
        self.terms = _terms(self.own, firth)
        self.powers = sorted((p for p in product(range(degree + 1), repeat=d) if sum(p) <= degree), key=lambda p: (sum(p), p)) if degree > 3 else [(0,) * d]
        top = people.agg(*[F.max(F.abs(c)).alias(c) for c in z]).first() if z else ()
        self.reach = np.array([1.0, *top])
        place = {p: t for t, p in enumerate(self.powers)}
        sums = self._sums(people, z, degree)
        self.weights = np.zeros((len(self.powers), len(self.terms)))
        for t, term in enumerate(self.terms):
            for p, at in place.items():
                up, times = list(p), 1.0
                for c in term:
                    up[self.own.index(c)] += 1
                    times *= up[self.own.index(c)]
                if tuple(up) in place:
                    self.weights[at, t] = times * sums[place[tuple(up)]] * (-1 if len(term) == 1 else 1)

    def _parents(self) -> list[tuple[int, int]]:
        """For each power but the first, the place of one a degree lower and the coordinate that it lacks."""
        place = {p: t for t, p in enumerate(self.powers)}
        down = lambda p, c: place[(*p[:c], p[c] - 1, *p[c + 1 :])]
        return [(down(p, c), c) for p in self.powers[1:] for c in [next(c for c, e in enumerate(p) if e)]]

    def _monomials(self, x: np.ndarray) -> np.ndarray:
        """(power, row) of x(row, coordinate)."""
        out = np.ones((len(self.powers), len(x)))
        for t, (low, c) in enumerate(self._parents(), 1):
            np.multiply(out[low], x[:, c], out=out[t])
        return out

    def _sums(self, people: DataFrame, z: list[str], degree: int) -> np.ndarray:
        slopes = [np.polynomial.Polynomial([0, 1])]  # derivatives of the logistic function as polynomials in its value
        while len(slopes) < degree:
            slopes.append(slopes[-1].deriv() * np.polynomial.Polynomial([0, 1, -1]))
        order = np.array([sum(p) for p in self.powers])
        factor = np.array([math.prod(math.factorial(e) for e in p) for p in self.powers], float)

        def run(batches):
            total = np.zeros(len(self.powers))
            for batch in batches:
                columns = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                for k in range(0, len(columns), 4096):
                    y, x = columns[k : k + 4096, 0], np.column_stack([np.ones(len(columns[k : k + 4096])), columns[k : k + 4096, 1:]])
                    p = 1 / (1 + np.exp(-np.clip(x @ self.start, -700, 700)))
                    held = np.stack([np.zeros(len(p)), p - y, *[f(p) for f in slopes[1:]]])
                    total += np.einsum("tn,tn->t", self._monomials(x), held[order])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "value"])

        out = np.zeros(len(self.powers))
        for r in people.select("y_", *z).mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
            out[r.place] = r.value
        return out / factor

    def is_near(self, b: np.ndarray) -> np.ndarray:
        return np.abs(b[:, self.own] - self.start) @ self.reach <= self.near

    def is_near_sql(self):
        moved = [F.abs(F.col("b")[c] - float(self.start[i])) * float(self.reach[i]) for i, c in enumerate(self.own)]
        return sum(moved[1:], moved[0]) <= self.near

    def zeros(self, b: np.ndarray) -> np.ndarray:
        """(row, term) at coefficients b(row, coordinate) that are near."""
        return np.concatenate([self._monomials(b[k : k + 2048, self.own] - self.start).T @ self.weights for k in range(0, len(b), 2048)]) if len(b) else np.zeros((0, len(self.terms)))

    def rows(self, group: str):
        """zeros() of a table of coefficients, with the columns of _zeros."""

        def run(batches):
            for frame in batches:
                if len(frame):
                    found = pd.DataFrame(self.zeros(np.stack(frame["b"].to_numpy())), columns=list(map(_name, self.terms)))
                    found.insert(0, group, frame[group].to_numpy())
                    yield found

        return run


def _step(sums: dict, b: np.ndarray, first: np.ndarray, firth: bool) -> tuple[np.ndarray, ...]:
    """Newton's step of each row from its sums by term: new coefficients, the genotype's information at first, its variance, whether the row
    is fitted, and whether it stays open."""
    n, k = b.shape
    u, info, slope = np.zeros((n, k)), np.zeros((n, k, k)), np.zeros((n, k, k, k) if firth else (0,))
    for t, v in sums.items():
        if len(t) == 1:
            u[:, t[0]] = v
        elif len(t) == 2:
            info[:, t[0], t[1]] = info[:, t[1], t[0]] = v
        else:
            r, s, q = t
            for i, j, l in {(r, s, q), (r, q, s), (s, r, q), (s, q, r), (q, r, s), (q, s, r)}:
                slope[:, i, j, l] = v
    good = np.isfinite(info).all((1, 2)) & np.isfinite(u).all(1)
    # scaled to a unit diagonal, so that the scale of a dosage or a burden doesn't count as collinearity
    root = np.sqrt(np.maximum(np.einsum("nii->ni", info), 1e-300))
    scaled = np.where(good[:, None, None], info / root[:, :, None] / root[:, None, :], np.eye(k))
    good &= np.linalg.cond(scaled) < 1e12
    scaled[~good] = np.eye(k)
    inverse = np.linalg.inv(scaled) / root[:, :, None] / root[:, None, :]
    if firth:
        u = u + 0.5 * np.einsum("nst,nrst->nr", inverse, slope)
    step = np.einsum("nij,nj->ni", inverse, np.where(good[:, None], u, 0.0))
    most = np.abs(step * root).max(1) / np.maximum(root.max(1), 1e-300)
    step *= np.minimum(1.0, 5 / np.maximum(np.abs(step).max(1), 1e-300))[:, None]
    first = np.where(np.isnan(first), info[:, 1, 1], first)
    good &= info[:, 1, 1] > GONE * first
    fitted = good & (most < (1e-8 if firth else 1e-6))  # a plain step squares the error, a penalised one shrinks it by a factor
    return b + step, first, np.where(good, inverse[:, 1, 1], np.nan), fitted, good & ~fitted


def _steps(group: str, k: int, firth: bool):
    """_step of a table of sums."""
    terms = _terms(range(k), firth)

    def run(batches):
        for frame in batches:
            if len(frame):
                found = _step({t: frame[_name(t)].to_numpy(float) for t in terms}, np.stack(frame["b"].to_numpy()).astype(float), frame["first"].to_numpy(float), firth)
                yield pd.DataFrame({group: frame[group].to_numpy(), "b": list(found[0]), **dict(zip(("first", "variance", "fitted", "open"), found[1:]))})

    return run


def _fit(cells: np.ndarray, counts: np.ndarray, begin: np.ndarray, near: _Polynomial, firth: bool, rounds: int) -> tuple[np.ndarray, ...]:
    """(b, variance, fitted, far) of groups whose carriers (g, y, z) lie one group after another: all their Newton steps. Those
    that leave the polynomial's reach are far, and not fitted."""
    n, k = len(counts), len(begin)
    b, first, variance = np.tile(begin, (n, 1)), np.full(n, np.nan), np.full(n, np.nan)
    fitted, far, rows = np.zeros(n, bool), np.zeros(n, bool), np.arange(n)
    for _ in range(rounds):
        away = ~near.is_near(b[rows])
        far[rows[away]] = True
        stay = ~away
        if not stay.all():
            cells, counts, rows = cells[np.repeat(stay, counts)], counts[stay], rows[stay]
        if not len(rows):
            break
        g, y = cells[:, 0], cells[:, 1]
        x = np.column_stack([np.ones(len(g)), g, cells[:, 2:]])
        own = np.repeat(b[rows], counts, 0)
        with_g = np.einsum("nk,nk->n", x, own)
        parts = []
        for eta in (with_g, with_g - own[:, 1] * g):
            p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
            w = p * (1 - p)
            parts.append({1: y - p, 2: w, 3: w * (1 - 2 * p)})
        starts = np.cumsum(counts) - counts
        sums = {}
        for t in _terms(range(k), firth):
            change = parts[0][len(t)] if 1 in t else parts[0][len(t)] - parts[1][len(t)]
            for c in t:
                if c:
                    change = change * x[:, c]
            sums[t] = np.add.reduceat(change, starts)
        for t, v in zip(near.terms, near.zeros(b[rows]).T):
            sums[t] = sums[t] + v
        b[rows], first[rows], variance[rows], fitted[rows], still_open = _step(sums, b[rows], first[rows], firth)
        if not still_open.all():
            cells, counts, rows = cells[np.repeat(still_open, counts)], counts[still_open], rows[still_open]
    return b, variance, fitted, far


def _whole(group: str, begin: np.ndarray, near: _Polynomial, firth: bool, rounds: int):
    """_fit of rows (group, cells)."""

    def run(batches):
        for whole in batches:
            lists = whole.column("cells")
            counts = lists.value_lengths().to_numpy(zero_copy_only=False)
            bins = (np.cumsum(counts) - counts) // CELLS
            edges = [0, *(np.flatnonzero(np.diff(bins)) + 1).tolist(), len(counts)]
            for a, e in zip(edges, edges[1:]):
                if a == e:
                    continue
                flat = lists.slice(a, e - a).flatten().flatten()
                cells = np.column_stack([c.to_numpy(zero_copy_only=False) for c in flat])
                b, variance, fitted, far = _fit(cells, counts[a:e], begin, near, firth, rounds)
                yield pa.RecordBatch.from_arrays([whole.column(group).slice(a, e - a), pa.array(list(b), pa.list_(pa.float64())), pa.array(variance), pa.array(fitted), pa.array(far)], names=[group, "b", "variance", "fitted", "far"])

    return run


def regress(calls: DataFrame, samples: DataFrame, y: str, covariates: list[str], firth: bool = False, group: str = "variant_id", rounds: int = 40) -> DataFrame:
    """(group, beta, se, pvalue, log10p): Wald test of the genotype, dosage or burden g in a logistic regression of y in {0, 1}
    on it, an intercept and covariates; with firth under the penalised likelihood. Missing calls are at the mean.

    What all samples give as if their genotypes were 0 is a polynomial near the null model, so a step costs a group its carriers rather
    than all samples. Groups of up to MOST_CARRIERS are fitted by one task each. The rest, and groups that leave the
    polynomial's reach, take their Newton steps together: coefficients are a table; a round is one aggregation by group of its gradient
    and information (and, with firth, the information's derivative, from which the penalty follows): carriers give what their
    genotype changes, in SQL functions, and for groups beyond the polynomial blocks of distinct covariate patterns give the rest, each block
    meeting a lane of groups in one task. Groups that are fitted or can't be leave before the next round.

    Samples that lack the trait or a covariate take no part. beta and the rest are null where there is no finite estimate: the
    genotype doesn't vary or is a combination of the covariates, carriers are all cases or all controls (without firth) or are told apart by
    the covariates, y has one value
    only, or `rounds` rounds don't end. Covariates without variance take no part. No calls give no rows."""
    spark, kind = calls.sparkSession, dict(calls.dtypes)[group]
    people = samples.select("sample_id", F.col(y).cast("double").alias("y_"), *[F.col(c).cast("double").alias(f"in{i}_") for i, c in enumerate(covariates)]).dropna()
    names = [f"in{i}_" for i in range(len(covariates))]
    n, m = moments(people, [*names, "y_"])
    if not 0 < m[0, -1] < n:
        none = [F.lit(None).cast("double").alias(c) for c in ("beta", "se", "pvalue", "log10p")]
        return calls.select(group).distinct().select(group, *none)
    mean, sd = m[0, 1:-1] / n, np.sqrt(np.maximum(np.diag(m)[1:-1] / n - (m[0, 1:-1] / n) ** 2, 0))
    varies = [i for i in range(len(names)) if sd[i] > 1e-9 * max(1.0, abs(mean[i]))]
    k, z = 2 + len(varies), [f"z{j}_" for j in range(2, 2 + len(varies))]
    people = people.select("sample_id", "y_", *[((F.col(names[i]) - float(mean[i])) / float(sd[i])).alias(c) for i, c in zip(varies, z)])
    start, _ = logistic_null(people, "y_", z)
    with passing(spark) as make:
        people = make(people, "people")
        near = _Polynomial(people, start, z, firth)
        rows = calls.select(group, "sample_id", F.col("g").cast("double").alias("g")).join(people.withColumn("known", F.lit(True)), "sample_id", "left")
        rows = make(rows.select(group, "g", "y_", *z, F.col("known").isNotNull().alias("known")), "rows")
        known, gone = F.col("known"), F.col("known") & F.col("g").isNull()
        carries = known & (F.col("g") != 0)
        about = rows.groupBy(group).agg(
            F.coalesce(F.sum(F.when(known, F.col("g"))), F.lit(0.0)).alias("s_"), F.sum(F.when(gone, 1.0).otherwise(0.0)).alias("gone_"), F.sum(F.when(gone, F.col("y_")).otherwise(0.0)).alias("gone_cases_"),
            F.sum(F.when(carries, 1.0).otherwise(0.0)).alias("n_"), F.sum(F.when(carries, F.col("y_")).otherwise(0.0)).alias("cases_"), F.min(F.when(carries, F.col("g"))).alias("lo_"), F.max(F.when(carries, F.col("g"))).alias("hi_"),
        )
        about = about.withColumn("mean_", F.coalesce(F.col("s_") / F.nullif(float(n) - F.col("gone_"), F.lit(0.0)), F.lit(0.0)))
        filled = (F.col("gone_") > 0) & (F.col("mean_") != 0)  # missing calls at a mean that isn't 0 are carriers too
        about = about.select(
            group, "mean_", (F.col("n_") + F.when(filled, F.col("gone_")).otherwise(0.0)).alias("n_"), (F.col("cases_") + F.when(filled, F.col("gone_cases_")).otherwise(0.0)).alias("cases_"),
            F.least("lo_", F.when(filled, F.col("mean_"))).alias("lo_"), F.greatest("hi_", F.when(filled, F.col("mean_"))).alias("hi_"),
        )
        one_sided = (F.col("cases_") == 0) | (F.col("cases_") == F.col("n_"))
        still = (F.col("n_") == 0) | ((F.col("n_") == n) & (F.col("lo_") == F.col("hi_")))
        about = make(about.select(group, "mean_", "n_", (~still if firth else ~still & ~one_sided).alias("open")), "about")
        begin = [float(v) for v in (start[0], 0.0, *start[1:])]

        def carriers(groups: DataFrame) -> DataFrame:
            own = rows.where("known").join(groups.select(group, "mean_"), group)
            return own.select(group, F.coalesce("g", "mean_").alias("g"), "y_", *z).where("g != 0")

        columns = [group, "b", "variance", "fitted"]
        lacking = F.lit(None).cast("double")
        done = about.where("NOT open").select(group, F.array(*map(F.lit, begin)).alias("b"), lacking.alias("variance"), F.lit(False).alias("fitted"))
        small = about.where(F.col("open") & (F.col("n_") <= (MOST_CARRIERS if near.near else 0)))
        lists = carriers(small).groupBy(group).agg(F.collect_list(F.struct("g", "y_", *z)).alias("cells"))
        whole = make(lists.mapInArrow(_whole(group, np.array(begin), near, firth, rounds), f"`{group}` {kind}, b array<double>, variance double, fitted boolean, far boolean"), "whole")
        done = done.unionByName(whole.where("NOT far").select(columns))
        left = about.where("open").join(whole.where("NOT far").select(group), group, "left_anti")
        state = make(left.select(group, "mean_", F.array(*map(F.lit, begin)).alias("b"), lacking.alias("first"), lacking.alias("variance"), F.lit(False).alias("fitted"), "open"), "round0")
        schema = f"`{group}` {kind}, b array<double>, first double, variance double, fitted boolean, open boolean"
        kernel, zero_schema = _zeros(group, kind, len(z), firth)
        probabilities, parts = _carried(k, firth)  # columns are built once for all rounds
        terms = _terms(range(k), firth)
        padded = [F.lit(0.0).alias(_name(t)) if 1 in t else F.col(_name(t)) for t in terms]
        totals = [F.sum(_name(t)).alias(_name(t)) for t in terms]
        held = blocks = None
        for r in range(1, rounds + 1):
            waiting = state.where("open").select(group, "b", "first")
            n_open = waiting.count()
            if not n_open:
                break
            if held is None:
                held = make(carriers(state), "carriers")
            n_far = waiting.where(~near.is_near_sql()).count()
            zeros = waiting.where(near.is_near_sql()).select(group, "b").mapInPandas(near.rows(group), zero_schema)
            if n_far:
                if blocks is None:
                    blocks = make(_blocks(people, z), "blocks")
                    n_blocks = blocks.count()
                lanes = math.ceil(n_far / LANE)
                lane = F.pmod(F.xxhash64(F.col(group)), F.lit(lanes)).cast("int").alias("lane")
                left = waiting.where(~near.is_near_sql()).select(group, "b", lane, F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
                right = blocks.select("block", "m", "s", "z", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
                zeros = zeros.unionByName(left.groupBy("lane", "block").cogroup(right.groupBy("lane", "block")).applyInPandas(kernel, zero_schema))
            zeros = zeros.select(group, *padded)
            changes = held.join(waiting, group).withColumns(probabilities).select(group, *parts)
            sums = zeros.unionByName(changes).groupBy(group).agg(*totals)
            state = make(waiting.join(sums, group).mapInPandas(_steps(group, k, firth), schema), f"round{r}")
            done = done.unionByName(state.where("NOT open").select(columns))
        else:
            done = done.unionByName(state.where("open").select(columns))  # not fitted within the rounds
        good = F.col("fitted") & (F.col("variance") > 0)
        out = done.select(group, F.when(good, F.col("b")[1]).alias("beta"), F.when(good, F.sqrt("variance")).alias("se")).withColumn("t_", (F.col("beta") / F.col("se")) ** 2)
        return table(out.withColumns({"pvalue": F.expr(chi2_1_sf_sql("t_")), "log10p": F.expr(log10_chi2_1_sf_sql("t_"))}).drop("t_"), "newton")
