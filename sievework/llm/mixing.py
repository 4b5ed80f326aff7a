"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "(other)"
# The raking table has one cell for each combination of the listed categories.
MAX_CELLS = 1_000_000
TRIM = 1e6
# A document is taken at most this often unless the caller says otherwise.
MOST_COPIES = 8.0


def word_count(text: Column) -> Column:
    """Words between ASCII white space: the tokens of a document where no count column is given."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from the form of the whole text: license, table, numeric, shouting, dialogue or prose.

    The first that holds: a license phrase; a bar between spaces; four digits in a row; three
    capitals in a row; a question mark; else prose. Null texts are prose.
    """
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.rlike("(?i)licen[sc]ed|license|copyright"), "license").when(t.contains(" | "), "table")
        .when(t.rlike("[0-9]{4}"), "numeric").when(t.rlike(r"\p{Lu}{3}"), "shouting").when(t.contains("?"), "dialogue").otherwise("prose")
    )


def category(value: Column, targets: Mapping[str, float]) -> Column:
    """The value if targets list it, else (null included) OTHER."""
    return F.coalesce(F.when(value.isin(*targets), value), F.lit(OTHER))


def rake(
    mass: np.ndarray, targets: list[np.ndarray], tolerance: float = 1e-12, max_sweeps: int = 10_000, most: float = TRIM,
) -> np.ndarray:
    """Weights w, at most `most`, so that mass * w has the target sum along each axis; the total stays.

    A target of a category without mass is shared among the others; categories with mass but target
    zero get weight 0. A weight is the product of one factor for each axis, cut at `most`; factors keep
    their size beyond the cut, so the cells below it take over what the cut ones cannot give. Where empty
    cells or cut weights keep the marginals from being met together, the sweeps end once they no longer
    come nearer; `report` shows the shares reached.
    """
    total = mass.sum()
    if total == 0:
        return np.ones_like(mass)
    wanted = []
    for axis, t in enumerate(targets):
        present = _marginal(mass, axis) > 0
        kept = np.where(present, t, 0.0)
        if kept.sum() <= 0:
            raise ValueError("no category with a target above zero has mass")
        wanted.append(kept / kept.sum() * total)
    factors = [np.ones(n) for n in mass.shape]

    def product() -> np.ndarray:
        w = np.ones_like(mass)
        for axis, f in enumerate(factors):
            w = w * f.reshape([-1 if i == axis else 1 for i in range(mass.ndim)])
        return np.where(w > 0, np.clip(w, 1 / TRIM, most), 0.0)

    before = math.inf
    for sweep in range(1, max_sweeps + 1):
        worst = 0.0
        for axis, want in enumerate(wanted):
            have = _marginal(mass * product(), axis)
            factor = np.divide(want, have, out=np.ones_like(want), where=have > 0)
            worst = max(worst, float(np.abs(want - have).max() / total))
            factors[axis] = np.where(factor > 0, np.clip(factors[axis] * factor, 1 / TRIM**2, TRIM**2), 0.0)
        if worst < tolerance:
            break
        if sweep % 100 == 0:
            if worst > 0.999 * before:
                break
            before = worst
    return product()


def _marginal(mass: np.ndarray, axis: int) -> np.ndarray:
    return mass.sum(axis=tuple(i for i in range(mass.ndim) if i != axis))


def calibrate(mass: np.ndarray, weights: np.ndarray, share: float, most: float = 1.0) -> float:
    """c with sum(mass * min(most, c * weights)) = share * sum(mass); infinite if only the cut reaches it."""
    m, w = mass[(mass > 0) & (weights > 0)], weights[(mass > 0) & (weights > 0)]
    order = np.argsort(-w)
    m, w = m[order], w[order]
    want = share * mass.sum()
    full = np.concatenate([[0.0], np.cumsum(m)]) * most
    rest = np.concatenate([np.cumsum((m * w)[::-1])[::-1], [0.0]])
    for capped in range(len(m)):
        c = (want - full[capped]) / rest[capped]
        if c * w[capped] <= most * (1 + 1e-9):
            return max(0.0, c)
    return math.inf


def unit_hash(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) from the first 12 hex digits of an MD5 of the seed and the columns' text."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def mix(
    docs: DataFrame, targets: Mapping[str, Mapping[str, float]], share: float, columns: Mapping[str, Column] | None = None,
    tokens: Column | None = None, id_col: str = "doc_id", seed: int = 5, most: float = MOST_COPIES,
) -> DataFrame:
    """Every row with its cell, `_tokens`, `_weight`, `_probability`, `_copies` and whether it is `_sampled`.

    targets: for each dimension (two or more), the target share of tokens for listed categories; what
    is not listed, null included, is the category OTHER with its own share of tokens. columns: the
    column of each dimension (the one of its name if not given). Token weights are raked to all
    target marginals at once; rate = c * weight, with c so that the expected tokens are `share` of all.
    A row is taken floor(rate) times, and once more if a hash of its id and cell falls below the rest,
    so a category scarcer than its target is repeated and the sample has the raked shares in expectation.
    Its probability to be sampled at all is min(1, rate). No rate exceeds `most`, a bound on repeats that
    raking works under; `report` gives target, raked and sampled shares. Repeated rows of an id share
    their fate and a rerun samples the same rows.

    The cells are the product of the listed categories and OTHER, so the one table that reaches the
    driver has a size fixed by the arguments (an error above MAX_CELLS), whatever the number of rows.
    Cases: documents without a token weigh nothing and take their cell's p (a cell without mass has
    weight 1); null ids hash like an empty text; an empty table gives no rows. Helper columns start
    with an underscore and replace columns of that name.
    """
    dims = list(targets)
    size = math.prod(len(targets[d]) + 1 for d in dims)
    if size > MAX_CELLS:
        raise ValueError(f"{size} cells; list fewer categories")
    columns = columns or {}
    named = {f"_cell_{d}": category(columns.get(d, F.col(d)), targets[d]) for d in dims}
    marked = docs.withColumns({**named, "_tokens": tokens if tokens is not None else word_count(F.col("text"))})
    cells = marked.groupBy(*named).agg(F.sum("_tokens").alias("mass")).collect()
    lists = [[*targets[d], OTHER] for d in dims]
    mass = _cell_masses(cells, dims, lists, "mass")
    weights = rake(mass, _goals(mass, targets), most=most / share)
    c = calibrate(mass, weights, share, most)
    with np.errstate(invalid="ignore"):
        rate = np.where(weights > 0, np.minimum(most, c * weights), 0.0)
    table = [
        (*[names[i] for names, i in zip(lists, at)], float(weights[at]), float(rate[at]))
        for at in (tuple(names.index(row[f"_cell_{d}"]) for d, names in zip(dims, lists)) for row in cells)
    ]
    schema = ", ".join([*[f"_cell_{d} string" for d in dims], "_weight double", "_rate double"])
    found = F.broadcast(docs.sparkSession.createDataFrame(table, schema))  # at most MAX_CELLS rows
    joined = marked.drop("_weight", "_rate", "_probability", "_copies", "_sampled").join(found, list(named))
    draw = unit_hash(seed, F.col(id_col), *[F.col(n) for n in named])
    copies = F.floor("_rate") + (draw < F.col("_rate") - F.floor("_rate")).cast("long")
    return joined.withColumns({"_probability": F.least(F.lit(1.0), F.col("_rate")), "_copies": copies}).withColumn("_sampled", F.col("_copies") > 0).drop("_rate")


def _cell_masses(cells: list, dims: list[str], lists: list[list[str]], name: str) -> np.ndarray:
    out = np.zeros([len(x) for x in lists])
    for row in cells:
        out[tuple(names.index(row[f"_cell_{d}"]) for d, names in zip(dims, lists))] = float(row[name] or 0)
    return out


def _goals(mass: np.ndarray, targets: Mapping[str, Mapping[str, float]]) -> list[np.ndarray]:
    """Target shares of each axis: OTHER keeps its own share, the listed categories with mass divide the rest."""
    total, goals = mass.sum(), []
    for axis, wanted in enumerate(targets.values()):
        own = _marginal(mass, axis)
        rest = own[-1] / total if total else 0.0
        listed = np.where(own[:-1] > 0, [float(x) for x in wanted.values()], 0.0)
        goals.append(np.append(listed / (listed.sum() or 1.0) * (1 - rest), rest))
    return goals


def report(mixed: DataFrame, targets: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """(dimension, category, own, target, raked, sampled): shares of tokens in the rows of `mix`.

    own is the share before mixing; sampled counts every copy. Categories without mass have
    target zero; where targets cannot be met together, raked and target differ. An empty table,
    and a sample without tokens, give zeros. Only the cell table reaches the driver.
    """
    dims = list(targets)
    t = F.col("_tokens")
    cells = mixed.groupBy(*[f"_cell_{d}" for d in dims]).agg(
        F.sum(t).alias("own"), F.sum(t * F.col("_weight")).alias("raked"), F.sum(t * F.col("_copies")).alias("sampled")).collect()
    lists = [[*targets[d], OTHER] for d in dims]
    parts = {n: _cell_masses(cells, dims, lists, n) for n in ("own", "raked", "sampled")}
    rows = []
    for axis, (d, goal) in enumerate(zip(dims, _goals(parts["own"], targets))):
        shares = {n: _marginal(m, axis) / (m.sum() or 1.0) for n, m in parts.items()}
        for i, name in enumerate(lists[axis]):
            rows.append((d, name, float(shares["own"][i]), float(goal[i]), float(shares["raked"][i]), float(shares["sampled"][i])))
    return mixed.sparkSession.createDataFrame(rows, "dimension string, category string, own double, target double, raked double, sampled double")


# Shares of tokens that the registered queries ask for; categories not listed keep their own share.
TARGETS = {
    "source": {"src0": 0.15, **{f"src{i}": 0.85 / 19 for i in range(1, 20)}},
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.18, "es": 0.12},
    "topic": {"prose": 0.6, "license": 0.05, "table": 0.05, "numeric": 0.25, "shouting": 0.04, "dialogue": 0.01},
}
SHARE = 0.6


def mixed_documents(docs: DataFrame, share: float = SHARE, seed: int = 5) -> DataFrame:
    """`mix` of documents (text, source, lang) to TARGETS with the topics of `topic_of`."""
    return mix(docs, TARGETS, share, {"topic": topic_of(F.col("text"))}, seed=seed)
