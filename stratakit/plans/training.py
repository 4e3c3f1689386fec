"""Cross-validation, searches, threshold selection and refit.

The fold-tagged training frame is stored once in the shared
checkpoint folder, by columns (so a lost executor recomputes from there, not from the
raw scan); a search also stores one encoded design a fold, which all candidates share, and a
ledger of evaluated candidates, from which a restarted search goes on.  Forests fit and score
pooled rows: one for every distinct (fold, class, inputs), with its number of rows and its bootstrap draws; where the inputs have
few values, the forests of all folds and candidates of a search grow together (`operators.forests`).  Per fold: fold-local caps / weights,
a fresh pipeline fit (the distributed part), and lazy validation scores.
All folds' scores are unioned and evaluated by **one** grouped metrics job;
the driver receives one row per fold.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import argmax3
from ..operators import evaluate as E
from ..operators.clean import validate_model_inputs
from ..operators.forests import Coded, Node, Packing, code_rows, grow, growable, score
from ..operators.learn import (
    DRAWN,
    PROB_COLS,
    TIMES,
    TREES_AT_ONCE,
    build_preprocessor,
    coded_forest,
    fit_forest,
    fit_multiclass,
    fit_ordinal_pair,
    forest_pools,
    forest_trees,
    make_classifier,
    ordinal_scores,
    pooled_draws,
    with_probs,
)
from ..operators.sampling import (
    balanced_weight_map,
    balanced_weights,
    interp_weight_map,
    interp_weights,
    oof_assemble,
    stratified_kfold,
    undersample_caps,
)
from ..session import fits_at_once, write_once
from .ledger import LEDGER_COLUMNS, SearchLedger, digest


def prepare_training(fit_rows: DataFrame, label: str, row_id: str, balance: str,
                     alpha: float | None, caps: dict | None, times: str | None = None
                     ) -> tuple[DataFrame, str | None]:
    """Fold-local caps or weights from the fold's own training rows.  ``times`` names the number of rows that
    each pooled row stands for; caps choose single rows and take no pooled ones."""
    if times:
        weighted, weight = class_weights(fit_rows, label, balance, alpha, times)
        return (weighted.withColumn(weight, F.col(weight) * F.col(times)), weight) if weight else (fit_rows, times)
    if balance == "downsampled":
        # stored: what is fitted on it reads it many times, and it has few of the rows
        return write_once(undersample_caps(fit_rows, label, row_id, caps or {}), "capped"), None
    if balance == "weighted":
        return balanced_weights(fit_rows, label, "__w"), "__w"
    if balance == "interpolated":
        return interp_weights(fit_rows, label, alpha, "__w"), "__w"
    if balance in ("none", None):
        return fit_rows, None
    raise ValueError(f"unknown balance {balance!r}")


def class_weights(pooled: DataFrame, label: str, balance: str, alpha: float | None, times: str) -> tuple[DataFrame, str | None]:
    """The weight of a single row, from the numbers of rows that pooled ones stand for; no name if all weigh 1."""
    if balance == "downsampled":
        raise ValueError("caps need single rows")
    if balance in ("none", None):
        return pooled, None
    counts = {r[0]: int(r[1]) for r in pooled.groupBy(label).agg(F.sum(times)).collect()}
    if balance == "weighted":
        return balanced_weights(pooled, label, "__w", counts), "__w"
    if balance == "interpolated":
        return interp_weights(pooled, label, alpha, "__w", counts), "__w"
    raise ValueError(f"unknown balance {balance!r}")


def pools_rows(cv: dict) -> bool:
    """Whether a cross-validation of these settings fits forests on pooled rows."""
    return (cv.get("kind") == "forest" and not cv.get("ordinal") and not cv.get("pre_stages") and cv.get("balance") != "downsampled"
            and forest_pools(cv.get("params")))


@dataclass
class PooledFolds:
    """Rows pooled by fold, class and inputs, the stored fold-tagged rows if asked for, and both with packed inputs."""

    packed: DataFrame
    packed_single: DataFrame | None
    packing: Packing

    @property
    def rows(self) -> DataFrame:
        return self.packing.unpack(self.packed)

    @property
    def single(self) -> DataFrame | None:
        return None if self.packed_single is None else self.packing.unpack(self.packed_single)


def pooled_folds(frame: DataFrame, categorical: list[str], numeric: list[str], forbidden: list[str], row_id: str, label: str,
                 k: int, seed: int, trees: int, single: bool = False) -> PooledFolds:
    """Rows pooled by fold, class and inputs, with the bootstrap draws of ``trees`` trees, and with ``single`` the
    stored fold-tagged rows too.  Folds and pools are dealt over packed inputs (`Packing`)."""
    inputs = [*categorical, *numeric]
    validate_model_inputs([c for c in frame.columns if c != label], forbidden, inputs)
    rows = frame.select(row_id, label, *inputs)
    packing = Packing.of(rows, inputs)
    tagged = stratified_kfold(write_once(packing.pack(rows), "packed"), label, row_id, k, seed)
    tagged = write_once(tagged, "folds") if single else tagged
    return PooledFolds(_pooled(tagged, row_id, label, trees), tagged if single else None, packing)


def _pooled(tagged: DataFrame, row_id: str, label: str, trees: int) -> DataFrame:
    kept = [c for c in tagged.columns if c not in (row_id, label, "fold")]
    return pooled_draws(tagged.withColumnRenamed(label, "label"), ["fold", "label"], kept, row_id, trees)


def _draws(pooled: DataFrame) -> list[str]:
    return [TIMES, *[c for c in pooled.columns if c.startswith(DRAWN)]]


def class_weight_map(counts: dict, balance: str, alpha: float | None) -> dict:
    """`class_weights` of the classes that ``counts`` has."""
    if balance in ("none", None):
        return {c: 1.0 for c in counts}
    if balance == "weighted":
        return balanced_weight_map(counts)
    if balance == "interpolated":
        return interp_weight_map(counts, alpha)
    raise ValueError(f"unknown balance {balance!r}")


def fold_forests(coded: Coded, settings: list[dict], k: int) -> list[list[list[Node]]]:
    """Per candidate's settings and fold, the trees of the forest that is fitted to the other folds' rows; all of them grow
    together."""
    specs = []
    for cv in settings:
        for i in range(k):
            counts = {}
            for (fold, c), n in coded.counts.items():
                counts[c] = counts.get(c, 0) + n * (fold != i)
            weights = class_weight_map({c: n for c, n in counts.items() if n}, cv.get("balance", "none"), cv.get("alpha"))
            specs.append(coded_forest(cv.get("params"), weights, i))
    grown = grow(coded, specs, DRAWN)
    return [grown[at * k:(at + 1) * k] for at in range(len(settings))]


def fold_designs(tagged: DataFrame, categorical: list[str], numeric: list[str], forbidden: list[str],
                 row_id: str, label: str, k: int, told: list[str] | None = None, folds: PooledFolds | None = None) -> list[DataFrame] | Coded:
    """One stored sparse design a fold: preprocessing fitted on the other folds' rows, applied to
    all rows.  Every candidate of a search fits and scores on it, so categories are found and
    rows encoded ``k`` times, however many candidates there are.  Pooled rows have the columns ``told`` in place of
    the row id.  ``folds``: they, packed; if their inputs have few values they are stored once for all folds, by codes."""
    kept = [c for c in tagged.columns if c not in (label, "fold")]
    validate_model_inputs(kept, forbidden, categorical + numeric)
    design = code_rows(folds.packed, folds.packing, categorical, numeric, told, TIMES) if folds else None
    if design is not None:
        design.rows = write_once(design.rows, "design-0")
        return design
    out = []
    for i in range(k):
        fitted = Pipeline(stages=build_preprocessor(categorical, numeric)).fit(tagged.where(F.col("fold") != i))
        out.append(write_once(fitted.transform(tagged).select(*(told or [row_id]), F.col(label).alias("label"), "fold", "features"), f"design-{i}"))
    return out


def cross_validate(frame: DataFrame, *, categorical: list[str], numeric: list[str],
                   forbidden: list[str], row_id: str, label: str = "label", k: int = 5,
                   seed: int = 42, kind: str = "boosted", params: dict | None = None,
                   balance: str = "none", alpha: float | None = None, caps: dict | None = None,
                   collect_oof: bool = False, name: str = "model", slug: str = "model",
                   progress: Callable[[str], None] | None = None, pre_stages: list = (),
                   ordinal: bool = False, tagged: DataFrame | None = None,
                   parallel_folds: int = 1, designs: list[DataFrame] | Coded | None = None,
                   forests: list[list[Node]] | None = None, shared: dict | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Per-fold metrics (``fold_rows`` layout + row counts) and optional OOF
    scores (every training row exactly once, finite).

    ``parallel_folds`` > 1 fits that many folds at once from driver threads
    (concurrent Spark jobs keep a large cluster busy while each fit's many
    small stages run), fewer if the executors' memory does not hold the rows that so many
    forests cache; results do not depend on it.  ``designs`` (`fold_designs` of ``tagged``)
    takes the place of the folds' own preprocessing.  Forests that can grow from pooled rows (`pools_rows`) get
    them; ``tagged`` and its ``designs`` may be pooled already (`pooled_folds`), and unless
    single scores are asked for, pooled rows are scored and counted as often as they stand for.  In a search and in what follows it,
    forests of inputs of few values grow together (`fold_forests`; ``forests`` are theirs if they have), and rows are
    scored by their codes: ``designs`` that are coded, or a dictionary ``shared``, ask for that.  ``shared`` gets the ``pooled``
    rows, for a fit on all of them."""
    from concurrent.futures import ThreadPoolExecutor

    inputs = [*categorical, *numeric]
    pools = pools_rows({"kind": kind, "ordinal": ordinal, "pre_stages": pre_stages, "balance": balance, "params": params})
    coded = designs if isinstance(designs, Coded) else None
    pools = pools and (designs is None or coded is not None or TIMES in designs[0].columns)
    pooled = folds = None
    if tagged is None and pools:
        folds = pooled_folds(frame, categorical, numeric, forbidden, row_id, label, k, seed, forest_trees(params), collect_oof)
        pooled, tagged = folds.rows, folds.single
    elif tagged is None:
        tagged = write_once(stratified_kfold(frame, label, row_id, k, seed), "folds")
    elif pools and TIMES in tagged.columns:
        pooled = tagged
    elif pools:
        validate_model_inputs([c for c in tagged.columns if c not in (label, "fold")], forbidden, inputs)
        pooled = _pooled(tagged.select(row_id, label, "fold", *inputs), row_id, label, forest_trees(params))
    tagged = pooled if tagged is None else tagged
    counted = pools and not collect_oof
    if folds and shared is not None:
        shared["pooled"] = folds
    if pools and designs is None and shared is not None and growable(params):
        packed = (folds.packed, folds.packing) if folds else (pooled, None)
        coded = code_rows(*packed, categorical, numeric, _draws(pooled), TIMES)
    if coded is not None:
        sizes = {}
        for (i, _), rows_in in coded.counts.items():
            sizes[i] = sizes.get(i, 0) + rows_in
    else:
        sized = pooled.groupBy("fold").agg(F.sum(TIMES).cast("bigint").alias("count")) if pools else tagged.groupBy("fold").count()
        sizes = {r["fold"]: r["count"] for r in sized.collect()}
    n = sum(sizes.values())
    trees_at_once = 1

    def one_fold(i: int) -> DataFrame:
        t0 = time.time()
        if progress:
            progress(f"fold {i + 1}/{k} started")
        fit_rows = tagged.where(F.col("fold") != i).drop("fold")
        valid = tagged.where(F.col("fold") == i)
        if pools:
            if designs is not None:
                design = designs[i]
                valid = design.where(F.col("fold") == i)
            else:
                fit_rows = pooled.where(F.col("fold") != i)
                encoder = Pipeline(stages=build_preprocessor(categorical, numeric)).fit(fit_rows)
                design = write_once(encoder.transform(fit_rows).select("fold", "label", *_draws(pooled), "features"), "design")
                valid = encoder.transform(pooled.where(F.col("fold") == i) if counted else valid.withColumnRenamed(label, "label"))
            train, wcol = class_weights(design.where(F.col("fold") != i), "label", balance, alpha, TIMES)
            scored = with_probs(fit_forest(train, params, wcol, trees_at_once).transform(valid)).withColumnRenamed("label", label)
        elif ordinal:
            s_model, f_model = fit_ordinal_pair(fit_rows, categorical, numeric, params, forbidden)
            scored = ordinal_scores(s_model, f_model, valid, [row_id, label, "fold"])
        elif designs is not None:
            design = designs[i]
            train, wcol = prepare_training(design.where(F.col("fold") != i).drop("fold"), "label", row_id, balance, alpha, caps)
            scored = with_probs(make_classifier(kind, wcol, **(params or {})).fit(train).transform(design.where(F.col("fold") == i)))
            scored = scored.withColumnRenamed("label", label)
        else:
            train, wcol = prepare_training(fit_rows, label, row_id, balance, alpha, caps)
            model = fit_multiclass(train, categorical, numeric, forbidden, kind, wcol, params,
                                   pre_stages)
            scored = with_probs(model.transform(valid))
        if progress:
            progress(f"fold {i + 1}/{k} fitted in {time.time() - t0:.1f}s")
        return scored.select(TIMES if counted else row_id, F.col(label).alias("y"), *PROB_COLS, "fold")

    def all_folds() -> DataFrame:
        t0 = time.time()
        if progress:
            progress(f"{k} folds started")
        grown = forests or fold_forests(coded, [{"params": params, "balance": balance, "alpha": alpha}], k)[0]
        valid = coded.rows
        if not counted:
            valid = folds.packed_single if folds else coded.packing.pack(tagged.select(row_id, label, "fold", *inputs))
            valid = valid.withColumnRenamed(label, "label")
        scored = score(valid, coded, dict(enumerate(grown)), [TIMES if counted else row_id, "label", "fold"], PROB_COLS)
        if progress:
            progress(f"{k} folds fitted in {time.time() - t0:.1f}s")
        return scored.select(TIMES if counted else row_id, F.col("label").alias("y"), *PROB_COLS, "fold")

    if coded is not None:
        pass
    elif pools:
        at_once = fits_at_once(frame.sparkSession, TREES_AT_ONCE * parallel_folds, pooled.count())
        parallel_folds = min(parallel_folds, at_once)
        trees_at_once = max(1, min(TREES_AT_ONCE, at_once // parallel_folds))
    elif parallel_folds > 1 and kind == "forest" and not ordinal:
        parallel_folds = fits_at_once(tagged.sparkSession, parallel_folds, n - n // k)
    if coded is not None:
        preds = [all_folds()]
    elif parallel_folds > 1:
        with ThreadPoolExecutor(max_workers=min(parallel_folds, k)) as pool:
            preds = list(pool.map(one_fold, range(k)))
    else:
        preds = [one_fold(i) for i in range(k)]
    allp = preds[0]
    for p in preds[1:]:
        allp = allp.unionByName(p)
    allp = allp.withColumn("pred", argmax3(*PROB_COLS))
    allp = allp.withColumn("model", F.lit(name)).withColumn("slug", F.lit(slug))
    if collect_oof:
        # the OOF check, the fold metrics and the threshold sweep all read
        # the scores: written once (narrow) instead of re-scoring every fold
        allp = write_once(allp, "out-of-fold")
    rows = E.fold_rows(allp, "y", "pred", count_col=TIMES if counted else None)
    size_map = F.create_map(*[x for f, c in sizes.items() for x in (F.lit(f), F.lit(c))])
    rows = rows.withColumn("validation_rows", F.element_at(size_map, F.col("fold"))) \
               .withColumn("training_rows", F.lit(n) - F.col("validation_rows"))
    oof = None
    if collect_oof:
        oof = oof_assemble([allp.select(row_id, "y", *PROB_COLS)], row_id, list(PROB_COLS), n)
    return rows, oof


def threshold_from_oof(oof: DataFrame) -> tuple[dict, DataFrame]:
    """F5 + F6 on out-of-fold scores only."""
    sweep = E.threshold_sweep(oof, "y")
    best = E.select_threshold(sweep).first().asDict()
    return best, sweep


#: Entries of a candidate that are not parameters of the learner.
NOT_PARAMETERS = ("alpha", "candidate", "order")


def candidate_settings(candidate: dict, cv: dict) -> dict:
    """``cv`` with the candidate's parameters and alpha."""
    own = {k: v for k, v in candidate.items() if k not in NOT_PARAMETERS}
    out = {**cv, "params": {**(cv.get("params") or {}), **own}}
    return {**out, "alpha": candidate["alpha"]} if candidate.get("alpha") is not None else out


def search(frame: DataFrame, candidates: list[dict], *, rule: str, key_cols: list[str],
           search_folds: int = 3, ledger: SearchLedger | None = None, stage: str = "search",
           shared: dict | None = None, **cv) -> tuple[DataFrame, dict]:
    """Every candidate by ``search_folds``-fold CV on the same fold tags and designs; summary table
    (from the ledger, so no fold is scored twice) and winner (F8 rule), with its parameters, its
    ``entry`` among the candidates and its ``key`` in the ledger.  Candidates that the ledger has are not evaluated again.
    Stages of one search over the same ``frame``, settings and folds pass the same dictionary as ``shared``: they fit on
    the same stored designs, and what another stage has evaluated on them is taken over."""
    row_id, label, seed = cv["row_id"], cv.get("label", "label"), cv.get("seed", 42)
    ledger = ledger or SearchLedger(frame.sparkSession)
    told = {k: v for k, v in cv.items() if k not in ("progress", "parallel_folds", "pre_stages")}
    keys = [ledger.key(stage, c, {**told, "folds": search_folds}) for c in candidates]
    missing = [(k, c) for k, c in zip(keys, candidates, strict=True) if k not in ledger.done()]
    shared = {} if shared is None else shared
    settings = [candidate_settings(c, cv) for c in candidates]
    trees = max(forest_trees(c["params"]) for c in settings) if settings and all(map(pools_rows, settings)) else 0
    new = any(digest(c) not in shared.get("evaluated", {}) for _, c in missing)
    if new and trees and trees > shared.get("trees", 0):
        folds = pooled_folds(frame, cv["categorical"], cv["numeric"], cv["forbidden"], row_id, label, search_folds, seed, trees)
        shared["tagged"] = tagged = folds.rows
        shared["designs"] = fold_designs(tagged, cv["categorical"], cv["numeric"], cv["forbidden"], row_id, "label", search_folds, _draws(tagged),
                                         folds if all(growable(c["params"]) for c in settings) else None)
        shared["trees"] = trees
    elif new and "tagged" not in shared:
        shared["tagged"] = tagged = write_once(stratified_kfold(frame, label, row_id, search_folds, seed), "folds")
        shared["designs"] = None
        if not cv.get("ordinal") and not cv.get("pre_stages"):
            shared["designs"] = fold_designs(tagged, cv["categorical"], cv["numeric"], cv["forbidden"], row_id, label, search_folds)
    evaluated = shared.setdefault("evaluated", {})
    grown = {}
    if new and isinstance(shared["designs"], Coded):   # one growth for all candidates
        fresh = {digest(c): candidate_settings(c, cv) for _, c in missing if digest(c) not in evaluated}
        grown = dict(zip(fresh, fold_forests(shared["designs"], list(fresh.values()), search_folds), strict=True))
    for key, cand in missing:
        if digest(cand) in evaluated:
            rows = ledger.rows([evaluated[digest(cand)]]).drop(*LEDGER_COLUMNS)
        else:
            rows, _ = cross_validate(frame, k=search_folds, tagged=shared["tagged"], designs=shared["designs"], forests=grown.get(digest(cand)),
                                     **candidate_settings(cand, cv))
        ledger.record(key, stage, cand, rows)
        evaluated[digest(cand)] = key
    summary = E.candidate_summary(ledger.rows(keys), key_cols)
    winner = E.select_candidate(summary, rule, "order" if rule == "first" else None).first().asDict()
    at = next(i for i, c in enumerate(candidates) if all(c[k] == winner[k] for k in key_cols))
    return summary, {**candidates[at], **winner, "key": keys[at], "entry": candidates[at]}


def alphas_near(winner: float, radius: float = 0.15, step: float = 0.05) -> list[float]:
    """The alphas in [0, 1] that lie a whole number of steps from ``winner``, at most ``radius`` away."""
    middle, reach, gap = (Decimal(str(x)) for x in (winner, radius, step))
    if not 0 <= middle <= 1:
        raise ValueError(f"alpha {winner} lies outside [0, 1]")
    if gap <= 0 or reach < 0:
        raise ValueError(f"no grid has radius {radius} and step {step}")
    steps = int(reach / gap)
    return [float(a) for a in (middle + i * gap for i in range(-steps, steps + 1)) if 0 <= a <= 1]


def interpolated_search(frame: DataFrame, coarse: list[float], radius: float = 0.15, step: float = 0.05,
                        **cv) -> tuple[DataFrame, dict, list[float]]:
    """Coarse alphas, then a grid of ``radius`` and ``step`` around the coarse
    winner; the winner comes from the fine rows only (ties -> lower alpha)."""
    cv = {"ledger": None, **cv, "balance": "interpolated"}
    cv["ledger"] = cv["ledger"] or SearchLedger(frame.sparkSession)
    shared = {}
    coarse_sum, coarse_win = search(frame, [{"alpha": a} for a in coarse], rule="alpha",
                                    key_cols=["alpha"], stage="coarse", shared=shared, **cv)
    fine = alphas_near(coarse_win["alpha"], radius, step)
    fine_sum, fine_win = search(frame, [{"alpha": a} for a in fine], rule="alpha",
                                key_cols=["alpha"], stage="fine", shared=shared, **cv)
    both = coarse_sum.withColumn("stage", F.lit("coarse")).unionByName(
        fine_sum.withColumn("stage", F.lit("fine")))
    return both, fine_win, fine


def refit(frame: DataFrame, *, categorical, numeric, forbidden, row_id, label="label",
          kind="boosted", params=None, balance="none", alpha=None, caps=None, pre_stages=(), pooled=None):
    """Final model on all training rows with the chosen settings; ``pooled``: these rows by fold, as a cross-validation of
    the same settings has pooled them (`pooled_folds`)."""
    if pooled is not None and pools_rows({"kind": kind, "pre_stages": pre_stages, "balance": balance, "params": params}):
        told = _draws(pooled.packed)
        kept = [c for c in pooled.packed.columns if c not in ("fold", *told)]
        whole = write_once(pooled.packed.groupBy(*kept).agg(*[F.sum(c).alias(c) for c in told]), "pooled")
        train, wcol = class_weights(pooled.packing.unpack(whole), "label", balance, alpha, TIMES)
        return fit_multiclass(train, categorical, numeric, forbidden, kind, wcol, params, drawn=(whole, pooled.packing))
    train, wcol = prepare_training(frame, label, row_id, balance, alpha, caps)
    return fit_multiclass(train, categorical, numeric, forbidden, kind, wcol, params, pre_stages, row_id=row_id)
