"""Registration of imaging rounds on key points."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import stage
from .ordering import top_fraction, top_per_key

# --------------------------------------------------------------------- matching


def hamming(a: Column, b: Column, words: int) -> Column:
    total = F.lit(0)
    for i in range(words):
        total = total + F.bit_count(a[i].bitwiseXOR(b[i]))
    return total


#: Bits of a band of a code, and the most bits flipped in a probe of one.
BAND, FLIPS = 16, 4


def _bands(code: str, words: int) -> Column:
    """The 16-bit bands of a code of 64-bit words."""
    return F.array(*(F.shiftrightunsigned(F.col(code)[i // 4], BAND * (i % 4)).bitwiseAND(F.lit(65535)) for i in range(4 * words)))


def banded(codes: DataFrame, words: int) -> DataFrame:
    """One row a band: the index that ``probed`` looks up."""
    return codes.select("*", F.posexplode(_bands("other", words)).alias("_no", "_band"))


def probed(left: DataFrame, index: DataFrame, on, words: int, flips: int) -> DataFrame:
    """Pairs that differ in exactly ``flips`` bits of some band, with their Hamming distance."""
    masks = F.lit([sum(1 << b for b in bits) for bits in combinations(range(BAND), flips)])
    asked = left.select("*", F.posexplode(_bands("code", words)).alias("_no", "_bits")).withColumn("_mask", F.explode(masks))
    asked = asked.withColumn("_band", F.col("_bits").bitwiseXOR(F.col("_mask").cast("long"))).drop("_bits", "_mask")
    dist = hamming(F.col("code"), F.col("other"), words).alias("dist")
    return asked.join(index, [*on, "_no", "_band"]).select(*on, "id", "code", dist, "oid")


def _nearest_code(left: DataFrame, right: DataFrame, on, words: int) -> DataFrame:
    """Nearest right descriptor of every left one: ``on, id, code, dist, oid``; ties go to the lowest id.

    Multi-index hashing. Two codes at a distance below ``bands * (r + 1)`` agree in some band but for at most ``r`` bits, so
    after the bands were probed with 0 to ``r`` flipped bits, every code whose best candidate is closer than that is settled.
    The radius grows for the others, as long as their tile has more codes than a code has probes; after that
    they meet all codes of their tile. The best candidate is an aggregate with map-side combine.
    """
    n = 4 * words
    right = right.select(*on, F.col("code").alias("other"), F.col("id").alias("oid"))
    index = stage(banded(right, words), "bands")
    sizes = right.groupBy(*on).agg(F.count("*").alias("_codes"))
    empty = F.lit(None).cast(f"struct<dist:int,oid:{dict(right.dtypes)['oid']}>")
    rest = stage(left.select(*on, "id", "code").join(sizes, on).withColumn("_m", empty), "codes")
    settled, scanned = [], []
    for flips in range(FLIPS + 1):
        far = F.col("_codes") <= n * comb(BAND, flips) if flips else F.lit(False)
        scanned.append(rest.where(far))
        asked = rest.where(~far)
        if asked.isEmpty():
            rest = None
            break
        best = probed(asked, index, on, words, flips).groupBy(*on, "id", "code").agg(F.min(F.struct(F.col("dist"), F.col("oid"))).alias("_now"))
        best = asked.join(best.select(*on, "id", "_now"), [*on, "id"], "left").withColumn("_m", F.least("_m", "_now")).drop("_now")
        best = stage(best, "codes")
        close = F.coalesce(F.col("_m.dist") < n * (flips + 1), F.lit(False))
        settled.append(best.where(close).select(*on, "id", "code", "_m.*"))
        rest = best.where(~close)
    if rest is not None:
        scanned.append(rest)
    scanned = reduce(DataFrame.unionByName, scanned).select(*on, "id", "code").join(right, on)
    dist = hamming(F.col("code"), F.col("other"), words).alias("dist")
    scanned = scanned.groupBy(*on, "id", "code").agg(F.min(F.struct(dist, "oid")).alias("_m")).select(*on, "id", "code", "_m.*")
    return reduce(DataFrame.unionByName, settled, scanned)


def mutual_matches(left: DataFrame, right: DataFrame, words: int, on=("tile_y", "tile_x"), keep: float = 1.0) -> DataFrame:
    """Pairs that are each other's Hamming nearest neighbour in a tile, best fraction kept.

    Frames have ``on``, ``kp_id`` and ``descriptor`` (array of 64-bit words).
    Equal descriptors of one tile are represented by their lowest id.
    """
    on = list(on)
    merge = lambda df: stage(
        df.groupBy(*on, F.col("descriptor").alias("code")).agg(F.min("kp_id").alias("id")), "descriptors"
    )
    l, r = merge(left), merge(right)
    fwd = _nearest_code(l, r, on, words).select(*on, F.col("id").alias("left_id"), F.col("oid").alias("right_id"), "dist")
    back = _nearest_code(r, l, on, words).select(*on, F.col("oid").alias("left_id"), F.col("id").alias("right_id"))
    both = fwd.join(back, [*on, "left_id", "right_id"], "left_semi")
    if keep >= 1:
        return both
    return top_fraction(both, on, [F.col("dist"), F.col("left_id")], keep)


# --------------------------------------------------------------------- transform


def warp(x: Column, y: Column, matrix) -> tuple[Column, Column]:
    """Apply a 3 x 3 transform to coordinates."""
    m = np.asarray(matrix, float)
    w = x * m[2, 0] + y * m[2, 1] + m[2, 2]
    return (x * m[0, 0] + y * m[0, 1] + m[0, 2]) / w, (x * m[1, 0] + y * m[1, 1] + m[1, 2]) / w


def warp_points(points: DataFrame, matrix, x: str = "x", y: str = "y") -> DataFrame:
    wx, wy = warp(F.col(x), F.col(y), matrix)
    return points.withColumns({x: wx, y: wy})


def _design(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Rows of the homogeneous system of a projective transform (two per pair)."""
    x, y, u, v = src[:, 0], src[:, 1], dst[:, 0], dst[:, 1]
    z, o = np.zeros_like(x), np.ones_like(x)
    top = np.stack([x, y, o, z, z, z, -u * x, -u * y, -u], 1)
    low = np.stack([z, z, z, x, y, o, -v * x, -v * y, -v], 1)
    return np.concatenate([top, low])


def _solve(normal: np.ndarray, kind: str, src_frame: np.ndarray, dst_frame: np.ndarray) -> np.ndarray | None:
    """Transform from the 9 x 9 normal matrix of pairs given in centred, scaled frames."""
    if kind == "affine":
        a, b = normal[:6, :6], -normal[:6, 8]
        if np.linalg.matrix_rank(a) < 6:
            return None
        h = np.append(np.linalg.solve(a, b), [0, 0, 1]).reshape(3, 3)
    else:
        values, vectors = np.linalg.eigh(normal)
        h = vectors[:, 0].reshape(3, 3)
        if values[1] <= 1e-12 * values[-1]:
            return None
    m = np.linalg.inv(dst_frame) @ h @ src_frame
    return m / m[2, 2] if abs(m[2, 2]) > 1e-12 else None


def _frame(mean_x: float, mean_y: float, spread: float) -> np.ndarray:
    """Transform to coordinates centred on the mean in units of the spread."""
    s = spread if spread > 0 else 1.0
    return np.array([[1 / s, 0, -mean_x / s], [0, 1 / s, -mean_y / s], [0, 0, 1]])


def _array_frame(p: np.ndarray) -> np.ndarray:
    return _frame(p[:, 0].mean(), p[:, 1].mean(), float(p.std()))


def _in_frame(p: np.ndarray, frame: np.ndarray) -> np.ndarray:
    return p * frame[0, 0] + frame[:2, 2]


def _frames(matches: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Source and target frames of all matches, from one aggregate; without matches the plain ones."""
    r = matches.agg(*(F.coalesce(f(c), F.lit(0.0)).alias(f"{f.__name__}_{c}") for f in (F.avg, F.stddev_pop) for c in _PAIR)).first()
    return tuple(
        _frame(r[f"avg_{k}_x"], r[f"avg_{k}_y"], (r[f"stddev_pop_{k}_x"] + r[f"stddev_pop_{k}_y"]) / 2) for k in ("src", "dst")
    )


def _residuals(models: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Distance of each pair under each model: models x pairs."""
    p = np.c_[src, np.ones(len(src))]
    q = np.einsum("mij,nj->mni", models, p)
    with np.errstate(divide="ignore", invalid="ignore"):
        xy = q[..., :2] / q[..., 2:]
    return np.sqrt(((xy - dst[None]) ** 2).sum(-1))


_PAIR = ["src_x", "src_y", "dst_x", "dst_y"]


def sample_trials(matches: DataFrame, trials: int, min_samples: int, seed: int = 0, tile: str = "tile") -> DataFrame:
    """Stratified samples: per trial ``min_samples`` cells (tile, hash slot) and one match of each.

    A trial takes one slot of every tile before a second slot of any, so samples spread over
    tiles, and few tiles are no special case. Choices are hash orders of (seed, trial, cell) and
    (seed, trial, match), so a lost task draws the same sample again.
    """
    slots = F.pmod(F.xxhash64("match_id", F.lit(seed)), F.lit(min_samples)).cast("int")
    m = matches.withColumn("_cell", F.xxhash64(F.struct(F.col(tile), slots)))
    cells = m.select(tile, "_cell").distinct().withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    cells = cells.withColumn("_h", F.xxhash64(F.lit(seed), "trial", "_cell"))
    turn = F.row_number().over(Window.partitionBy("trial", tile).orderBy("_h", "_cell"))
    chosen = top_per_key(cells.withColumn("_turn", turn), ["trial"], [F.col("_turn"), F.col("_h"), F.col("_cell")], min_samples).select("trial", "_cell")
    picked = m.join(chosen, "_cell").groupBy("trial", "_cell").agg(
        F.min(F.struct(F.xxhash64(F.lit(seed + 1), "trial", "match_id").alias("h"), *_PAIR)).alias("p")
    )
    return picked.select("trial", *(F.col(f"p.{c}").alias(c) for c in _PAIR))


def fit_trials(samples: DataFrame, kind: str, min_samples: int) -> DataFrame:
    """One model per trial from its few sampled pairs: ``(trial, model array<double>)``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < min_samples:
            return pd.DataFrame({"trial": [], "model": []})
        src, dst = pdf[_PAIR[:2]].to_numpy(), pdf[_PAIR[2:]].to_numpy()
        fs, fd = _array_frame(src), _array_frame(dst)
        a = _design(_in_frame(src, fs), _in_frame(dst, fd))
        model = _solve(a.T @ a, kind, fs, fd)
        rows = [] if model is None or not np.isfinite(model).all() else [(int(pdf["trial"].iloc[0]), model.ravel().tolist())]
        return pd.DataFrame(rows, columns=["trial", "model"])

    return samples.groupBy("trial").applyInPandas(run, "trial int, model array<double>")


def score_models(matches: DataFrame, models: dict[int, list[float]], threshold: float, tile: str = "tile") -> DataFrame:
    """Per trial: inliers, mean inlier share over tiles and residual sum.

    The matches stay where they are; the models (at most the number of trials,
    nine numbers each) go to them, and each batch returns one row per trial and
    tile.
    """
    ids, stack = list(models), np.array([models[i] for i in models]).reshape(-1, 3, 3)

    def run(batches):
        for pdf in batches:
            res = _residuals(stack, pdf[_PAIR[:2]].to_numpy(), pdf[_PAIR[2:]].to_numpy())
            for t, rows in pdf.groupby(tile).indices.items():
                part = res[:, rows]
                yield pd.DataFrame(
                    {"trial": ids, "tile": t, "inliers": (part < threshold).sum(1), "n": len(rows), "residual": part.sum(1)}
                )

    tile_type = dict(matches.dtypes)[tile]
    per = matches.select(tile, *_PAIR).mapInPandas(run, f"trial int, tile {tile_type}, inliers long, n long, residual double")
    tiles = per.groupBy("trial", "tile").agg(F.sum("inliers").alias("inliers"), F.sum("n").alias("n"), F.sum("residual").alias("residual"))
    return tiles.groupBy("trial").agg(
        F.sum("inliers").alias("inlier_num"), F.avg(F.col("inliers") / F.col("n")).alias("inlier_tile"), F.sum("residual").alias("residuals_sum")
    )


_OBJECTIVES = {"inlier_num": 1, "inlier_tile": 1, "residuals_sum": -1}


def refit_many(matches: DataFrame, models: list, thresholds: list[float], kind: str = "affine") -> list[np.ndarray | None]:
    """Least-squares models over all inliers of each of ``models``, from normal matrices that one scan sums."""
    first, limits = np.asarray(models, float).reshape(-1, 3, 3), np.asarray(thresholds, float)
    fs, fd = _frames(matches)

    def run(batches):
        total = np.zeros((len(first), 9, 9))
        for pdf in batches:
            src, dst = pdf[_PAIR[:2]].to_numpy(), pdf[_PAIR[2:]].to_numpy()
            a = _design(_in_frame(src, fs), _in_frame(dst, fd))
            for k in range(len(first)):
                ok = _residuals(first[k : k + 1], src, dst)[0] < limits[k]
                rows = a[np.concatenate([ok, ok])]
                total[k] += rows.T @ rows
        yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

    sums = matches.select(*_PAIR).mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    normal = np.zeros(len(first) * 81)
    for r in sums:
        normal[r["i"]] = r["v"]
    return [_solve(x, kind, fs, fd) for x in normal.reshape(-1, 9, 9)]


def refit(matches: DataFrame, model, threshold: float, kind: str = "affine") -> np.ndarray | None:
    """Least-squares model over all inliers of ``model``."""
    return refit_many(matches, [model], [threshold], kind)[0]


def fit_ransac(
    matches: DataFrame, kind: str = "affine", min_samples: int = 3, threshold: float = 5.0, max_trials: int = 100,
    objective: str = "inlier_num", wave: int = 50, probability: float = 0.99, seed: int = 0, tile: str = "tile",
) -> dict:
    """Robust transform from matches ``match_id, tile, src_x, src_y, dst_x, dst_y``.

    Trials run in waves so that the search can stop once the best inlier share
    makes an outlier-free sample likely enough. The result is the refit on all
    inliers of the best trial.
    """
    if objective not in _OBJECTIVES:
        raise ValueError(f"objective must be one of {sorted(_OBJECTIVES)}")
    if kind not in ("affine", "projective"):
        raise ValueError("kind must be 'affine' or 'projective'")
    matches = stage(matches.select("match_id", tile, *_PAIR), "matches")
    total = matches.count()
    best, done = None, 0
    while done < max_trials:
        n = min(wave, max_trials - done)
        samples = sample_trials(matches, n, min_samples, seed + 1000 * done, tile)
        models = {r["trial"]: r["model"] for r in fit_trials(samples, kind, min_samples).collect()}
        done += n
        if not models:
            continue
        key = F.col(objective) * _OBJECTIVES[objective]
        top = score_models(matches, models, threshold, tile).orderBy(key.desc(), "trial").first()
        value = top[objective] * _OBJECTIVES[objective]
        if best is None or value > best["value"]:
            best = {"value": value, "model": models[top["trial"]], **{k: top[k] for k in _OBJECTIVES}}
        if objective == "inlier_num" and enough(best["inlier_num"] / total, min_samples, done, probability):
            break
    if best is None:
        return {"matrix": None, "trials": done}
    matrix = refit(matches, best["model"], threshold, kind)
    if matrix is None:
        matrix = np.array(best["model"]).reshape(3, 3)
    return {"matrix": matrix, "trials": done, **{k: best[k] for k in _OBJECTIVES}}


#: Models whose residuals a task holds at a time.
MODELS = 32


def score_grid(matches: DataFrame, models: list[list[float]], thresholds: list[float], tile: str = "tile") -> DataFrame:
    """``(model, n, residuals_sum, num array, share array)`` per model: inliers and their mean share over tiles, for each threshold.

    One scan: a batch counts residuals between thresholds per model and tile, running sums of the counts are the inliers.
    """
    stack, limits = np.asarray(models, float).reshape(-1, 3, 3), np.asarray(thresholds, float)
    order, slots = np.argsort(limits, kind="stable"), [f"c{j}" for j in range(len(limits))]

    def run(batches):
        for pdf in batches:
            src, dst = pdf[_PAIR[:2]].to_numpy(), pdf[_PAIR[2:]].to_numpy()
            tiles, place = np.unique(pdf[tile].to_numpy(), return_inverse=True)
            n = np.bincount(place, minlength=len(tiles))
            for at in range(0, len(stack), MODELS):
                res = _residuals(stack[at : at + MODELS], src, dst)
                m = len(res)
                cell = np.arange(m)[:, None] * len(tiles) + place[None]
                slot = np.searchsorted(limits[order], res, side="right")
                counts = np.bincount((cell * (len(limits) + 1) + slot).ravel(), minlength=m * len(tiles) * (len(limits) + 1))
                counts = counts.reshape(m * len(tiles), -1)[:, :-1].cumsum(1)
                out = {"model": np.repeat(np.arange(at, at + m), len(tiles)), "tile": np.tile(tiles, m), "n": np.tile(n, m)}
                out["residual"] = np.bincount(cell.ravel(), res.ravel(), minlength=m * len(tiles))
                yield pd.DataFrame(out | {slots[j]: counts[:, k] for k, j in enumerate(order)})

    kind = dict(matches.dtypes)[tile]
    schema = f"model int, tile {kind}, n long, residual double, " + ", ".join(f"{c} long" for c in slots)
    per = matches.select(tile, *_PAIR).mapInPandas(run, schema)
    tiles = per.groupBy("model", "tile").agg(*(F.sum(c).alias(c) for c in ("n", "residual", *slots)))
    return tiles.groupBy("model").agg(
        F.sum("n").alias("n"), F.sum("residual").alias("residuals_sum"), F.array(*(F.sum(c) for c in slots)).alias("num"),
        F.array(*(F.avg(F.col(c) / F.col("n")) for c in slots)).alias("share"),
    )


def search_ransac(
    matches: DataFrame, kind: str = "affine", samples=range(3, 7), thresholds=range(1, 10), objectives=("inlier_num", "inlier_tile"),
    max_trials: int = 100, seed: int = 0, tile: str = "tile",
) -> list[dict]:
    """Grid over sample sizes, thresholds and objectives; one result per configuration.

    A result is that of ``fit_ransac`` with all its trials in one wave. The matches are read once per sample
    size to draw the trials, once to score all models under all thresholds, and once to refit the winners.
    """
    if not set(objectives) <= set(_OBJECTIVES):
        raise ValueError(f"objectives must be among {sorted(_OBJECTIVES)}")
    matches, limits = stage(matches.select("match_id", tile, *_PAIR), "matches"), [float(t) for t in thresholds]
    models, names = [], []
    for m in samples:
        for r in sorted(fit_trials(sample_trials(matches, max_trials, m, seed, tile), kind, m).collect(), key=lambda r: r["trial"]):
            models.append(r["model"])
            names.append(m)
    rows = {r["model"]: r for r in score_grid(matches, models, limits, tile).collect()} if models else {}
    results, wanted = [], {}
    for objective in objectives:
        for m in samples:
            for j, t in enumerate(limits):
                value = {k: {"inlier_num": r["num"][j], "inlier_tile": r["share"][j], "residuals_sum": r["residuals_sum"]} for k, r in rows.items() if names[k] == m}
                out = {"min_samples": m, "threshold": t, "objective": objective, "trials": max_trials, "matrix": None}
                if value:
                    best = min(value, key=lambda k: (-value[k][objective] * _OBJECTIVES[objective], k))
                    wanted.setdefault((best, t), len(wanted))
                    out |= {"model": best, **value[best]}
                results.append(out)
    fitted = refit_many(matches, [models[k] for k, _ in wanted], [t for _, t in wanted], kind) if wanted else []
    for out in results:
        if "model" in out:
            k = out.pop("model")
            matrix = fitted[wanted[k, out["threshold"]]]
            out["matrix"] = np.array(models[k]).reshape(3, 3) if matrix is None else matrix
    return results


def enough(share: float, min_samples: int, done: int, probability: float) -> bool:
    """Whether ``done`` samples hold one without outliers with the given probability, at this share of inliers."""
    return (1 - share**min_samples) ** done <= 1 - probability


def with_residual(matches: DataFrame, matrix) -> DataFrame:
    wx, wy = warp(F.col("src_x"), F.col("src_y"), matrix)
    dx, dy = wx - F.col("dst_x"), wy - F.col("dst_y")
    return matches.withColumn("residual", F.sqrt(dx * dx + dy * dy))


def _warped(x: str, y: str, model: Column) -> tuple[Column, Column]:
    """Coordinates under a transform that is a column of nine numbers."""
    a, b = F.col(x), F.col(y)
    w = a * model[6] + b * model[7] + model[8]
    return (a * model[0] + b * model[1] + model[2]) / w, (a * model[3] + b * model[4] + model[5]) / w


def _off(model: Column) -> Column:
    """Distance of a match from where a transform puts it; large where that is undefined."""
    x, y = _warped("src_x", "src_y", model)
    off = F.hypot(x - F.col("dst_x"), y - F.col("dst_y"))
    return F.when(F.isnan(off), F.lit(float("inf"))).otherwise(F.coalesce(off, F.lit(float("inf"))))


#: Slices that the matches of one region are dealt to when its trials are scored.
SLICES = 16


def region_models(
    inside: DataFrame, kind: str = "affine", min_samples: int = 3, threshold: float = 5.0, trials: int = 50, pool: int = 256, seed: int = 0
) -> DataFrame:
    """Robust transform ``(label, model)`` of each region, from ``(label, match_id, src_x, src_y, dst_x, dst_y)``.

    Trials are keyed by (region, trial): a task draws all samples of a region from ``pool`` of its matches, the first in a
    hash order, so a lost task draws them again. One pass scores all trials of all regions on all their matches; most
    inliers win, then the least residuals below the threshold, then the first trial. The winner is fitted again on its
    inliers. Regions with fewer than ``min_samples`` matches have no row.
    """
    if kind not in ("affine", "projective"):
        raise ValueError("kind must be 'affine' or 'projective'")
    inside = stage(inside.select("label", "match_id", *_PAIR), "region-matches")
    some = top_per_key(inside, ["label"], [F.xxhash64(F.lit(seed), "match_id"), F.col("match_id")], pool)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, models = pdf.sort_values("rank"), []
        label = int(pdf["label"].iloc[0])
        src, dst = pdf[_PAIR[:2]].to_numpy(), pdf[_PAIR[2:]].to_numpy()
        random = np.random.default_rng([seed, label % 2**63])
        for _ in range(trials if len(pdf) >= min_samples else 0):
            pick = random.choice(len(pdf), min_samples, replace=False)
            fs, fd = _array_frame(src[pick]), _array_frame(dst[pick])
            a = _design(_in_frame(src[pick], fs), _in_frame(dst[pick], fd))
            model = _solve(a.T @ a, kind, fs, fd)
            if model is not None and np.isfinite(model).all():
                models.append(model.ravel().tolist())
        return pd.DataFrame({"label": [label], "models": [models]} if models else {"label": [], "models": []})

    models = stage(some.groupBy("label").applyInPandas(draw, "label long, models array<array<double>>"), "region-models")
    spread = models.select("label", "models", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("_slice"))
    dealt = inside.withColumn("_slice", F.pmod(F.xxhash64("match_id"), F.lit(SLICES)).cast("int"))
    tried = dealt.join(spread, ["label", "_slice"]).select("label", *_PAIR, F.posexplode("models").alias("trial", "model"))
    off = F.least(_off(F.col("model")), F.lit(float(threshold)))
    scores = tried.select("label", "trial", off.alias("_off")).groupBy("label", "trial").agg(
        F.count_if(F.col("_off") < threshold).alias("inliers"), F.sum("_off").alias("cost")
    )
    best = scores.groupBy("label").agg(F.max(F.struct("inliers", (-F.col("cost")).alias("gain"), (-F.col("trial")).alias("early"))).alias("b"))
    best = stage(best.join(models, "label").select("label", F.get("models", -F.col("b.early")).alias("tried")), "region-trials")
    agreed = inside.join(best, "label").where(_off(F.col("tried")) < threshold)
    fs, fd = _frames(inside)
    moved = {n: F.col(n) * float(f[0, 0]) + float(f[i, 2]) for f, k in ((fs, "src"), (fd, "dst")) for i, n in enumerate((f"{k}_x", f"{k}_y"))}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for lab, n, flat in zip(pdf["label"], pdf["n"], pdf["normal"]):
            m = _solve(np.array(flat, float).reshape(9, 9), kind, fs, fd) if n >= min_samples else None
            if m is not None and np.isfinite(m).all():
                rows.append((lab, m.ravel().tolist()))
        return pd.DataFrame(rows, columns=["label", "model"])

    fitted = _normal_sums(agreed.withColumns(moved)).mapInPandas(lambda it: (solve(p) for p in it), "label long, model array<double>")
    return best.join(fitted, "label", "left").select("label", F.coalesce("model", "tried").alias("model"))


def local_refit(
    points: DataFrame, matches: DataFrame, matrix, regions: DataFrame, kind: str = "affine", min_samples: int = 3, on=(),
    threshold: float = 5.0, trials: int = 50, seed: int = 0,
) -> DataFrame:
    """Warp points with a local transform inside flagged regions, the global one elsewhere.

    ``regions`` is a pixel table ``(on, label, y, x)``, ``on`` naming the image; labels are unique over images. A match belongs to the region
    of its target pixel. The transform of a region is a robust fit on its own matches, whether or not they agree with the
    global one (``region_models``); regions without one keep the global transform.
    """
    px = [(F.floor(F.col("dst_y"))).alias("y"), (F.floor(F.col("dst_x"))).alias("x")]
    on = list(on)
    inside = matches.select(*on, "match_id", *_PAIR, *px).join(regions, [*on, "y", "x"])
    models = region_models(inside, kind, min_samples, threshold, trials, seed=seed)
    gx, gy = warp(F.col("x"), F.col("y"), matrix)
    p = points.withColumns({"_gx": gx, "_gy": gy})
    at = regions.select(*on, "label", F.col("y").alias("_py"), F.col("x").alias("_px"))
    p = p.withColumns({"_py": F.floor("_gy"), "_px": F.floor("_gx")}).join(at, [*on, "_py", "_px"], "left").join(models, "label", "left")
    m = F.col("model")
    lx, ly = _warped("x", "y", m)
    return p.withColumns({"local": m.isNotNull(), "wx": F.coalesce(lx, "_gx"), "wy": F.coalesce(ly, "_gy")}).drop(
        "_gx", "_gy", "_py", "_px", "label", "model"
    )


def _normal_sums(matches: DataFrame) -> DataFrame:
    """9 x 9 normal matrix of every label, summed by Spark."""
    x, y, u, v = (F.col(c) for c in _PAIR)
    z, o = F.lit(0.0), F.lit(1.0)
    rows = ([x, y, o, z, z, z, -u * x, -u * y, -u], [z, z, z, x, y, o, -v * x, -v * y, -v])
    sums = {(i, j): F.sum(rows[0][i] * rows[0][j] + rows[1][i] * rows[1][j]).alias(f"s{i}_{j}") for i in range(9) for j in range(i, 9)}
    flat = F.array(*(F.col(f"s{min(i, j)}_{max(i, j)}") for i in range(9) for j in range(9)))
    return matches.groupBy("label").agg(F.count("*").alias("n"), *sums.values()).select("label", "n", flat.alias("normal"))


# ---------------------------------------------------------------------- quality


def flag_misaligned(
    tile_means: DataFrame, tile_errors: DataFrame, inlier_rates: DataFrame, tile: int, on=("tile_y", "tile_x"),
    bright: float = 0.25, max_error: float = 1.2, min_inliers: float = 0.4, max_area: float = 1 / 64,
) -> DataFrame:
    """Tiles to be registered again.

    Those brighter than ``bright`` of the global mean, of an error above ``max_error`` percent, an inlier
    rate below ``min_inliers`` and a differing area above ``max_area`` of the tile. The defaults are fixed values.
    """
    on = list(on)
    overall = tile_means.agg((F.sum("total") / F.sum("pixels")).alias("m")).scalar()
    joined = tile_means.join(tile_errors, on).join(inlier_rates, on)
    return joined.where(
        (F.col("total") / F.col("pixels") > overall * bright) & (F.col("error") > max_error)
        & (F.col("inlier_rate") < min_inliers) & (F.col("diff_area") > tile * tile * max_area)
    )


# --------------------------------------------------------------- files and scripts


def parse_names(files: DataFrame, name: str = "filename") -> DataFrame:
    """Round, channel and set prefix from names like ``S1_R2C3.tif``."""
    f = F.col(name)
    return files.withColumns(
        {
            "round": F.regexp_extract(f, r"R(\d+)C", 1).cast("int"),
            "channel": F.regexp_extract(f, r"R\d+C(\d+)", 1).cast("int"),
            "prefix": F.regexp_extract(f, r"^(S[^_]*_)", 1),
        }
    )


def registration_plan(files: DataFrame, target_round: int, name: str = "filename") -> DataFrame:
    """Every source file with the target file of its channel, if that exists."""
    p = parse_names(files, name).where("round IS NOT NULL AND channel IS NOT NULL")
    target = p.where(F.col("round") == target_round).select("prefix", "channel", F.col(name).alias("target_file"))
    return p.where(F.col("round") != target_round).join(target, ["prefix", "channel"], "left").select(
        "prefix", "round", "channel", F.col(name).alias("source_file"), "target_file"
    )


def make_channel_script(files: DataFrame, crop, brightfield: int | None = None, name: str = "filename") -> DataFrame:
    """Default script: everything corrected except brightfield channels, one crop for all."""
    off = F.col(name).contains(f"C{brightfield}.tif") if brightfield else F.lit(False)
    yes = F.when(off, F.lit("No")).otherwise(F.lit("Yes"))
    null = F.lit(None).cast("string")
    return files.where(F.lower(name).rlike(r"\.tiff?$")).select(
        name, F.when(off, F.lit("brightfield")).alias("biomarker"), yes.alias("intra channel correction"),
        yes.alias("inter channel correction"), *(null.alias(f"channel {i}") for i in (1, 2, 3)), null.alias("level"),
        *(F.lit(v).alias(c) for v, c in zip(crop, ("xmin", "ymin", "xmax", "ymax"))),
    )


def mask_manifest(images: DataFrame, masks: DataFrame, on=("data_set",)) -> DataFrame:
    """Image and mask pairs of a data set: its seed masks with every image, other masks by marker.

    ``images`` has ``data_set, image_id, biomarker``; ``masks`` has ``data_set, mask_id, biomarker,
    is_seed, part``.
    """
    on = list(on)
    every = images.join(masks.where("is_seed").drop("biomarker"), on).select("image_id", "mask_id", F.col("biomarker").alias("description"))
    own = images.join(masks.where("NOT is_seed"), [*on, "biomarker"]).select(
        "image_id", "mask_id", F.concat("biomarker", F.lit(" with "), "part").alias("description")
    )
    return every.unionByName(own)
