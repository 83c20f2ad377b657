"""A person's own ranking, learned from pairwise choices, and the evaluation of rankings.

Votes are rows with a_* and b_* columns, `pick` ('a' or 'b'), `mode`, `stratum` and
`voter`. Feature vectors are arrays of eight doubles.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PREFERENCE, VERDICTS
from ..functions.geo import solar_elevation
from .scale import top_per

WIDTH = len(PREFERENCE.factors)


def features(scored: DataFrame, now: Column) -> DataFrame:
    """The eight numbers a choice is explained by."""
    sun = solar_elevation(F.col("lat"), F.col("lon"), now)
    dark = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (6.0 - sun) / 12.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return scored.withColumn("x", F.array(
        zero("anomaly"), "scale_prior", "incident_floor", "queue_floor", zero("still_floor"), dark,
        F.coalesce("brightness", F.lit(0.5)), F.when(F.col("highway") == "motorway", 1.0).otherwise(0.0)))


def candidate_pool(scored: DataFrame, now: Column, period: Column) -> DataFrame:
    """Cameras a choice may be offered between: scored, with a recent picture."""
    live = scored.filter(F.col("attention").isNotNull() & F.col("last_at").isNotNull() & (now - F.col("last_at") <= 3.0 * period))
    return features(live, now).select("camera_id", "region_id", "attention", F.coalesce("equation", "attention").alias("equation"), "x")


def retained(votes: DataFrame, keep: int = PREFERENCE.max_votes) -> DataFrame:
    """The newest votes of each voter."""
    return top_per(votes, ["voter"], [F.col("ts").desc(), F.col("vote_id").desc()], keep)


def descend(d: np.ndarray, y: np.ndarray, steps: int = PREFERENCE.steps) -> np.ndarray:
    """Fixed schedule of full-batch steps from zero on feature differences."""
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-(d @ w)))
        w = w - PREFERENCE.rate * (PREFERENCE.l2 * w + (p - y) @ d / len(y))
    return w


def _rows(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    d = np.stack(pdf["a_x"].to_numpy()) - np.stack(pdf["b_x"].to_numpy())
    return d, (pdf["pick"] == "a").to_numpy(float)


def fit_voters(votes: DataFrame) -> DataFrame:
    """Weights of every voter (E1). Retention bounds a voter's group at two thousand rows."""
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        d, y = _rows(pdf)
        return pd.DataFrame({"voter": [pdf["voter"].iloc[0]], "votes": [len(y)], "weights": [descend(d, y).tolist()]})

    kept = retained(votes).select("voter", "a_x", "b_x", "pick")
    return kept.groupBy("voter").applyInPandas(fit, "voter bigint, votes bigint, weights array<double>")


def fit_all(votes: DataFrame) -> list[float]:
    """One set of weights for any number of votes: the same objective, minimised by Spark's solver."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    diff = F.zip_with("a_x", "b_x", lambda a, b: a - b)
    rows = votes.select(array_to_vector(diff).alias("features"), F.when(F.col("pick") == "a", 1.0).otherwise(0.0).alias("label"))
    model = LogisticRegression(fitIntercept=False, regParam=PREFERENCE.l2, elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-9).fit(rows)
    return [float(v) for v in model.coefficients]


def dot(w: Column, x: Column) -> Column:
    return F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def personal_ranking(pool: DataFrame, weights: DataFrame, views: DataFrame) -> DataFrame:
    """The whole wall of a city in each voter's own order; from ten votes on.

    `views` is (voter, region_id): only the cities voters have open are ranked, each
    in a window as large as one city's wall.
    """
    able = weights.filter(F.col("votes") >= PREFERENCE.min_votes)
    scored = pool.join(views.join(able, "voter"), "region_id").withColumn("score", dot(F.col("weights"), F.col("x")))
    order = Window.partitionBy("voter", "region_id").orderBy(F.col("score").desc(), "camera_id")
    return scored.select("voter", "region_id", "camera_id", "score", F.row_number().over(order).alias("rank"))


def _apart(a: Column, b: Column) -> Column:
    return F.when(F.abs(a - b) >= 1e-9, a - b)


def rankers(votes: DataFrame) -> DataFrame:
    """Signed preference of each ranking for side a; null where it cannot tell."""
    same = F.col("a_look_at") == F.col("b_look_at")
    look = F.when(same, _apart(F.col("a_level"), F.col("b_level")))
    sure = F.least("a_confidence", "b_confidence") >= VERDICTS.act_confidence
    return votes.withColumns({"by_equation": _apart(F.col("a_equation"), F.col("b_equation")), "by_look": look, "by_confident_look": F.when(sure, look),
                              "by_movement": _apart(F.col("a_x")[0], F.col("b_x")[0])})


def hit(preference: Column) -> Column:
    return F.when(preference.isNotNull(), ((preference > 0) == (F.col("pick") == "a")).cast("int"))


def held_out(votes: DataFrame, folds: int = PREFERENCE.folds) -> DataFrame:
    """Each evaluation vote predicted by its voter's model fitted without its fold.

    Folds are dealt by a hash of the vote; learn votes are in every fit. Only the
    votes a model is fitted to are the voter's retained ones: every evaluation vote
    is predicted. A preference under 1e-9 is null: the model cannot tell.
    """
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        d, y = _rows(pdf)
        fold = pdf["fold"].to_numpy()
        fits = {k: descend(d[fold != k], y[fold != k]).tolist() for k in range(folds) if (fold != k).any()}
        return pd.DataFrame({"voter": pdf["voter"].iloc[0], "fold": list(fits), "weights": list(fits.values())})

    dealt = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("vote_id").cast("string"), F.lit(str(PREFERENCE.seed))).cast("binary")), 1, 8), 16, 10).cast("bigint") % folds
    fold = F.when(F.col("mode") == "evaluate", dealt).otherwise(-1).cast("bigint")
    models = (retained(votes).select("voter", "a_x", "b_x", "pick", fold.alias("fold"))
              .groupBy("voter").applyInPandas(fit, "voter bigint, fold bigint, weights array<double>"))
    asked = votes.filter("mode = 'evaluate'").select("voter", "vote_id", "a_x", "b_x", fold.alias("fold"))
    score = dot(F.col("weights"), F.zip_with("a_x", "b_x", lambda a, b: a - b))
    return asked.join(models, ["voter", "fold"]).select("vote_id", _apart(score, F.lit(0.0)).alias("by_person"))


def hit_rates(ranked: DataFrame, columns: dict[str, str], replicates: int = PREFERENCE.bootstrap) -> DataFrame:
    """Hit rate and 95% bootstrap interval per stratum and ranking on the choices its anchors decide.

    The anchors are the equation and the look; where no look decides any choice of a
    stratum, the equation alone.

    Resampling n zeros and ones with k ones gives a binomial count of ones, so each
    interval needs only n and k, however many votes there are.
    """
    each = (ranked.filter((F.col("mode") == "evaluate") & F.col("by_equation").isNotNull())
            .withColumn("_stratum", F.explode(F.array(F.lit("all"), F.coalesce("stratum", F.lit(""))))))
    looked = each.groupBy("_stratum").agg(F.max(F.col("by_look").isNotNull()).alias("_looked"))
    common = each.join(looked, "_stratum").filter(~F.col("_looked") | F.col("by_look").isNotNull())
    stacked = ", ".join(f"'{n}', {c}" for n, c in columns.items())
    long = common.selectExpr("nullif(_stratum, '') AS stratum", "pick", f"stack({len(columns)}, {stacked}) AS (ranker, preference)")
    rows = long.select("stratum", "ranker", hit(F.col("preference")).alias("hit")).filter(F.col("hit").isNotNull())
    counts = rows.groupBy("stratum", "ranker").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("k"))

    @F.pandas_udf("struct<low: double, high: double>")
    def interval(n: pd.Series, k: pd.Series, name: pd.Series) -> pd.DataFrame:
        seeded = lambda text: np.random.default_rng([PREFERENCE.seed, zlib.crc32(text.encode())])
        means = [np.sort(seeded(t).binomial(a, b / a, replicates) / a) for a, b, t in zip(n, k, name)]
        low, high = int(0.025 * replicates), int(0.975 * replicates) - 1
        return pd.DataFrame({"low": [m[low] for m in means], "high": [m[high] for m in means]})

    return counts.withColumn("i", interval("n", "k", F.concat_ws(":", "stratum", "ranker"))).select("stratum", "ranker", "n", (F.col("k") / F.col("n")).alias("rate"),
                                                             F.when(F.col("n") > 1, F.col("i.low")).alias("low"), F.when(F.col("n") > 1, F.col("i.high")).alias("high"))


def agreement(votes: DataFrame) -> DataFrame:
    """How often the equation would have chosen the same camera."""
    decided = votes.filter(F.abs(F.col("a_attention") - F.col("b_attention")) > 1e-6)
    same = (F.col("pick") == "a") == (F.col("a_attention") > F.col("b_attention"))
    return decided.agg(F.count_if(same).alias("agree"), F.count(F.lit(1)).alias("total"))


def evaluation(votes: DataFrame) -> DataFrame:
    """Equation and look on the same evaluation choices."""
    v = votes.filter(F.col("mode") == "evaluate")
    paired = ((F.abs(F.col("a_equation") - F.col("b_equation")) > 1e-6) & (F.col("a_look_at") == F.col("b_look_at")) & (F.abs(F.col("a_level") - F.col("b_level")) > 1e-6))
    paired = F.coalesce(paired, F.lit(False))
    a = F.col("pick") == "a"
    return v.agg(F.count(F.lit(1)).alias("choices"), F.count_if(F.col("stratum") == "disagree").alias("disagreements"), F.count_if(paired).alias("paired"),
                 F.count_if(paired & (a == (F.col("a_equation") > F.col("b_equation")))).alias("equation_agree"),
                 F.count_if(paired & (a == (F.col("a_level") > F.col("b_level")))).alias("look_agree"))


def disagreements(votes: DataFrame, k: int = 3) -> DataFrame:
    """Votes against the equation by the widest gap (K9)."""
    a = F.col("pick") == "a"
    gap = F.when(a, F.col("b_attention") - F.col("a_attention")).otherwise(F.col("a_attention") - F.col("b_attention"))
    return votes.withColumn("gap", gap).filter(F.col("gap") > 0).orderBy(F.col("gap").desc(), "vote_id").limit(k)


def opposed_pairs(cameras: DataFrame) -> DataFrame:
    """Pairs of one look that equation and look order oppositely, each by more than a near tie.

    A look judges at most eight cameras, so a look is a bounded group.
    """
    side = lambda q: cameras.select("look_id", F.col("camera_id").alias(f"{q}_id"), F.col("equation").alias(f"{q}_equation"), F.col("level").alias(f"{q}_level"))
    p = side("a").join(side("b"), "look_id").filter(F.col("a_id") < F.col("b_id"))
    e, v = F.col("a_equation") - F.col("b_equation"), F.col("a_level") - F.col("b_level")
    return p.filter((F.abs(e) > PREFERENCE.disagree_equation) & (F.abs(v) > PREFERENCE.disagree_look) & (e * v < 0)).select("look_id", "a_id", "b_id")


def kendall(orders: DataFrame) -> DataFrame:
    """Kendall tau of two orderings per group on their common items; null under two (E5).

    `orders`: grp, item, first_place, second_place (null where an order lacks the item).
    """
    both = orders.filter(F.col("first_place").isNotNull() & F.col("second_place").isNotNull())
    side = lambda q: both.select("grp", F.col("item").alias(f"{q}_item"), F.col("first_place").alias(f"{q}1"), F.col("second_place").alias(f"{q}2"))
    pairs = side("a").join(side("b"), "grp").filter(F.col("a1") < F.col("b1"))
    tau = pairs.groupBy("grp").agg((F.sum(F.when(F.col("a2") < F.col("b2"), 1).otherwise(-1)) / F.count(F.lit(1))).alias("raw"))
    from ..functions.numeric import with_fixed
    return with_fixed(orders.select("grp").distinct().join(tau, "grp", "left"), 3, tau=F.col("raw")).drop("raw")


def look_orders(leaders: DataFrame) -> DataFrame:
    """Places of each leader by equation and by look, ties by id."""
    from pyspark.sql import Window
    # At most eight leaders a look.
    w = lambda c: F.row_number().over(Window.partitionBy("grp").orderBy(F.col(c).desc_nulls_last(), "item"))
    return leaders.select("grp", "item", w("equation").alias("first_place"), F.when(F.col("level").isNotNull(), w("level")).alias("second_place"))


def shadow_summary(looks: DataFrame) -> DataFrame:
    """Looks, median and mean tau, and how often both put the same camera first."""
    return looks.agg(F.count(F.lit(1)).alias("looks"), F.percentile("tau", 0.5).alias("median_tau"), F.avg("tau").alias("mean_tau"), F.count_if("same_first").alias("same_first"))


def _shuffled(*ids: str, seed: int) -> Column:
    """An order that looks random and depends on the ids and the seed only."""
    return F.md5(F.concat_ws(":", *[F.col(i).cast("string") for i in ids], F.lit(str(seed))).cast("binary"))


def _coin(key: str, seed: int) -> Column:
    return F.substring(_shuffled(key, seed=seed), 1, 1) < "8"


def rested(pool: DataFrame, recent: DataFrame) -> DataFrame:
    """The pool without cameras lately shown (`recent`: region_id, camera_id), wherever two others remain in the city."""
    shown = recent.select("region_id", "camera_id", F.lit(True).alias("_shown")).distinct()
    marked = pool.join(shown, ["region_id", "camera_id"], "left")
    fresh = marked.groupBy("region_id").agg(F.count_if(F.col("_shown").isNull()).alias("_fresh"))
    return marked.join(fresh, "region_id").filter(F.col("_shown").isNull() | (F.col("_fresh") < 2)).select(*pool.columns)


def next_pairs(pool: DataFrame, weights: Column, votes: int, seed: int, draws: int = 31) -> DataFrame:
    """Per city, the pair a model is least sure of out of a seeded sample (E8); any pair of it before five votes.

    The first camera of a draw is random; so is its partner, by joining two seeded
    samples on the draw number, so that cities of any size give `draws` pairs.
    """
    pick = lambda s, q: top_per(pool.withColumn("_r", _shuffled("camera_id", seed=s)), ["region_id"], [F.col("_r"), F.col("camera_id")], draws, "draw").select(
        "region_id", "draw", F.col("camera_id").alias(f"{q}_id"), F.col("x").alias(f"{q}_x"))
    pairs = pick(seed, "a").join(pick(seed + 1, "b"), ["region_id", "draw"]).filter(F.col("a_id") != F.col("b_id"))
    z = dot(weights, F.zip_with("a_x", "b_x", lambda a, b: a - b))
    doubt = F.abs(1.0 / (1.0 + F.exp(-z)) - 0.5)
    order = F.col("doubt") if votes >= PREFERENCE.asked_at_random else F.col("draw").cast("double")
    best = pairs.withColumn("doubt", doubt).groupBy("region_id").agg(F.min(F.struct(order.alias("order"), "a_id", "b_id", "doubt")).alias("p"))
    return best.select("region_id", "p.a_id", "p.b_id", "p.doubt")


def next_eval_pairs(pool: DataFrame, opposed: DataFrame, seed: int) -> DataFrame:
    """Per city, half the time a pair of its pool the rankings order oppositely, else any pair, sides shuffled."""
    for end in ("a_id", "b_id"):
        opposed = opposed.join(pool.select(F.col("camera_id").alias(end)), end, "left_semi")
    coin = _coin("region_id", seed)
    split = top_per(opposed.withColumn("_r", _shuffled("a_id", "b_id", seed=seed)), ["region_id"], [F.col("_r")], 1).select("region_id", F.col("a_id").alias("d_a"), F.col("b_id").alias("d_b"))
    two = top_per(pool.withColumn("_r", _shuffled("camera_id", seed=seed + 1)), ["region_id"], [F.col("_r")], 2, "n")
    any_two = two.groupBy("region_id").agg(F.max(F.when(F.col("n") == 1, F.col("camera_id"))).alias("r_a"), F.max(F.when(F.col("n") == 2, F.col("camera_id"))).alias("r_b"))
    out = any_two.filter(F.col("r_b").isNotNull()).join(split, "region_id", "left")
    use = coin & F.col("d_a").isNotNull()
    swap = _coin("region_id", seed + 2)
    a, b = F.when(use, F.col("d_a")).otherwise(F.col("r_a")), F.when(use, F.col("d_b")).otherwise(F.col("r_b"))
    return out.select("region_id", F.when(swap, b).otherwise(a).alias("a_id"), F.when(swap, a).otherwise(b).alias("b_id"), F.when(use, "disagree").otherwise("random").alias("stratum"))
