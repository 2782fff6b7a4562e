"""Rating statistics: quality checks, consensus with intervals, reliability."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import known
from ..functions.special import t_quantile
from . import ranks

MAX_DF = 1000


@dataclass(frozen=True)
class RatingScale:
    low: float = 1.0
    high: float = 10.0


def load_ratings(spark: SparkSession, path: str) -> DataFrame:
    """CSV with participant_id, rater_id, rating; unreadable ratings become NULL, # starts a comment."""
    raw = spark.read.option("header", True).option("comment", "#").csv(path)
    missing = {"participant_id", "rater_id", "rating"} - set(raw.columns)
    if missing:
        raise ValueError(f"ratings lack {sorted(missing)}")
    return raw.select("participant_id", "rater_id", F.expr("try_cast(rating AS DOUBLE)").alias("rating"))


def clean(ratings: DataFrame) -> DataFrame:
    return ratings.withColumn("rating", known("rating")).dropna(subset=["rating"])


def out_of_range(ratings: DataFrame, scale: RatingScale = RatingScale()) -> DataFrame:  # noqa: B008
    return ratings.where((F.col("rating") < scale.low) | (F.col("rating") > scale.high))


def duplicates(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("participant_id", "rater_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def thin(ratings: DataFrame, least: int = 3) -> DataFrame:
    return ratings.groupBy("participant_id").agg(F.count("rating").alias("n")).where(F.col("n") < least)


def flat_raters(ratings: DataFrame, least: int = 5) -> DataFrame:
    """Raters of `least` ratings or more who always give the same."""
    return ratings.groupBy("rater_id").agg(F.count("rating").alias("n"), F.min("rating").alias("lo"), F.max("rating").alias("hi")).where((F.col("n") >= least) & (F.col("lo") == F.col("hi"))).select("rater_id", "n")


def unknown_subjects(ratings: DataFrame, captures: DataFrame) -> DataFrame:
    return ratings.select("participant_id").distinct().join(captures.select("participant_id").distinct(), "participant_id", "left_anti")


def problems(ratings: DataFrame, scale: RatingScale = RatingScale(), captures: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """(problem, n) for each check that found something."""
    found = [
        ("missing rating", ratings.where(known("rating").isNull())),
        ("rating outside the scale", out_of_range(ratings, scale)),
        ("more than one rating by a rater", duplicates(ratings)),
        ("participant with few ratings", thin(ratings)),
        ("rater who never varies", flat_raters(ratings)),
    ]
    if captures is not None:
        found.append(("rated participant without capture", unknown_subjects(ratings, captures)))
    out = None
    for name, rows in found:
        row = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
        out = row if out is None else out.unionByName(row)
    return out.where("n > 0")


def t_expanded(df: Column, confidence: float) -> Column:
    """Quantile of Student's t by its expansion in 1 / df about the normal quantile; exact to 1e-12 above MAX_DF degrees of freedom."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    terms = [z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    return sum((F.lit(t) / F.pow(df, k) for k, t in enumerate(terms)), F.lit(0.0))


def t_table(spark: SparkSession, confidence: float = 0.95) -> DataFrame:
    """(n, t) for group sizes 2..MAX_DF + 1; for larger groups there is `t_expanded`."""
    return spark.createDataFrame([(df + 1, t_quantile(0.5 + confidence / 2, df)) for df in range(1, MAX_DF + 1)], "n_key int, t double")


def consensus(ratings: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Mean, median, spread, standard error and t-interval for each participant."""
    g = clean(ratings).groupBy("participant_id").agg(
        F.avg("rating").alias("mean_rating"), F.median("rating").alias("median_rating"), F.stddev_samp("rating").alias("std_rating"),
        F.count("rating").alias("n_ratings"), F.min("rating").alias("min_rating"), F.max("rating").alias("max_rating"),
    )
    g = g.withColumn("sem_rating", F.col("std_rating") / F.sqrt("n_ratings")).withColumn("n_key", F.least(F.col("n_ratings"), F.lit(MAX_DF + 2)).cast("int"))
    g = g.join(F.broadcast(t_table(ratings.sparkSession, confidence)), "n_key", "left")
    t = F.when(F.col("n_ratings") > MAX_DF + 1, t_expanded(F.col("n_ratings") - 1, confidence)).otherwise(F.col("t"))
    half = t * F.col("sem_rating")
    return g.select(
        "participant_id", "mean_rating", "median_rating", "std_rating", "sem_rating", "n_ratings",
        (F.col("mean_rating") - half).alias("ci_low"), (F.col("mean_rating") + half).alias("ci_high"), (2 * half).alias("ci_width"), "min_rating", "max_rating",
    )


def targets(ratings: DataFrame, confidence: float = 0.95, min_ratings: int = 0) -> DataFrame:
    """The consensus of participants with enough ratings, in the order of their ids."""
    return consensus(ratings, confidence).where(F.col("n_ratings") >= min_ratings).orderBy("participant_id")


def target_summary(consensus: DataFrame) -> DataFrame:
    """One row on a cohort's targets: participants, ratings of each, spread between and within participants, width of the intervals.

    Medians are found by counted ranges, as no task may hold a column of all participants.
    """
    middle = ranks.quantiles(consensus, ["n_ratings", "std_rating", "ci_width"])
    median = lambda c: F.lit(middle[c]).cast("double")
    return consensus.agg(
        F.count(F.lit(1)).alias("n_participants"), median("n_ratings").alias("median_ratings"), F.min("n_ratings").alias("min_ratings"), F.max("n_ratings").alias("max_ratings"),
        F.avg("mean_rating").alias("mean_rating"), F.stddev_samp("mean_rating").alias("sd_between"), median("std_rating").alias("median_sd_within"), median("ci_width").alias("median_ci_width"),
    )


#: Distinct values of one participant that are resampled together; participants whose intervals leave a task together.
CHUNK, ROWS = 4096, 256
#: Values whose draws are made at once; the largest rate whose draws are read from a table.
BLOCK, TABLED = 128, 8
_STEP, _OPEN = np.uint64(0x9E3779B97F4A7C15), 0xFFFF


def _mixed(z: np.ndarray) -> np.ndarray:
    """64 uniform bits for each state of a counter (splitmix64); z is overwritten."""
    shifted = np.empty_like(z)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        np.right_shift(z, np.uint64(shift), out=shifted)
        np.bitwise_xor(z, shifted, out=z)
        if factor:
            np.multiply(z, np.uint64(factor), out=z)
    return z


@cache
def _poisson() -> tuple[np.ndarray, np.ndarray]:
    """Of each rate up to TABLED, the cumulative shares, and the two counts that 16 leading bits tell; _OPEN where further bits decide."""
    k, low = np.arange(1, 80), np.arange(1 << 16) / (1 << 16)
    shares = np.stack([np.cumsum(np.exp(-n) * np.cumprod(np.r_[1.0, n / k])) for n in range(TABLED + 1)])
    told = np.full((TABLED + 1, 1 << 16), _OPEN, np.uint16)
    for n in range(1, TABLED + 1):
        first, last = _inverted(shares[n], low), _inverted(shares[n], low + 1 / (1 << 16) - 2.0**-50)
        told[n] = np.where(first == last, first, _OPEN)
    return shares, told.reshape(-1)


def _inverted(shares: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Two independent counts in one number's bytes: the first by x, the second by where x lies within the first's share."""
    ones = np.searchsorted(shares, x, "right")
    edges = np.r_[0.0, shares, 1.0]
    twos = np.searchsorted(shares, (x - edges[ones]) / (edges[ones + 1] - edges[ones]), "right")
    return (ones | twos << 8).astype(np.uint16)


def poisson_draws(keys: np.ndarray, n: np.ndarray, resamples: int) -> np.ndarray:
    """(keys, resamples): Poisson counts at rates n, by inversion of uniform numbers that depend on the key and the resample alone.

    16 bits tell nearly all pairs of counts; the few that they leave open are told by 64 further ones, so no probability is
    rounded to the table. Counts at rates above TABLED are NumPy's.
    """
    shares, told = _poisson()
    pairs, tabled = -(-resamples // 2), np.minimum(n, TABLED).astype(np.int64)
    words = -(-pairs // 4)
    lead = _mixed(keys[:, None] + np.arange(1, words + 1, dtype=np.uint64) * _STEP).view(np.uint16)[:, :pairs]
    both = told.take(lead + (tabled << 16)[:, None], mode="clip")
    i, j = np.nonzero(both == _OPEN)
    more = _mixed(keys[i] + (j + (words + 1)).astype(np.uint64) * _STEP)
    x = (lead[i, j] + more / 2.0**64) / (1 << 16)
    for rate in np.unique(tabled[i]):
        here = tabled[i] == rate
        both[i[here], j[here]] = _inverted(shares[rate], x[here])
    counts = both.view(np.uint8)[:, :resamples].astype(float)
    for i in np.flatnonzero(n > TABLED):
        counts[i] = np.random.default_rng(int(keys[i])).poisson(n[i], resamples)
    return counts


def resample(keys: Callable[[int, int], list[int]], ratings: np.ndarray, n: np.ndarray, ends: np.ndarray, resamples: int) -> np.ndarray:
    """(participants, 2, resamples): how many ratings each resample has, and their sum.

    Participant p has the values ends[p] to ends[p + 1]; n[i] ratings of one value count Poisson(n[i]) times together. Keys
    are asked for by first and last value.
    """
    out, terms = np.zeros((len(ends) - 1, 2, resamples)), np.stack([np.ones(len(n)), ratings])
    for first in range(0, len(n), BLOCK):
        last = min(first + BLOCK, len(n))
        counts = poisson_draws(np.array(keys(first, last), np.uint64), n[first:last], resamples)
        for p in range(int(np.searchsorted(ends, first, "right")) - 1, int(np.searchsorted(ends, last, "left"))):
            a, b = max(ends[p], first), min(ends[p + 1], last)
            out[p] += np.ascontiguousarray(terms[:, a:b]) @ counts[a - first : b - first]
    return out


def bootstrap(ratings: DataFrame, confidence: float = 0.95, resamples: int = 2000, seed: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Percentile bootstrap interval of the mean, by Poisson weights.

    Each of a participant's ratings counts Poisson(1) times in a resample. Ratings are counted by value first,
    as n ratings of one value count Poisson(n) times together; the draws depend on participant and value
    alone. So sums over a participant's values can be taken in parts of at most `chunk` values, wherever
    they are, and added up; a participant of any size is never in one row. A participant with one part, as
    nearly all are, gets its interval where it is resampled, and none of its resamples are kept or shuffled; of
    others each part gives one row for each resample. A resample without any rating is left out. The draws of
    all values of a part are made together.
    """
    tail = (1 - confidence) / 2
    counted = clean(ratings).groupBy("participant_id", "rating").agg(F.count(F.lit(1)).alias("n"))
    values = counted.groupBy("participant_id").agg(F.count(F.lit(1)).alias("__values"), F.sum("n").alias("n_ratings"))
    values = values.withColumnRenamed("participant_id", "__participant")
    dealt = counted.join(values, F.col("participant_id").eqNullSafe(F.col("__participant"))).withColumn("__parts", F.ceil(F.col("__values") / chunk))
    part = F.pmod(F.xxhash64("rating"), F.col("__parts")).cast("int")
    # A given number of partitions: few bytes make much work here, and adaptive execution would join them to a few tasks.
    spread = dealt.withColumn("part", part).repartition(int(ratings.sparkSession.conf.get("spark.sql.shuffle.partitions")), "participant_id", "part")
    parts = spread.groupBy("participant_id", "n_ratings", "__parts", "part").agg(F.array_sort(F.collect_list(F.struct("rating", "n"))).alias("counts"))

    def interval(w: np.ndarray, t: np.ndarray) -> tuple[float | None, float | None]:
        means = np.sort(t[w > 0] / w[w > 0])
        ends = []
        for at in ((len(means) - 1) * share for share in (tail, 1 - tail)):
            low = means[int(np.floor(at))] if len(means) else None
            ends.append(None if low is None else float(low + (means[int(np.ceil(at))] - low) * (at - np.floor(at))))
        return ends[0], ends[1]

    names = ["participant_id", "n_ratings", "k", "w", "t", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        double = pa.float64()
        for whole in batches:
            for first in range(0, len(whole), ROWS):
                batch = whole.slice(first, ROWS)
                done, lows, highs = [], [], []
                ids, sizes, parts_of = (batch.column(c).to_pylist() for c in ("participant_id", "n_ratings", "__parts"))
                cells, ends = batch.column("counts").flatten(), np.r_[0, np.cumsum(batch.column("counts").value_lengths().to_numpy())]
                values, counts = cells.field("rating").to_numpy(), cells.field("n").to_numpy()
                owners = np.repeat(np.arange(len(batch)), np.diff(ends)).tolist()

                def keys(a: int, b: int) -> list[int]:
                    return [xxhash.xxh64_intdigest(f"{seed}:{ids[p]}:{rating!r}") for p, rating in zip(owners[a:b], values[a:b].tolist(), strict=True)]  # noqa: B023

                for i, (w, t) in enumerate(resample(keys, values, counts, ends, resamples)):
                    if parts_of[i] == 1:
                        low, high = interval(w, t) if sizes[i] > 1 else (None, None)
                        done.append(i)
                        lows.append(low)
                        highs.append(high)
                    else:
                        own = batch.select(["participant_id", "n_ratings"]).take(pa.array(np.full(resamples, i)))
                        none = pa.nulls(resamples, double)
                        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.arange(resamples, dtype=np.int32)), pa.array(w), pa.array(t), none, none], names)
                own = batch.select(["participant_id", "n_ratings"]).take(pa.array(done, pa.int64()))
                none = pa.nulls(len(done), double)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.nulls(len(done), pa.int32()), none, none, pa.array(lows, double), pa.array(highs, double)], names)

    kind = ratings.schema["participant_id"].dataType.simpleString()
    found = parts.select("participant_id", "n_ratings", "__parts", "counts").mapInArrow(run, f"participant_id {kind}, n_ratings long, k int, w double, t double, low double, high double")
    # Parts are added up resample by resample; of a participant, as many means as resamples come together.
    ends = [F.max(c).alias(c) for c in ("low", "high")]
    added = found.groupBy("participant_id", "n_ratings", "k").agg(F.sum("w").alias("w"), F.sum("t").alias("t"), *ends)
    each = added.groupBy("participant_id", "n_ratings").agg(F.array_sort(F.collect_list(F.try_divide("t", "w"))).alias("means"), *ends)

    def quantile(share: float) -> Column:
        at = (F.size("means") - 1) * share
        low, high = F.get("means", F.floor(at).cast("int")), F.get("means", F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    return each.select("participant_id", "n_ratings", F.coalesce("low", quantile(tail)).alias("boot_low"), F.coalesce("high", quantile(1 - tail)).alias("boot_high"))


def cells(ratings: DataFrame) -> DataFrame:
    """One mean for each participant and rater; the long form of the rating matrix."""
    return clean(ratings).groupBy("participant_id", "rater_id").agg(F.avg("rating").alias("v"))


def complete_block(ratings: DataFrame) -> tuple[DataFrame, bool]:
    """Cells of participants whom all (remaining) raters rated, and whether all raters remain.

    Participants with gaps go first; while fewer than two are left, the rater with the most gaps goes (of
    equal ones that of the least id). A rater's gaps don't depend on who else has gone, so raters go in one
    order, and a participant is complete for the first m raters that stay if those are among its own. The
    length of that run, one number for each participant, settles it: the largest m that two participants
    reach. No rater is collected and nothing is repeated.
    """
    c = cells(ratings)
    raters = c.groupBy("rater_id").agg(F.count(F.lit(1)).alias("__n"))
    ranked = ranks.global_rank(raters, F.desc("__n"), F.desc("rater_id")).select(F.col("rater_id").alias("__rater"), F.col("rank").alias("__rank"))
    placed = c.join(ranked, F.col("rater_id").eqNullSafe(F.col("__rater"))).drop("__rater")
    at = F.row_number().over(Window.partitionBy("participant_id").orderBy("__rank")) - 1
    runs = placed.withColumn("__at", at).groupBy("participant_id").agg(F.count_if(F.col("__at") == F.col("__rank")).alias("__run"))
    top = runs.groupBy("__run").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("__run")).limit(2).collect()
    n = ranked.count()
    reached = next((r["__run"] for r, k in zip(top, (top[0]["k"], 2), strict=False) if k >= 2), 0) if top else 0
    if reached < 2:
        return c.where(F.lit(False)), False
    full = runs.where(F.col("__run") >= reached).select(F.col("participant_id").alias("__full"))
    block = placed.where(F.col("__rank") < reached).join(full, F.col("participant_id").eqNullSafe(F.col("__full")), "left_semi")
    return block.select("participant_id", "rater_id", "v"), reached == n


def icc(block: DataFrame) -> DataFrame:
    """ICC(2,1) and ICC(2,k) of a complete block (participant_id, rater_id, v), as one row; no pivot.

    The means of raters are joined, and broadcast only where Spark finds them small: a few raters would be a few tasks in a window.
    """
    row = Window.partitionBy("participant_id")
    raters = block.groupBy(F.col("rater_id").alias("__rater")).agg(F.avg("v").alias("c"))
    totals = F.broadcast(block.agg(F.avg("v").alias("g"), F.countDistinct("participant_id").alias("n"), F.countDistinct("rater_id").alias("k")))
    m = block.withColumn("r", F.avg("v").over(row)).join(raters, F.col("rater_id").eqNullSafe(F.col("__rater"))).crossJoin(totals)
    s = m.agg(
        F.max("n").alias("n_participants"), F.max("k").alias("n_raters"),
        (F.sum(F.pow(F.col("r") - F.col("g"), 2)) / F.max(F.col("n") - 1)).alias("ms_rows"),
        (F.sum(F.pow(F.col("c") - F.col("g"), 2)) / F.max(F.col("k") - 1)).alias("ms_cols"),
        (F.sum(F.pow(F.col("v") - F.col("r") - F.col("c") + F.col("g"), 2)) / F.max((F.col("n") - 1) * (F.col("k") - 1))).alias("ms_err"),
    )
    single = "try_divide(ms_rows - ms_err, ms_rows + (n_raters - 1) * ms_err + n_raters * (ms_cols - ms_err) / n_participants)"
    return s.where("n_participants >= 2 AND n_raters >= 2").select(
        "n_participants", "n_raters", F.expr(single).alias("icc_single"), F.expr("try_divide(ms_rows - ms_err, ms_rows + (ms_cols - ms_err) / n_participants)").alias("icc_average")
    )
