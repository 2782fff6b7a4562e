"""Quality rules: base rules on repetition, and robust multivariate outliers.

Each document that passes the base rules gives a vector of transformed statistics. For each language
and source, however small, a minimum-covariance-determinant estimate is fitted over all of its
documents: from two robust starts, concentration steps keep the CORE_SHARE of the group with the
smallest Mahalanobis distances and refit until no determinant falls any more, and the start with the
smaller determinant wins. One reweighting step (all documents within the 97.5 % ellipsoid) makes the
estimate efficient. Documents far from the centre of their group are rejected.

Small groups are no special case: the moments that reweighting leaves are drawn towards those of the
language (all of its sources together), and these towards those of the corpus, with the weight of
PRIOR documents: an estimate is (n own + PRIOR parent) / (n + PRIOR) in centre and covariance, so a
group of 10 is nearly its language's, one of 10,000 its own, and nothing changes at any size at once.

Every covariance is regularised by the identity in units of the least scales below (a minimum
regularised covariance determinant): where nearly all of a group has one value, a deviation below that
scale counts by the scale and not by the spread of zero.

A step costs two aggregations over the narrow table of vectors; map-side combining leaves one row for
each group and task, so a source with a third of all rows is no hot spot.

Defined cases: a null text has no words and fails the base rules; null lang and null source are
groups of their own; rows with null or repeated doc_ids each keep one result row; a document that is
alone in its corpus is kept if it passes the base rules; an empty input gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Memo, hash_cache, materialise, small, windows, word_hashes

MIN_WORDS = 20
REPEAT_WINDOW, REPEAT_PERCENT = 8, 30
#: Share of a group that the concentration steps keep; the fall of a log determinant that counts as none; steps at most.
CORE_SHARE, SETTLED, STEPS = 0.75, 1e-3, 200
#: Documents that the estimate of the next wider group counts for.
PRIOR = 50.0
MAX_GROUPS = 10_000
#: Statistic vector and, in its units, the least scale that counts as a deviation of one: the words of a
#: clean text vary this much by chance, also where more than half of a group has exactly the same value.
DIMENSIONS = (
    ("log_word_chars", 0.15),
    ("log_symbols", 0.4),
    ("log_dup_lines", 1.0),
    ("log_repeats", 1.0),
    ("log_upper", 0.5),
    ("log_marks", 0.5),
    ("root_adjacent", 0.12),
)
#: Chi-square quantiles for 7 degrees of freedom: 0.975 (reweighting) and 0.999 (rejection).
CHI_WEIGHT, CHI_REJECT = 16.013, 24.322
#: P(chi2_9 <= q) for the 0.75 and 0.975 quantiles q of chi2_7: the variance that truncation leaves, times the share kept.
LEFT_CORE, LEFT_WEIGHT = 0.5661, 0.9332
D = len(DIMENSIONS)
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#*$%&|<>"
_MARKS = b"!?\"'()[]{}/\\=+~^_@:;`-"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_adjacent")


def text_stats(text: str, cache: Memo) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()  # bytes.split knows exactly \x20 and \x09-\x0D
    n = len(words)
    spaces = sum(raw.count(c) for c in b" \t\n\x0b\x0c\r")
    lines = text.split("\n")
    seen: set[str] = set()
    dup_lines = 0
    for line in lines:
        if line in seen:
            dup_lines += bool(line.encode().split())
        else:
            seen.add(line)
    repeats = 0
    hashes = word_hashes(cache, words)
    adjacent = int((hashes[1:] == hashes[:-1]).sum())
    grams = windows(hashes, REPEAT_WINDOW)
    if len(grams) > 1:
        order = np.argsort(grams, kind="stable")
        ranked = grams[order]
        twin = ranked[1:] == ranked[:-1]
        if twin.any():
            again = np.zeros(len(grams), bool)
            again[order[1:][twin]] = True
            again[order[:-1][twin]] = True
            marks = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(again)
            np.add.at(marks, at, 1)
            np.add.at(marks, at + REPEAT_WINDOW, -1)
            repeats = int((np.cumsum(marks[:n]) > 0).sum())
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    return n, len(text) - spaces, without(_SYMBOLS), dup_lines, repeats, without(_UPPER), without(_MARKS), adjacent


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = hash_cache()
    for batch in batches:
        found = [text_stats(t.as_py() or "", cache) for t in batch.column("text")]
        table = np.array(found, np.int64).reshape(len(found), len(STATS))
        keys = [batch.column(c) for c in ("doc_id", "lang", "source")]
        yield pa.RecordBatch.from_arrays([*keys, *(pa.array(table[:, i]) for i in range(len(STATS)))], ["doc_id", "lang", "source", *STATS])


def measure(docs: DataFrame) -> DataFrame:
    """The counters of each whole text, and base_failed."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in STATS)
    rows = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), "text").select("doc_id", "lang", "source", "text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.mapInArrow(_measure, schema).withColumn("base_failed", failed)


def vector() -> list[Column]:
    """Transformed statistics in units of their least scale; only for rows with words."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    share = lambda c, of: F.log1p(100.0 * F.col(c) / of)
    raw = [F.log(chars / words), share("n_symbols", chars), share("n_dup_lines", words), share("n_repeat_words", words), share("n_upper", chars), share("n_marks", chars), F.sqrt(F.col("n_adjacent") / words)]
    return [(x / scale).alias(f"x{i}") for i, (x, (_, scale)) in enumerate(zip(raw, DIMENSIONS, strict=True))]


X = [f"x{i}" for i in range(D)]
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
KEYS = ["lang", "source"]
SUMS = ["n", *(f"s{i}" for i in range(D)), *(f"q{i}_{j}" for i, j in PAIRS)]


def _moments() -> list[Column]:
    v = lambda i: F.col(f"x{i}")
    return [F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(v(i)).alias(f"s{i}") for i in range(D)), *(F.sum(v(i) * v(j)).alias(f"q{i}_{j}") for i, j in PAIRS)]


def _estimate(rows: pd.DataFrame, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of each row of sums."""
    n = np.maximum(rows[f"{prefix}n"].to_numpy(float), 1.0)[:, None]
    centre = rows[[f"{prefix}s{i}" for i in range(D)]].to_numpy(float) / n
    cov = np.zeros((len(rows), D, D))
    for i, j in PAIRS:
        cov[:, i, j] = cov[:, j, i] = rows[f"{prefix}q{i}_{j}"].to_numpy(float) / n[:, 0] - centre[:, i] * centre[:, j]
    return centre, cov


def regularised(cov: np.ndarray, left: float) -> tuple[np.ndarray, np.ndarray]:
    """Inverse and log determinant, with the truncated variance made up for and unit ridge in scaled units."""
    cov = cov / left + np.eye(D)  # a deviation below the least scale never counts as more than it
    return np.linalg.inv(cov), np.linalg.slogdet(cov)[1]


#: The groups' estimates: few rows, solved inside tasks of Spark, never on the driver.
MODEL = "lang string, source string, start int, logdet double, fall double, centre array<double>, inverse array<double>"


def _core_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in frames:
        if len(rows):
            centre, cov = _estimate(rows)
            inverse, logdet = regularised(cov, LEFT_CORE / CORE_SHARE)
            out = rows[[*KEYS, "start"]].copy()
            out["logdet"], out["fall"] = logdet, rows["before"].to_numpy(float) - logdet
            out["centre"], out["inverse"] = list(centre), list(inverse.reshape(len(rows), -1))
            yield out


def _shrunk_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each group's estimate drawn to that of its language, and that to the corpus's."""
    for rows in frames:
        if len(rows):
            centre, cov = _estimate(rows, "all_")
            for prefix in ("lang_", ""):
                own, spread = _estimate(rows, prefix)
                share = (rows[f"{prefix}n"].to_numpy(float) / (rows[f"{prefix}n"].to_numpy(float) + PRIOR))[:, None]
                centre, cov = share * own + (1 - share) * centre, share[:, :, None] * spread + (1 - share[:, :, None]) * cov
            out = rows[KEYS].copy()
            out["centre"], out["inverse"] = list(centre), list(regularised(cov, LEFT_WEIGHT / 0.975)[0].reshape(len(rows), -1))
            yield out


def distance(centre: str = "centre", inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance, as one expression that stays in generated code."""
    gap = [F.col(f"x{i}") - F.col(centre)[i] for i in range(D)]
    terms = [gap[i] * gap[j] * F.col(inverse)[i * D + j] * (1 if i == j else 2) for i, j in PAIRS]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def _match(rows: DataFrame, model: DataFrame, keys: list[str] = KEYS, how: str = "inner") -> DataFrame:
    right = model.select(*(F.col(k).alias(f"m_{k}") for k in keys), *(c for c in model.columns if c not in keys))
    same = [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in keys]
    return rows.join(right, same, how).drop(*(f"m_{k}" for k in keys))


def _starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Start 0: medians, the median absolute deviations on the diagonal. Start 1: the covariance of tanh scores about them, which no far point can dominate."""
    for g in frames:
        for start in (0, 1):
            if not len(g):
                continue
            cov = np.tile(np.eye(D), (len(g), 1, 1))
            for i, j in PAIRS:
                if start == 0 and i == j:
                    cov[:, i, i] += (1.4826 * g[f"madx{i}"].to_numpy(float)) ** 2
                if start == 1:
                    cov[:, i, j] += g[f"t{i}_{j}"].to_numpy(float)
                    cov[:, j, i] = cov[:, i, j]
            out = g[KEYS].copy()
            out["start"], out["logdet"], out["fall"] = start, np.inf, np.inf
            out["centre"] = list(g[[f"medx{i}" for i in range(D)]].to_numpy(float))
            out["inverse"] = list(np.linalg.inv(cov).reshape(len(g), -1))
            yield out


def fit(stats: DataFrame) -> DataFrame:
    """lang, source, centre, inverse: one estimate for each language and source with a document that passes the base rules."""
    rows = materialise(stats.where(~F.col("base_failed")).select(*KEYS, *vector()), "quality-vectors")
    middle = rows.groupBy(*KEYS).agg(*(F.percentile_approx(x, 0.5, 2000).alias(f"med{x}") for x in X))
    middle = materialise(middle, "quality-middle")
    hint = F.broadcast if middle.count() <= MAX_GROUPS else (lambda df: df)  # no later table has more than two rows for each of these
    centred = _match(rows, hint(middle)).select(*KEYS, *(F.col(f"med{x}") for x in X), *((F.col(x) - F.col(f"med{x}")).alias(x) for x in X))
    spread = centred.groupBy(*KEYS).agg(
        *(F.max(f"med{x}").alias(f"med{x}") for x in X),
        *(F.percentile_approx(F.abs(x), 0.5, 2000).alias(f"mad{x}") for x in X),
        *(F.avg(F.tanh(F.col(f"x{i}")) * F.tanh(F.col(f"x{j}"))).alias(f"t{i}_{j}") for i, j in PAIRS),
    )
    model = materialise(spread.mapInPandas(_starts, MODEL), "quality-start")
    # Estimates that have settled (or rise, as a step by an approximate cut can) leave the steps; the others go on.
    # Of all steps the one with the least determinant counts. Falls end, as a ridge bounds determinants below.
    done, active = [], model
    for _ in range(STEPS):
        step = _concentrate(rows, active, hint)
        done.append(step)
        active = step.where(F.col("fall") > SETTLED)
        if not active.limit(1).count():
            break
    else:
        raise RuntimeError(f"covariance estimates have not settled after {STEPS} steps")
    model = done[0]
    for more in done[1:]:
        model = model.unionAll(more)
    best = model.groupBy(*KEYS).agg(F.min_by(F.struct("centre", "inverse"), F.struct("logdet", "start")).alias("best"))
    best = materialise(best.select(*KEYS, "best.centre", "best.inverse"), "quality-core")
    near = _match(rows, hint(best)).where(distance() <= CHI_WEIGHT)
    own = materialise(near.groupBy(*KEYS).agg(*_moments()), "quality-moments")
    wider = own.groupBy("lang").agg(*(F.sum(c).alias(f"lang_{c}") for c in SUMS))
    whole = own.agg(*(F.sum(c).alias(f"all_{c}") for c in SUMS)).first()
    # A group whose every document lies outside its ellipsoid still has its language's and the corpus's estimate.
    joined = _match(_match(best.select(*KEYS), own, how="left").na.fill(0.0, SUMS), wider, ["lang"], "left").na.fill(0.0, [f"lang_{c}" for c in SUMS])
    joined = joined.select("*", *(F.lit(float(whole[f"all_{c}"] or 0.0)).alias(f"all_{c}") for c in SUMS))
    return materialise(joined.mapInPandas(_shrunk_rows, "lang string, source string, centre array<double>, inverse array<double>"), "quality-model")


def _concentrate(rows: DataFrame, model: DataFrame, hint) -> DataFrame:
    """One concentration step: refit each estimate on the share of its group that lies nearest."""
    keys = [*KEYS, "start"]
    measured = _match(rows, hint(model)).select(*keys, "logdet", distance().alias("d2"), *X)
    cuts = measured.groupBy(*keys).agg(F.percentile_approx("d2", CORE_SHARE, 2000).alias("cut"))
    core = _match(measured, hint(cuts), keys).where(F.col("d2") <= F.col("cut"))
    moments = core.groupBy(*keys).agg(F.max("logdet").alias("before"), *_moments())
    return materialise(moments.mapInPandas(_core_rows, MODEL), "quality-step")


def judge(stats: DataFrame, model: DataFrame) -> DataFrame:
    """distance2 to the estimate of the row's language and source, and kept."""
    chosen = _match(stats.select("*", *vector()), small(model, MAX_GROUPS), how="left")
    scored = chosen.withColumn("distance2", F.when(~F.col("base_failed"), distance()))
    kept = ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= CHI_REJECT)
    return scored.withColumn("kept", kept).drop("centre", "inverse", *X)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counters, base_failed, distance2 and kept for each row."""
    stats = materialise(measure(docs), "quality-stats")
    return judge(stats, fit(stats))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance2", 3).alias("distance2")
    )
