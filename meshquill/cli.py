"""Commands: inspect, validate, axes, landmarks, symmetry, features, describe, ratings, splits, train, evaluate. Each returns an exit code.

    python -m meshquill.cli --root PROJECT validate

A project is a folder (see `stores.Layout`): captures in data/raw, ratings in data/labels, tables in
data/processed, conventions in config, models and reports in models and outputs.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import features, landmarks, metrics, models, normalise, ratings, shap, splits, symmetry, validation
from .session import session
from .sources import captures, stores


def _captures(spark: SparkSession, at: stores.Layout, args) -> DataFrame:
    aliases = captures.load_aliases(spark, args.schema_map)[0] if args.schema_map else captures.ALIASES
    return captures.load_captures(spark, at.raw, aliases=aliases)


def _convention(spark: SparkSession, at: stores.Layout) -> normalise.AxisConvention:
    return normalise.AxisConvention.loads(json.dumps(stores.read_document(spark, f"{at.config}/axis_convention.json")))


def _marks(spark: SparkSession, at: stores.Layout) -> landmarks.LandmarkSet:
    """The project's landmark set; an empty one where none has been saved."""
    try:
        return landmarks.LandmarkSet.loads(json.dumps(stores.read_document(spark, f"{at.config}/landmarks.json")))
    except FileNotFoundError:
        return landmarks.LandmarkSet()


def _one(spark: SparkSession, at: stores.Layout, args) -> DataFrame:
    """The capture named by --capture (its key, file name or capture id), or the first of the project."""
    c = captures.loaded(_captures(spark, at, args))
    if args.capture:
        c = c.where((F.col("capture_key") == args.capture) | F.col("capture_key").endswith("/" + args.capture) | (F.col("capture_id") == args.capture))
    found = c.orderBy("capture_key").limit(1)
    if not found.count():
        raise FileNotFoundError(f"no capture {args.capture or 'that can be loaded'} in {at.raw}")
    return found


def inspect(spark: SparkSession, at: stores.Layout, args) -> int:
    """Where the cohort has each field, and the facts of the first captures."""
    c = _captures(spark, at, args)
    captures.inspect_schema(c).orderBy("field").show(100, False)
    captures.summaries(c).orderBy("capture_key").show(args.top, False)
    return int(captures.loaded(c).limit(1).count() == 0)


def validate(spark: SparkSession, at: stores.Layout, args) -> int:
    c = _captures(spark, at, args)
    found = validation.issues(c)
    statuses = validation.status(c, found)
    text = validation.render(found, statuses)
    print(text)
    # The report holds every note, participant and issue: Spark writes it, and the driver gets none of its lines.
    line = lambda df, *parts: df.select(F.concat_ws(" ", *(F.col(p).cast("string") for p in parts)).alias("value"), F.concat_ws("\t", *(F.col(p).cast("string") for p in parts)).alias("__at"))
    several = validation.repeated_participants(statuses).withColumn("note", F.lit("participant with several captures:"))
    sections = [
        spark.createDataFrame([(text, "")], "value string, __at string"), line(validation.cohort_notes(captures.loaded(c)), "note", "detail", "n"),
        line(several, "note", "participant_id", "n_captures"), line(found, "capture_key", "severity", "code", "message"),
    ]
    report = None
    for i, section in enumerate(sections):
        section = section.withColumn("__section", F.lit(i))
        report = section if report is None else report.unionByName(section)
    report.orderBy("__section", "__at").select("value").write.mode("overwrite").text(f"{at.outputs}/validation_report.txt")
    return validation.exit_code(statuses)


def axes(spark: SparkSession, at: stores.Layout, args) -> int:
    if args.action == "detect":
        found = normalise.detect_axes(captures.loaded(_captures(spark, at, args)))
        found.confirmed_by_user = args.confirm
        margin = found.evidence["margin"]
        if not isinstance(margin, str) and margin < 2:
            print(f"warning: left-right is not clearly set apart from the other axes (margin {margin:.2f}, below 2): look at a mesh before trusting it")
        if args.dry_run:
            print(found.dumps())
            return 0
        stores.write_document(spark, asdict(found), f"{at.config}/axis_convention.json")
    print(_convention(spark, at).dumps())
    return 0


def mark(spark: SparkSession, at: stores.Layout, args) -> int:
    """The landmark set: show it, assign vertices to names, check it against the cohort, or show where it lies on a capture."""
    marks = _marks(spark, at)
    if args.action == "assign":
        given = dict(x.split("=", 1) for x in args.pairs)
        n = _one(spark, at, args).select(F.size("points")).first()[0]
        for name, vid in given.items():
            if not 0 <= int(vid) < n:
                print(f"{name}: no vertex {vid} in a mesh of {n}")
                return 1
            marks = marks.set(name, int(vid))
        marks.vertex_count = n
        stores.write_document(spark, marks.dumps(), f"{at.config}/landmarks.json")
    if args.action in ("show", "assign"):
        print(landmarks.report(marks))
        return 0
    if not marks.indices:
        print("no landmarks are defined")
        return int(args.action == "verify")
    if args.action == "verify":
        one = _one(spark, at, args)
        if not one.where(marks.applies()).count():
            print(f"the landmarks belong to meshes of {marks.vertex_count} vertices")
            return 1
        landmarks.verify(one, marks).orderBy("name").show(len(marks.indices), False)
        return 0
    cohort = captures.loaded(_captures(spark, at, args))
    landmarks.check(cohort, marks).orderBy("n_vertices").show(args.top, False)
    wrong = landmarks.mismatched(cohort, marks)
    wrong.orderBy("capture_key").show(args.top, False)
    for a, b in marks.one_sided():
        print(f"on one side only: {a}, {b}")
    return int(wrong.limit(1).count() > 0)


def measure(spark: SparkSession, at: stores.Layout, args) -> int:
    """Symmetry of one capture in its canonical frame."""
    one = normalise.normalise(_one(spark, at, args), _convention(spark, at))
    found = symmetry.verdict(symmetry.measure_symmetry(one.where("error IS NULL"), args.method, not args.no_fit)).drop("per_vertex")
    problems = one.where("error IS NOT NULL").select("capture_key", "error").collect()
    found.show(1, False, True)
    for r in problems:
        print(f"{r['capture_key']}: {r['error']}")
    return int(bool(problems))


def describe(spark: SparkSession, at: stores.Layout, args) -> int:
    """What a feature table holds: coverage of each column, and captures of each participant."""
    table = stores.read_features(spark, args.path or f"{at.processed}/features.parquet")
    features.coverage(table, features.feature_columns(table)).orderBy("coverage", "name").show(len(table.columns), False)
    print(splits.split_report(table))
    return 0


def split(spark: SparkSession, at: stores.Layout, args) -> int:
    table = stores.read_features(spark, args.path or f"{at.processed}/features.parquet").select(*features.IDS)
    print(splits.split_report(table))
    sides = splits.participant_split(table, args.test_size, args.seed)
    splits.assert_no_leakage(sides.where("side = 'train'"), sides.where("side = 'test'"))
    counts = (F.count(F.lit(1)).alias("n_captures"), F.countDistinct("participant_id").alias("n_participants"))
    sides.groupBy("side").agg(*counts).orderBy("side").show()
    if args.folds:
        splits.participant_folds(table, args.folds).groupBy("fold").agg(*counts).orderBy("fold").show(args.folds)
    return 0


def build_features(spark: SparkSession, at: stores.Layout, args) -> int:
    c = captures.loaded(_captures(spark, at, args))
    table, problems = features.build_feature_table(c, _convention(spark, at), args.origin, args.scale, args.procrustes, _marks(spark, at), args.method)
    out = args.out or f"{at.processed}/features.parquet"
    stores.write_table(table, out, ("participant_id", "capture_id"))
    left_out = problems.count()
    for r in problems.orderBy("capture_key").limit(args.top).collect():
        print(f"left out: {r['capture_key']}: {r['error']}")
    features.coverage(stores.read_features(spark, out), features.FEATURES).orderBy("coverage", "name").show(args.top, False)
    return int(left_out > 0)


def rate(spark: SparkSession, at: stores.Layout, args) -> int:
    if args.action == "template":
        print(stores.ratings_template(spark, f"{at.labels}/ratings.csv.template"))
        return 0
    r = ratings.load_ratings(spark, f"{at.labels}/ratings.csv")
    problems = ratings.problems(r, ratings.RatingScale(args.scale_min, args.scale_max)).collect()
    for p in problems:
        print(f"{p['problem']}: {p['n']}")
    out = args.out or f"{at.processed}/targets.parquet"
    targets = ratings.targets(r, args.confidence, args.min_ratings)
    if args.bootstrap:
        targets = targets.join(ratings.bootstrap(r, args.confidence).drop("n_ratings"), "participant_id", "left").orderBy("participant_id")
    stores.write_table(targets, out)
    ratings.target_summary(stores.read_targets(spark, out)).show(1, False, True)
    block, whole = ratings.complete_block(r)
    print("reliability of all raters" if whole else "reliability without the raters with the most gaps")
    ratings.icc(block).show(1, False, True)
    return int(bool(problems))


def train(spark: SparkSession, at: stores.Layout, args) -> int:
    table = stores.read_features(spark, f"{at.processed}/features.parquet")
    data = models.assemble(table, stores.read_targets(spark, f"{at.processed}/targets.parquet"), [c for c in table.columns if c in features.FEATURES], args.min_ratings)
    weight = None if args.no_weights else "n_ratings"
    sizes = {"trees": args.trees, "rounds": args.rounds}
    best, results, warnings = models.compare(data, tuple(args.models), args.folds, args.test_size, args.seed, weight=weight, **sizes)
    about = models.report(data, best, results, warnings, weight, args.seed)
    stores.write_document(spark, about, f"{at.outputs}/training_report.json")
    print(json.dumps({"best_model": best, "warnings": warnings, "cv": {k: v["cv"] for k, v in results.items()}}, indent=2))
    if args.save:
        for name in args.models:
            fitted, _, _, held = models.train_final(data, name, args.test_size, args.seed, weight=weight, **sizes)
            stores.write_table(held.select("participant_id", "capture_id", "mean_rating", "predicted", "truth"), f"{at.outputs}/predictions_{name}.parquet", ("participant_id", "capture_id"))
            if name == best:
                fitted.save(f"{at.models}/{name}", spark, about)
    return 0


def evaluate(spark: SparkSession, at: stores.Layout, args) -> int:
    if args.predictions:
        predictions = stores.read_predictions(spark, args.predictions)
        print(json.dumps(metrics.evaluate(predictions), indent=2))
        if args.demographics and args.group_column:
            grouped = metrics.with_demographics(predictions, stores.read_demographics(spark, args.demographics, args.group_column), args.group_column)
            table = metrics.group_metrics(grouped)
            table.orderBy("grp").show(args.top, False)
            metrics.fairness(table).show(1, False)
    if args.model:
        fitted = models.Fitted.load(args.model, spark)
        print(fitted.importance(args.top).to_string(index=False))
        if args.shap:
            table = stores.read_features(spark, f"{at.processed}/features.parquet")
            values = shap.shap_values(fitted, table, f"{at.outputs}/shap_model", ["participant_id", "capture_id"])
            stores.write_table(values, f"{at.outputs}/shap_values.parquet")
            shap.shap_importance(stores.read_table(spark, f"{at.outputs}/shap_values.parquet"), args.top).show(args.top, False)
        print(models.NOTE)
    return int(not (args.predictions or args.model))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="meshquill", description=__doc__.splitlines()[0])
    p.add_argument("--root", default=".")
    p.add_argument("--schema-map")
    p.add_argument("--top", type=int, default=20)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, run):
        s = sub.add_parser(name)
        s.set_defaults(run=run)
        return s

    add("inspect", inspect)
    add("validate", validate)
    a = add("axes", axes)
    a.add_argument("action", choices=("detect", "show"))
    a.add_argument("--confirm", action="store_true", help="say that the convention has been looked at and is right")
    a.add_argument("--dry-run", action="store_true", help="print what is found and save nothing")
    m = add("landmarks", mark)
    m.add_argument("action", choices=("show", "assign", "check", "verify"))
    m.add_argument("pairs", nargs="*", metavar="NAME=VERTEX")
    m.add_argument("--capture")
    y = add("symmetry", measure)
    y.add_argument("--capture")
    y.add_argument("--method", default="point_to_surface", choices=("point_to_surface", "nearest_vertex"))
    y.add_argument("--no-fit", action="store_true")
    add("describe", describe).add_argument("--path")
    k = add("splits", split)
    k.add_argument("--path")
    k.add_argument("--test-size", type=float, default=0.2)
    k.add_argument("--seed", type=int, default=42)
    k.add_argument("--folds", type=int, default=0)
    f = add("features", build_features)
    f.add_argument("--origin", default="centroid", choices=normalise.ORIGINS)
    f.add_argument("--scale", default="centroid_size", choices=normalise.SCALES)
    f.add_argument("--method", default="point_to_surface")
    f.add_argument("--procrustes", action="store_true")
    f.add_argument("--out")
    r = add("ratings", rate)
    r.add_argument("action", choices=("aggregate", "template"))
    for name, value in (("--scale-min", 1.0), ("--scale-max", 10.0), ("--confidence", 0.95)):
        r.add_argument(name, type=float, default=value)
    r.add_argument("--min-ratings", type=int, default=0)
    r.add_argument("--bootstrap", action="store_true")
    r.add_argument("--out")
    t = add("train", train)
    t.add_argument("--models", nargs="+", default=list(models.MODELS), choices=models.MODELS)
    t.add_argument("--test-size", type=float, default=0.2)
    for name, value in (("--folds", 5), ("--seed", 42), ("--min-ratings", 3), ("--trees", 500), ("--rounds", 600)):
        t.add_argument(name, type=int, default=value)
    t.add_argument("--no-weights", action="store_true")
    t.add_argument("--save", action="store_true")
    e = add("evaluate", evaluate)
    for name in ("--model", "--predictions", "--demographics", "--group-column"):
        e.add_argument(name)
    e.add_argument("--shap", action="store_true")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or session()
    at = stores.Layout(args.root)
    at.ensure(spark)
    try:
        return args.run(spark, at, args)
    except FileNotFoundError as e:
        print(e)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
