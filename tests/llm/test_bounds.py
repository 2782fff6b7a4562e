"""Memory bounds of caches, samples and broadcasts; calibration on short texts; cuts of large groups."""

import sys
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshquill.llm import language, mixing, quality, shared, tokens, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_caches_stay_flat_on_long_and_endless_words():
    cache = shared.Memo(lambda w: len(w))
    for i in range(50_000):
        assert cache[b"%06d" % i * 170] == 1020
    assert not cache  # words of 1 KB are never kept
    cache = shared.Memo(lambda w: w * 3, most_bytes=1 << 20)
    for i in range(50_000):
        assert cache[f"word{i}"] == f"word{i}" * 3
        assert sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in cache.items()) < 2 << 20 if i % 5000 == 0 else True
    encoder = tokens.LengthEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"{i} " + "".join(chr(0x4E00 + (i * 31 + k) % 5000) for k in range(400)) + " end" for i in range(300)]
    want = [len(encoder.model.encode(t, add_special_tokens=False).ids) for t in texts]
    assert encoder.counts(texts) == want == encoder.counts(texts) and all(len(p) <= shared.CACHE_KEY for p in encoder.lengths)


def test_samples_are_chosen_without_their_texts(spark, capsys):
    docs = spark.createDataFrame([(i, "x" * (i % 50), "en" if i % 2 else "de") for i in range(400)], "doc_id long, text string, lang string")
    rows = docs.select("doc_id", "lang", F.xxhash64("text").alias("tie"), F.octet_length("text").cast("long").alias("n_bytes"), F.hash("doc_id").alias("rank"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    got = shared.bounded_sample(rows, texts, ["rank", "doc_id"], 100, 1000).toPandas()
    frame = rows.orderBy("rank", "doc_id").toPandas().head(100)
    keep = frame[frame["n_bytes"].cumsum().shift(fill_value=0) < 1000]
    assert got["doc_id"].tolist() == keep["doc_id"].tolist() and (got["text"].str.len() == got["doc_id"] % 50).all()
    rows.orderBy("rank", "doc_id").limit(100).explain("formatted")
    assert "text" not in capsys.readouterr().out.split("TakeOrderedAndProject")[-1].split("Output")[-1].splitlines()[0]


def test_broadcast_counts_the_numbers_in_arrays(spark):
    table = spark.range(10).select("id", F.array_repeat(F.lit(1.0), 1000).alias("v"))
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(shared.small(table, 10, F.size("v"), 10_000)) and not hinted(shared.small(table, 10, F.size("v"), 9_999)) and not hinted(shared.small(table, 9))
    docs = spark.createDataFrame([(i, "text", f"s{i % 2}") for i in range(6)], "doc_id long, text string, source string")
    assert mixing.replicate(docs).count() >= 0


def test_labels_without_documents_leave_the_sample_to_others(spark):
    docs = spark.createDataFrame([(i, "bad bad words here" if i % 2 else "good kind words here") for i in range(300)], "doc_id long, text string")
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic")).unionAll(spark.range(10_000, 40_000).select("id", F.lit(0).alias("toxic")))
    at, weights = toxicity.fit(docs, labels, most=200)
    assert len(at) and weights.max() > 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_language_scores_are_calibrated_on_short_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs)
    assert 0.06 < model["temperature"] < 19
    frame = pd.read_parquet(f"{sf}/documents.parquet")
    frame = frame[[zlib.crc32(str(i).encode()) % 3 == 1 for i in frame.doc_id]]
    short = [(c, lang) for k, (t, lang) in enumerate(zip(frame.text, frame.lang, strict=True)) if isinstance(t, str) for c in language.cuts(t, k)]
    short = [(i, c, lang) for i, (c, lang) in enumerate(short)]
    got = language.predict(spark.createDataFrame(short, "doc_id long, text string, lang string"), model).toPandas().set_index("doc_id")
    right = np.array([got.lang_pred[i] == lang for i, _, lang in short if got.score[i] > 0])
    score = np.array([got.score[i] for i, _, _ in short if got.score[i] > 0])
    bins = np.minimum((score * 10).astype(int), 9)
    error = sum(abs(right[bins == b].mean() - score[bins == b].mean()) * (bins == b).mean() for b in np.unique(bins))
    assert error < 0.08, error


def test_one_group_of_twenty_thousand_keeps_its_share(spark):
    """The cut of a large group is approximate within 1 in 2,000 of its rows; planted outliers go, the others stay."""
    rng = np.random.default_rng(2)
    n = 20_000
    stats = [(i, "en", "a", 500, 2500, 0, 0, 0, int(a), int(b), int(c)) for i, (a, b, c) in enumerate(zip(rng.integers(20, 40, n), rng.integers(0, 20, n), rng.integers(0, 10, n), strict=True))]
    stats += [(n + i, "en", "a", 500, 2500, 900, 0, 0, 1500, 10, 5) for i in range(2000)]
    df = spark.createDataFrame(stats, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in quality.STATS)).withColumn("base_failed", F.lit(False))
    judged = quality.judge(df, quality.fit(df)).groupBy((F.col("doc_id") >= n).alias("planted")).agg(F.avg(F.col("kept").cast("int")).alias("share"))
    share = {r["planted"]: r["share"] for r in judged.collect()}
    assert share[True] == 0.0 and share[False] > 0.97


def test_pipeline_of_long_texts_and_clashing_columns(spark, tmp_path):
    """Very long texts go through all stages whole, and columns that stages use themselves stay out of their way."""
    import corpus_pipeline

    rng = np.random.default_rng(8)
    text = lambda n: " ".join(f"word{i}" for i in rng.integers(0, 5000, n))
    rows = [(i, text(60 + i % 40), "en", "a", 1) for i in range(60)] + [(100, text(60_000), "en", "a", 1), (101, None, None, None, None), (102, "", "en", "a", 0)]
    docs = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"n_chars": "Int64"})
    docs.assign(rep=1, kept="x", rate=0.5, copy="y", digest=None, sequence_id=3, start="s", length=1.0).to_parquet(tmp_path / "documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out.doc_id) <= set(range(60)) | {100} and not {101, 102} & set(out.doc_id) and len(set(out.doc_id)) > 40
    for _, pieces in out[out.start == 0].groupby("doc_id"):
        assert (pieces.doc_tokens > 0).all()
