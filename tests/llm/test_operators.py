"""Operators against brute force, round trips and held-out accuracy, and on odd inputs."""

import textwrap
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meshquill.llm import components, exact_dedup, ftrl, language, licence_texts, licenses, mixing, near_dedup, packing, quality, queries, shared, tokens, toxicity, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, very long and repeated texts, null keys, and columns whose names clash."""
    base = "one two three four five six seven eight nine ten " * 3
    long = " ".join(f"word{i % 7919}x{i}" for i in range(60_000))
    rows = [
        (1, None, None, None, None, 1.0, "x"), (2, "", "en", "a", 0, 1.0, "x"), (3, " \n\t ", "en", "a", 4, None, None), (4, base, "en", "a", 1, 1.0, "x"),
        (4, base, "en", "a", 1, 1.0, "x"), (5, base.upper(), "fr", None, 1, 1.0, "x"), (None, base, "en", "b", 1, 1.0, "x"), (6, long, "en", "b", 1, 1.0, "x"),
        (7, "é ü <|endoftext|>  tab\there nbsp\r\n", "de", "b", 1, 1.0, "x"), (8, "word", "de", "b", 1, 1.0, "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        db.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = db.sql(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    plain = lambda df: sorted(repr([None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in r]) for r in df.astype(object).itertuples(index=False, name=None))
    for c in want.columns:
        if want[c].dtype == float and str(got[c].dtype) in ("Int64", "int64"):
            want[c] = want[c].astype("Int64")
    assert plain(got) == plain(want)


def brute_stats(text):
    words = [w for w in text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(line.strip(" \t\x0b\x0c\r"))
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_quality_counters_and_verdicts(spark, documents, odd):
    got = queries.QUERIES["op1_quality_rules"](spark, SF).toPandas().set_index("doc_id")
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        r = got.loc[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_stats(text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed)
    rows = quality.quality_rules(odd).collect()
    assert len(rows) == 10 and all(r["base_failed"] for r in rows if (r["doc_id"] or 0) in (1, 2, 3, 8))
    assert quality.quality_rules(odd.where("false")).count() == 0


def test_mcd_is_not_pulled_by_outliers(spark):
    rng = np.random.default_rng(0)
    stats = [(i, "en", "a", 500, 2500, 0, 0, 0, int(rng.integers(20, 40)), int(rng.integers(0, 20)), int(rng.integers(0, 10))) for i in range(600)]
    stats += [(600 + i, "en", "a", 500, 2500, 900, 0, 0, 1500, 10, 5) for i in range(90)]
    df = spark.createDataFrame(stats, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in quality.STATS)).withColumn("base_failed", F.lit(False))
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(df, quality.fit(df)).collect()}
    assert all(kept[i] for i in range(600)) and not any(kept[i] for i in range(600, 690))


def brute_mcd(groups):
    """The estimates of quality.fit in plain NumPy: {(lang, source): vectors} to {(lang, source): (centre, covariance)}."""
    eye = np.eye(quality.D)
    cut = lambda d, share: np.sort(d)[max(int(np.ceil(share * len(d))), 1) - 1]
    far = lambda x, centre, cov: np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
    kept = {}
    for key, x in groups.items():
        middle = np.sort(x, axis=0)[max(int(np.ceil(0.5 * len(x))), 1) - 1]
        gap = x - middle
        mad = np.sort(np.abs(gap), axis=0)[max(int(np.ceil(0.5 * len(x))), 1) - 1]
        found = []
        for cov in (np.diag((1.4826 * mad) ** 2) + eye, np.tanh(gap).T @ np.tanh(gap) / len(x) + eye):
            centre, before = middle, np.inf
            while True:
                d = far(x, centre, cov)
                core = x[d <= cut(d, quality.CORE_SHARE)]
                centre, cov = core.mean(axis=0), np.cov(core.T, bias=True) / (quality.LEFT_CORE / quality.CORE_SHARE) + eye
                now = np.linalg.slogdet(cov)[1]
                if before - now <= quality.SETTLED:
                    break
                before = now
            found.append((now, centre, cov))
        _, centre, cov = min(found, key=lambda f: f[0])
        kept[key] = x[far(x, centre, cov) <= quality.CHI_WEIGHT]
    out = {}
    for key in groups:
        parts = [np.concatenate(list(kept.values())), np.concatenate([v for k, v in kept.items() if k[0] == key[0]]), kept[key]]
        centre, cov = parts[0].mean(axis=0), np.cov(parts[0].T, bias=True)
        for x in parts[1:]:
            share = len(x) / (len(x) + quality.PRIOR)
            if len(x):
                centre, cov = share * x.mean(axis=0) + (1 - share) * centre, share * np.cov(x.T, bias=True) + (1 - share) * cov
        out[key] = centre, cov / (quality.LEFT_WEIGHT / 0.975) + eye
    return out, far


def test_quality_verdicts_equal_plain_mcd(spark):
    """Every verdict over the test table equals that of the NumPy version, groups of one included."""
    got = quality.quality_rules(spark.read.parquet(f"{SF}/documents.parquet")).select("*", *quality.vector()).toPandas()
    good = got[~got.base_failed]
    groups = {k: g[quality.X].to_numpy(float) for k, g in good.groupby(["lang", "source"])}
    assert min(map(len, groups.values())) == 1 or len(groups) > 20
    model, far = brute_mcd(groups)
    for k, g in good.groupby(["lang", "source"]):
        d = far(g[quality.X].to_numpy(float), *model[k])
        assert np.allclose(d, g.distance2, rtol=1e-6, atol=1e-6)
        assert ((d <= quality.CHI_REJECT) == g.kept).all()
    assert got.kept.mean() > 0.7 and not got[got.base_failed].kept.any()


def test_quality_shrinks_small_groups_smoothly(spark):
    """The weight of a group's own estimate grows with its size, without a step; groups of one and null keys have estimates."""
    rng = np.random.default_rng(1)
    stats = [(i, lang, source, 400, 2000, 0, 0, 0, int(rng.integers(20, 40)), int(rng.integers(0, 20)), 4) for i, (lang, source) in enumerate([("en", "a")] * 300 + [("en", "b")] + [(None, None)] * 3)]
    df = spark.createDataFrame(stats, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in quality.STATS)).withColumn("base_failed", F.lit(False))
    model = {(r["lang"], r["source"]): np.array(r["centre"]) for r in quality.fit(df).collect()}
    assert set(model) == {("en", "a"), ("en", "b"), (None, None)} and np.abs(model["en", "a"] - model["en", "b"]).max() < 0.1
    assert all(r["kept"] for r in quality.judge(df, quality.fit(df)).collect())


def test_near_duplicates_equal_brute_force(spark, documents, odd):
    sets = {}
    for i, t in zip(documents.doc_id, documents.text, strict=True):
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in inverted[x]).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            inverted[x].append(i)
    got = near_dedup.op9_near_dedup(spark, SF).collect()
    assert all((r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"])) for r in got) and len(got) == len(sets)
    rows = near_dedup.near_duplicates(odd).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 10 and by[5]["component_id"] == 4 and by[1]["n_shingles"] == 0 and by[8]["n_shingles"] == 1 and by[None]["component_id"] is None
    assert near_dedup.near_duplicates(odd.where("false")).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    """An id with two texts joins the components of both; told apart by rows, it joins none."""
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    rows = [(5, a), (5, b), (6, [*a, "x"]), (7, [*b, "y"]), (None, [*a, "z"]), (None, ["n"] * 9), (None, ["n", "n"] * 5), (8, []), (None, []), (9, ["q"] * 7), (9, ["q"] * 7)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()]
    assert Counter(got) == Counter([(5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (None, None, False), (None, None, True), (None, None, False), (8, 8, True), (None, None, True), (9, 9, True), (9, 9, True)])
    got = near_dedup.near_rows(df, join_ids=False).where("kept").join(df.select("text", F.xxhash64("text").alias("raw")).distinct(), "raw").collect()
    kept = Counter((r["doc_id"], r["text"].split(" ")[0][:1]) for r in got)
    assert kept == Counter({(5, "a"): 1, (5, "b"): 1, (None, "n"): 1, (8, ""): 1, (None, ""): 1, (9, "q"): 2})


def test_near_duplicates_with_many_repeated_ids_equal_brute_force(spark):
    """Ids drawn with repeats and nulls over chains of altered texts."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(40):
        words = [f"t{k}w{i}" for i in range(80)]
        for _ in range(int(rng.integers(1, 6))):
            rows.append((int(rng.integers(0, 90)) if rng.random() < 0.9 else None, " ".join(words)))
            words = [w if rng.random() > 0.012 else f"{w}x" for w in words]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(76)} for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {c: min((r[0] for r, x in zip(rows, label, strict=True) if x == c and r[0] is not None), default=None) for c in set(label)}
    want = Counter((i, len(s), None if i is None else least[c]) for (i, _), s, c in zip(rows, sets, label, strict=True))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)


def test_blocks_find_what_stars_miss(spark):
    """a is like b and b like c, but a is not like c, with all in one bucket."""
    w = [f"w{i}" for i in range(400)]
    texts = [w, w[:370] + [f"x{i}" for i in range(30)], w[:340] + [f"y{i}" for i in range(30)] + [f"x{i}" for i in range(30)]]
    df = spark.createDataFrame([(i + 1, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["component_id"] for r in near_dedup.near_duplicates(df).collect()} == {1}
    assert near_dedup.least_matches()[-1] > 50


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a long, b long")
    assert {(r["node"], r["component"]) for r in components.connected_components(edges).collect()} == {(i, 1) for i in range(2, 61)} | {(101, 100)}


def test_exact_dedup_index_persists(spark, odd):
    index = exact_dedup.new_index(spark, 4)
    first = exact_dedup.deduplicate(odd, index).collect()
    assert sorted(r["doc_id"] for r in first) == [2, 3, 5, 6, 7, 8]
    more = spark.createDataFrame([(50, "word"), (51, "new"), (52, "NEW")], "doc_id long, text string")
    assert [r["doc_id"] for r in exact_dedup.deduplicate(more, index).collect()] == [52]
    index2 = exact_dedup.new_index(spark, 4)
    index2.add(odd)
    index2.add(odd)
    rows = index2.annotate(odd).collect()
    assert len(rows) == 10 and {r["group_size"] for r in rows if r["keep_id"] == 5} == {4}


def test_exact_dedup_adds_batches_up(spark):
    one = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    two = spark.createDataFrame([(9, "a"), (4, "c")], "doc_id long, text string")
    index = exact_dedup.new_index(spark, 4)
    index.add(one)
    assert [r["keep_id"] for r in index.add(two).collect()] == [4]
    rows = index.annotate(one.union(two)).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in rows} == {1: (9, 3, False), 2: (9, 3, False), 9: (9, 3, True), 3: (3, 1, True), 4: (4, 1, True)}
    assert sorted(r["doc_id"] for r in exact_dedup.distinct_texts(one.union(two), exact_dedup.new_index(spark, 4)).collect()) == [3, 4, 9]


def test_exact_dedup_without_ids_and_rows(spark, odd):
    """Of a text without any id one row stays; an empty table gives none; an index is found again by its name, and dropped."""
    docs = spark.createDataFrame([(None, "a"), (None, "A"), (3, "b"), (3, "b"), (None, "b")], "doc_id long, text string")
    rows = exact_dedup.distinct_texts(docs).collect()
    assert sorted((r["doc_id"] or 0, r["text"].lower()) for r in rows) == [(0, "a"), (3, "b")]
    assert exact_dedup.distinct_texts(docs.where("false")).count() == 0
    index = exact_dedup.new_index(spark, 4)
    index.add(docs)
    again = exact_dedup.DigestIndex(spark, index.table, 16)
    assert again.buckets == 4 and again.annotate(docs.where("false")).count() == 0 and again.add(docs.where("false")).count() == 0
    assert {(r["keep_id"], r["group_size"]) for r in again.annotate(docs).collect()} == {(None, 2), (3, 3)}
    index.drop()
    assert not again.exists()


def test_token_counts(spark, documents, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = tokens.load_tokenizer(path)
    want = {i: len(plain.encode(t, add_special_tokens=False).ids) for i, t in zip(documents.doc_id, documents.text, strict=True)}
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.op3_token_counts(spark, SF).collect()} == want
    got = tokens.count_tokens(odd, path).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert len(got) == 10 and all(r["n_tokens"] == len(plain.encode(texts[r["doc_id"]], add_special_tokens=False).ids) for r in got)


@pytest.mark.parametrize("text", ["a  b\n\n c", "\t\t  x", "x<|endoftext|> y", " lead", "trail  ", "a  b", "don't  stop\r\nnow", "12 345\n6", ""])
def test_pieces_keep_the_count(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tokens.LengthEncoder(path).counts([text]) == [len(tokens.load_tokenizer(path).encode(text, add_special_tokens=False).ids)]
    assert "".join(tokens.pieces_of(text)) == text


def test_sentencepiece_lengths(spark, odd):
    """Long texts are cut between words, and count as whole ones do."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    encoder = tokens.LengthEncoder(path)
    texts = ["one two  three\n", "", " lead", "word " * 80_000 + "end", "a-b c.d, " * 40_000]
    assert encoder.cut_words and len(encoder._parts(texts[3])) > 3
    assert encoder.counts(texts) == [len(model.encode(t)) for t in texts]
    whole = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert all(r["n_tokens"] == len(model.encode(whole[r["doc_id"]])) for r in tokens.count_tokens(odd, path).collect())


def test_packing_round_trip(spark, documents, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = packing.load_tokenizer(path)
    for docs, texts in ((spark.read.parquet(f"{SF}/documents.parquet"), dict(zip(documents.doc_id, documents.text, strict=True))), (odd.where("doc_id <> 4"), {r["doc_id"]: r["text"] for r in odd.collect()})):
        rows = packing.pack(docs, path).toPandas()
        for i, g in rows.sort_values("start").groupby("doc_id"):
            want = np.array(plain.encode(texts[i] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
            assert b"".join(g["ids"]) == want and (g["doc_tokens"] == len(want) // 4).all()
        for _, g in rows.sort_values("offset").groupby("sequence_id"):
            total = g["length"].sum()
            assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]] and total <= 4096 and total & (total - 1) == 0
    step = rows.groupby(["step_group", "sequence_id"])["context"].first().groupby("step_group").sum()
    assert (step <= packing.STEP_TOKENS).all()
    assert packing.pack(odd.where("false"), path).count() == 0


def test_step_groups_are_full_across_tasks(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400).repartition(16, "doc_id")
    rows = packing.pack(docs, path, step_tokens=8192).select("sequence_id", "context", "step_group").distinct().toPandas()
    assert rows["sequence_id"].is_unique and (rows["sequence_id"] // 2**40).nunique() > 8
    groups = rows.groupby(["context", "step_group"]).size().reset_index(name="n")
    assert groups["step_group"].is_unique and (groups["n"] * groups["context"] <= 8192).all()
    assert ((groups["n"] * groups["context"] < 8192).groupby(groups["context"]).sum() <= 1).all()


def test_packing_of_null_and_repeated_ids_and_few_small_pieces(spark, documents):
    """Each id of each row lies in one piece, rows without or with repeated ids included; cuts leave few small pieces; tails of all tasks share theirs."""
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = packing.load_tokenizer(path)
    texts = list(documents.text) + [None, "", "word"]
    ids = [None if i % 9 == 0 else int(i) % 50 for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(8)
    rows = packing.pack(docs, path).toPandas()
    counts = [len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts]
    want, got = defaultdict(Counter), defaultdict(Counter)
    for i, t in zip(ids, texts, strict=True):
        want[i].update(plain.encode(t or "", add_special_tokens=False).ids + [2])
    for i, b in zip(rows.doc_id, rows.ids, strict=True):
        got[None if pd.isna(i) else int(i)].update(np.frombuffer(b, "<u4").tolist())
    assert got == want
    total = rows.groupby("sequence_id")["length"].sum()
    assert ((total & (total - 1)) == 0).all() and (total < 512).sum() <= 9
    assert (rows.length <= 16).sum() <= sum(c <= 16 for c in counts) + 9
    digest = packing.packed_digest(docs).toPandas()
    assert digest.length.sum() == sum(counts) and set(digest.columns) >= {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_poisson_rates(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    n = {r["source"]: r["count"] for r in mixing.replicate(docs, weights).groupBy("source").count().collect()}
    assert abs(n["a"] - 10_000) < 400 and abs(n["b"] - 10_000) < 400
    keys = [r["shuffle_key"] for r in mixing.shuffled(mixing.replicate(docs)).select("shuffle_key").collect()]
    assert keys == sorted(keys)


def test_poisson_rates_above_the_exponent(spark):
    """Ten documents with half of a corpus of 36,010 equal documents: rate 1800.5, not a bounded one."""
    docs = spark.range(36_010).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.when(F.col("id") < 10, "a").otherwise("b").alias("source"))
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    got = mixing.replicate(docs, weights).where("source = 'a'").groupBy("doc_id").agg(F.count("copy").alias("n"), F.max("copies").alias("copies"), F.first("rate").alias("rate")).collect()
    assert len(got) == 10 and {r["rate"] for r in got} == {1800.5} and all(r["n"] == r["copies"] for r in got)
    assert abs(sum(r["n"] for r in got) - 18_005) < 5 * 18_005**0.5 and len({r["n"] for r in got}) > 5


def test_poisson_odd_rows(spark, odd):
    """Null sources, empty texts, repeated rows, clashing columns and an empty table; very small rates are not rounded away."""
    got = mixing.replicate(odd.withColumn("copy", F.lit("own")).withColumn("rate", F.lit("own"))).collect()
    n = Counter((r["doc_id"], r["text"]) for r in got)
    assert all(v % 2 == 0 for k, v in n.items() if k[0] == 4) and {r["copy"] for r in got} <= set(range(1, 100)) and all(r["copies"] >= r["copy"] for r in got)
    assert mixing.shuffled(mixing.replicate(odd.where("false"))).count() == 0
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") < 999, "a").otherwise("b").alias("source"))
    rates = {r["source"]: r["rate"] for r in mixing.rates(docs, spark.createDataFrame([("a", 1.0), ("b", 1e-12)], "source string, weight double")).collect()}
    assert 0 < rates["b"] < 1e-8


@pytest.mark.parametrize("rate", [0.0, 3.5, 700.0, 700.5, 5000.0, 1e6])
def test_poisson_tables(rate):
    low = 0 if rate <= 700 else int(rate - 12 * rate**0.5 - 20)
    cdf = mixing.cumulated(rate, low)
    mass, k = np.diff(cdf, prepend=0), low + np.arange(len(cdf))
    assert abs(cdf[-1] - 1) < 1e-12 and abs((mass * k).sum() - rate) < 1e-6 * max(rate, 1) and abs((mass * (k - rate) ** 2).sum() - rate) < 1e-6 * max(rate, 1)


def test_models_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = pd.read_parquet(f"{sf}/documents.parquet")
    got = language.op5_language_id(spark, sf).toPandas().merge(truth[["doc_id", "lang"]])
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    scored = toxicity.op2_toxicity(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"))
    assert len(scored) and (scored[scored.held_out].predicted == scored[scored.held_out].toxic).mean() > 0.85


def test_toxicity_finds_most_of_each_language(spark):
    """Held-out rows at sf0.1: precision, and the share of toxic documents found, by language."""
    sf = "/root/testdata/sf0.1"
    scored = toxicity.op2_toxicity(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet")).merge(pd.read_parquet(f"{sf}/documents.parquet")[["doc_id", "lang"]])
    held = scored[scored.held_out]
    toxic = held[held.toxic == 1]
    assert held[held.predicted == 1].toxic.mean() > 0.95 and toxic.predicted.mean() > 0.8
    assert toxic.groupby("lang").predicted.mean().min() >= 0.6


def test_language_model_is_sparse_and_calibrated(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    seen = model["idf"] < model["idf"].max()
    assert (model["weights"][seen] == 0).mean() > 0.5 and model["temperature"] != 1.0
    assert language.table_bits(4) == 16 and language.table_bits(256) == 16 and language.table_bits(4096) == 12


def test_samples_are_bounded(spark):
    """A repeated or null id brings no more rows than the bounds allow, and every language is in the sample."""
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.lit("same text").alias("text"), F.when(F.col("id") % 100 == 0, "fr").otherwise("en").alias("lang"))
    varied = docs.withColumn("text", F.concat("text", F.monotonically_increasing_id().cast("string")))
    sample = language.training_sample(varied, 200).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in sample}["fr"] == 30 and 60 < {r["lang"]: r["count"] for r in sample}["en"] < 140
    assert language.training_sample(docs, 200).count() <= 200 and language.training_sample(varied, 200, 100).count() <= 10
    assert language.training_sample(docs.where("false")).count() == 0
    many = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of "), F.chr(F.col("id") + 20_000)).alias("text"), F.col("id").cast("string").alias("lang"))
    assert language.predict(many, language.fit(many)).count() == 400
    labels = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    assert len(toxicity.fit(docs.withColumn("doc_id", F.lit(1).cast("long")), labels.withColumn("doc_id", F.lit(1).cast("long")), 50)) == 2


def test_ftrl_equals_plain_loops():
    """Per-coordinate updates, one number at a time."""
    rng = np.random.default_rng(3)
    for classes in (1, 3):
        model = ftrl.Ftrl(12, classes, 0.4, 1.0, 0.05, 0.2)
        z, n = [[0.0] * classes for _ in range(12)], [[0.0] * classes for _ in range(12)]

        def weight(i, c, z=z, n=n):
            return 0.0 if abs(z[i][c]) <= 0.05 else -(z[i][c] - np.sign(z[i][c]) * 0.05) / ((1.0 + n[i][c] ** 0.5) / 0.4 + 0.2)

        for _ in range(60):
            at, truth = np.sort(rng.choice(12, 4, replace=False)), int(rng.integers(0, max(classes, 2)))
            values = rng.random(4)
            target = np.array([truth]) if classes == 1 else np.eye(classes)[truth]
            scores = [sum(v * weight(i, c) for i, v in zip(at, values, strict=True)) for c in range(classes)]
            p = [1 / (1 + np.exp(-scores[0]))] if classes == 1 else [np.exp(s) / sum(map(np.exp, scores)) for s in scores]
            assert np.allclose(model.step(at, values, target.astype(float)), p)
            old = {(i, c): weight(i, c) for i in at for c in range(classes)}
            for i, v in zip(at, values, strict=True):
                for c in range(classes):
                    g = v * (p[c] - target[c])
                    sigma = ((n[i][c] + g * g) ** 0.5 - n[i][c] ** 0.5) / 0.4
                    z[i][c] += g - sigma * old[i, c]
                    n[i][c] += g * g
        assert np.allclose(model.weights(), [[weight(i, c) for c in range(classes)] for i in range(12)])


def test_models_on_odd_rows(spark, odd):
    rows = language.predict(odd, language.fit(odd)).collect()
    assert len(rows) == 10 and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert {r["lang_pred"] for r in language.predict(odd, language.fit(odd.where("false"))).collect()} == {"und"}
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    scores = toxicity.score(odd, toxicity.fit(odd, labels)).collect()
    assert len(scores) == 10 and all(0 <= r["score"] <= 1 for r in scores)
    assert {r["score"] for r in toxicity.score(odd, toxicity.fit(odd, labels.where("false"))).collect()} == {0.5}


def test_empty_tables_and_clashing_columns(spark, odd):
    """Empty inputs give empty results; columns named like results or helpers change nothing."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    clash = odd.withColumns({c: F.lit("own") for c in ("n_tokens", "rep", "raw", "words", "digest", "keep_id", "batch", "licences", "held_out", "toxic", "rank", "n_words", "distance2", "__id", "__low")})
    labels = spark.createDataFrame([(4, 1), (6, 0)], "doc_id long, toxic int")
    model, lang = toxicity.fit(odd, labels), language.fit(odd)
    runs = [
        lambda d: tokens.count_tokens(d, path), licenses.scan, near_dedup.near_duplicates, quality.quality_rules, lambda d: toxicity.score(d, model), lambda d: language.predict(d, lang),
        lambda d: exact_dedup.feed(d, exact_dedup.new_index(spark, 4)).annotate(d),
    ]
    key = lambda df: Counter(map(repr, df.collect()))
    for run in runs:
        assert run(odd.where("false")).count() == 0
        plain, other = run(odd), run(clash)
        assert key(plain.select(*other.columns)) == key(other.select(*plain.columns)) and plain.count() == 10
    assert len(toxicity.fit(clash, labels)[0]) == len(model[0]) and language.fit(clash)["languages"] == lang["languages"]


def test_scratch_is_deleted(spark):
    made = shared.materialise(spark.range(5).toDF("id"), "test-scratch")
    folder = shared.scratch(spark, "x").rsplit("/", 1)[0].removeprefix("file://")
    assert made.count() == 5 and any("test-scratch" in p.name for p in Path(folder).iterdir())
    shared.discard(spark)
    assert not Path(folder).exists()


def test_license_rules(spark, odd):
    mit = licenses.TEXTS["MIT"][0]
    wrapped = "/* Copyright 2020\n\n" + "\n".join(mit[i : i + 70] for i in range(0, len(mit), 70)).replace("\n\n\n", "\n\n")
    rows = [(1, mit), (2, "noise***\nLicensed under CC BY-NC 4.0.\nmore"), (3, "SPDX-License-Identifier: MIT"), (4, licenses.TEXTS["BSD-3-Clause"][0]), (5, "the MIT school"), (6, mit.replace("\n\n", "\n\nCopyright someone.\n\n"))]
    got = {r["doc_id"]: r["licences"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["MIT"], 2: ["CC-BY-NC-4.0"], 3: ["MIT"], 4: ["BSD-3-Clause"], 5: [], 6: ["MIT"]} and wrapped
    assert licenses.scan(odd).count() == 10


def test_license_full_and_altered_texts(spark, odd):
    """Full texts as systems ship them, with one clause altered, and reflowed; other prose between; odd rows and an empty table."""
    shipped = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}
    folder = Path("/usr/share/common-licenses")
    texts = {k: (folder / f).read_text() for k, f in shipped.items() if (folder / f).exists()}
    texts |= {k: "Some words before.\n\n" + ".\n\nWords in between, of no licence.\n\n".join(v) + ".\nEnd." for k, v in licence_texts.SENTENCES_OF.items() if k not in texts}
    texts |= {k: f"Intro. {licence_texts.ACCEPTANCE.format(t)}. Outro." for k, t in licence_texts.CREATIVE_COMMONS.items()}
    altered = {k: t.replace(licence_texts.SENTENCES_OF[k][0].split(" ")[-1], "whatever", 1) if k in licence_texts.SENTENCES_OF else t for k, t in texts.items()}
    reflowed = {k: "\n\n".join("\n".join(textwrap.wrap(p, 50)) for p in t.split("\n\n")) for k, t in texts.items()}
    for table in (texts, altered, reflowed):
        got = {r["doc_id"]: r["licences"] for r in licenses.scan(spark.createDataFrame(list(table.items()), "doc_id string, text string")).collect()}
        assert all(k in got[k] for k in table), {k: v for k, v in got.items() if k not in v}
    rows = {r["doc_id"]: (r["line_ids"], r["licences"]) for r in licenses.scan(odd).collect()}
    assert set(map(repr, rows.values())) == {"([], [])"} and licenses.scan(odd.where("false")).count() == 0


def test_warc_history_is_ordered(spark):
    html = "<p>" + "x" * 200
    rows = [(i, f"http://www.host{i % 7}.org/p{i % 13}?q=a b", html if i % 3 else f"{html}{i}", i % 5) for i in range(300)] + [(300, None, None, 0), (None, "http://a.b/", html, 1), (301, "u", "short", 2), (302, "u", "short", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, ts long").repartition(12)
    folder = shared.scratch(spark, "warc-test")
    merged = warc.merge_runs(warc.write_archives(pages, folder), folder, fan_in=4, range_lines=40)
    h = merged.toPandas().sort_values(["range", "position"])
    keys = [(k, t, -1 if pd.isna(p) else p) for k, t, p in zip(h.urlkey, h.ts, h.page_id, strict=True)]
    assert len(keys) == len(rows) and keys == sorted(keys) and h["range"].nunique() > 1
    back = {r["page_id"]: r for r in warc.read_records(merged).collect()}
    assert back[301]["record_type"] == back[302]["record_type"] == "response" and back[2]["refers_to"] == 1 and back[300]["payload_bytes"] == 0
    assert all(back[i]["html"] == f"{html}{i}" for i in range(0, 300, 3))
    assert warc.history(pages.where("false")).count() == 0


def test_warc_keeps_ids_whole_and_odd_rows(spark):
    """Ids beyond the integers of a double, with and without nulls; repeated ids; clashing columns; many passes."""
    html, big = "<p>" + "x" * 200, 2**53
    rows = [(big + 1, "http://a.b/1", html, 0, "f", 1), (big + 3, "http://a.b/2", html, 0, "f", 1), (big + 5, None, None, 1, None, None), (7, "http://c.d/", "y" * 150, 2, "g", 2), (7, "http://c.d/", "y" * 150, 2, "g", 2), (-3, "http://c.d/", "y" * 150, 2, "g", 2)]
    for more in ([], [(None, "http://a.b/", html, 1, "f", 1)]):
        pages = spark.createDataFrame(rows + more, "page_id long, url string, html string, ts long, file string, first long").repartition(3)
        back = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_records(warc.history(pages)).collect())
        want = [(big + 1, "response", None, 203), (big + 3, "revisit", big + 1, 203), (big + 5, "response", None, 0), (7, "revisit", -3, 150), (7, "revisit", -3, 150), (-3, "response", None, 150)]
        assert back == Counter(want + [(None, "response", None, 203) for _ in more])
    runs = warc.write_archives(spark.range(200).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.lit("x").alias("html"), F.lit(0).alias("ts")).repartition(30), folder := shared.scratch(spark, "warc-test"))
    assert runs.count() == 30 and [r["page_id"] for r in warc.merge_runs(runs, folder, fan_in=4, range_lines=40).orderBy("range", "position").collect()] == sorted(range(200), key=str)
    with pytest.raises(ValueError):
        warc.merge_runs(runs, folder, fan_in=2)


def test_loser_tree():
    rng = np.random.default_rng(0)
    runs = [sorted((f"{x:05d}", b"") for x in rng.integers(0, 500, n)) for n in (0, 1, 50, 200, 7)]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
    assert list(warc.LoserTree([])) == []


def test_pipeline(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.materialise(stage(spark, docs, SF), "test-stage")
        assert docs.columns == corpus_pipeline.COLUMNS
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3]
    good = docs.select("text").distinct().count()
    assert 0 < good <= sizes[3]
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert packed.agg(F.sum("length")).first()[0] >= docs.count()


def test_pipeline_stages_equal_brute_force(spark):
    """Each stage on its own input, with null and repeated ids, null texts and keys among the rows."""
    table = pd.read_parquet(f"{SF}/documents.parquet")
    extra = table.head(40).copy()
    extra["doc_id"] = [None if i % 2 else 7 for i in range(40)]
    extra["text"] = [t if i % 4 else f"{t} altered" for i, t in enumerate(extra["text"])]
    extra.loc[extra.index[:2], "text"] = None
    extra.loc[extra.index[3:6], "lang"] = None
    plain = [[None if pd.isna(x) else int(x) if c in ("doc_id", "n_chars") else x for c, x in r.items()] for r in pd.concat([table, extra])[corpus_pipeline.COLUMNS].astype(object).to_dict("records")]
    docs = spark.createDataFrame(plain, "doc_id long, text string, lang string, source string, n_chars long")
    rows = lambda df: Counter(map(tuple, df.select("doc_id", "text", "lang", "source").collect()))

    verdicts = quality.quality_rules(docs).toPandas()
    kept = shared.materialise(corpus_pipeline.quality_rules(spark, docs, SF), "test-stage")
    assert kept.count() == verdicts.kept.sum() and rows(kept) - rows(docs) == Counter()
    assert {(r[2], r[3]) for r in rows(kept)} >= {(None, r[3]) for r in rows(kept) if r[2] is None}

    lower = lambda t: t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    best = {}
    for i, t, *_ in kept.collect():
        best[lower(t)] = max(best.get(lower(t), -1), -1 if i is None else i)
    unique = shared.materialise(corpus_pipeline.exact(spark, kept, SF), "test-stage")
    assert Counter((lower(r["text"]), -1 if r["doc_id"] is None else r["doc_id"]) for r in unique.collect()) == Counter(best.items())

    found = [(r["doc_id"], r["text"]) for r in unique.collect()]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (lower(t).encode().split() for _, t in found)]
    label, holds = list(range(len(found))), defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holds[x]).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
        for x in s:
            holds[x].append(i)
    single = shared.materialise(corpus_pipeline.near(spark, unique, SF), "test-stage")
    stays = [(r["doc_id"], r["text"]) for r in single.collect()]
    of = {}
    for row, c in zip(found, label, strict=True):
        of[row] = c
    ids = defaultdict(list)
    for (i, _), c in zip(found, label, strict=True):
        ids[c].append(np.inf if i is None else i)
    assert Counter(of[row] for row in stays) == Counter(set(label))
    assert all((np.inf if row[0] is None else row[0]) == min(ids[of[row]]) for row in stays)

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0
