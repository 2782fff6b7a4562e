"""MinHash near-dedup with sequential Bayesian verification.

1. One pass over the texts gives each row's number of distinct word shingles, a signature of
   PERMUTATIONS minima, its band keys, and a digest of its words. Rows with the same words are one
   class from here on, so a group of copies of any size costs one row. A class has a number of its own
   (its place in a written table), never that of a document: a doc_id may carry several texts.
2. Classes that share a band key are candidates. Within a bucket every class is first compared with
   the bucket's smallest id (a star: as many pairs as rows, never all pairs).
3. A candidate's signatures are compared batch by batch; it is pruned as soon as the posterior
   probability that its similarity reaches the threshold, given the matches so far, falls below MISS.
4. Survivors are verified exactly on their full sets, and the links give components. Classes that
   share a doc_id are linked too, unless rows are to be told apart.
5. Pairs that a star can't see (two classes of a bucket that are in different components so far) are
   then compared in blocks of bounded size, by size, signatures and full sets; rows of the bucket's
   largest component are not compared with each other. Only joined components leave a block. No pair is
   dropped.

Defined cases: texts are lower-cased for A-Z only; null texts and texts without words have no
shingles and are linked with nothing (their class is not linked by a shared doc_id either, unless
another row of that id has words); a text with fewer words than a shingle has its whole sequence as
its only shingle; rows that share a doc_id count as one node of the graph, whatever their texts; rows
with a null doc_id take part with their text, have a null component_id, and are kept only where no row
with an id is in their component (then the rows of one class are); repeated rows each keep one result
row; an empty input gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .grouped import Joined, compare_blocks, compare_hubs, labels_after, sides
from .shared import hash_cache, materialise, mix64, small, windows, word_hashes

SHINGLE, PERCENT = 5, 75
#: 32 bands of 4 rows: a pair at similarity 0.75 shares no band with probability 5e-6.
BANDS, ROWS = 32, 4
PERMUTATIONS = BANDS * ROWS
#: Signature positions compared at a time, and the posterior probability below which a pair is pruned.
BATCH, MISS = 16, 1e-7
SEED = 9


def shingles(text: str, cache, width: int = SHINGLE) -> tuple[np.ndarray, list[bytes]]:
    """Sorted distinct 64-bit shingle hashes of a whole text, and its words."""
    words = text.encode().lower().split()  # bytes: A-Z only, and exactly \x20 and \x09-\x0D
    if not words:
        return np.empty(0, np.uint64), words
    hashes = word_hashes(cache, words)
    return np.unique(windows(hashes, min(width, len(words)))), words


def _permutations() -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Minima of the multiply-shift permutations; blocks keep the work in cache."""
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for at in range(0, len(values), 512):
        np.minimum(least, (values[at : at + 512, None] * factors).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(signed: np.ndarray) -> np.ndarray:
    rows = signed.astype(np.uint64).reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache, factors = hash_cache(), _permutations()
    for batch in batches:
        counts, digests, signed = [], [], []
        for value in batch.column("text"):
            found, words = shingles(value.as_py() or "", cache)
            counts.append(len(found))
            digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
            signed.append(signature(found, factors))
        table = np.array(signed, np.uint32).reshape(len(signed), PERMUTATIONS)
        keys = band_keys(table)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("raw"),
                pa.array(counts, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([x.tobytes() for x in table.astype(np.uint16)], pa.binary()),
                pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), BANDS).cast(pa.list_(pa.int64())),
            ],
            ["doc_id", "raw", "n_shingles", "words", "signature", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = hash_cache()
    for batch in batches:
        found = [shingles(t.as_py() or "", cache)[0].tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(found, pa.binary())], ["rep", "shingles"])


def least_matches(threshold: float = PERCENT / 100, miss: float = MISS) -> list[int]:
    """For each batch end n: the fewest matches m with P(similarity >= threshold | m of n) >= miss.

    The prior is uniform, so the posterior is Beta(m + 1, n - m + 1); its tail is integrated numerically.
    """
    grid = (np.arange(200_000) + 0.5) / 200_000
    above = grid >= threshold
    bounds = []
    for n in range(BATCH, PERMUTATIONS + 1, BATCH):
        for m in range(n + 1):
            logs = m * np.log(grid) + (n - m) * np.log1p(-grid)
            mass = np.exp(logs - logs.max())
            if mass[above].sum() / mass.sum() >= miss:
                bounds.append(m)
                break
    return bounds


def bayes_prune(left: np.ndarray, right: np.ndarray, bounds: list[int]) -> np.ndarray:
    """Indices of the row pairs that no batch pruned."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for k, least in enumerate(bounds):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    return alive


def _matrix(values: pd.Series | list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint16).reshape(len(values), PERMUTATIONS)


def _prune_pairs(frames: Iterator[pd.DataFrame], bounds: list[int]) -> Iterator[pd.DataFrame]:
    for pairs in frames:
        alive = bayes_prune(_matrix(pairs["sig_a"]), _matrix(pairs["sig_b"]), bounds)
        yield pairs[["a", "b"]].iloc[alive]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity, exactly."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _linked_sets(x: bytes, y: bytes, percent: int) -> bool:
    return linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)


def _compare_block(rows: pa.Table, bounds: list[int], percent: int) -> list[tuple[int, int]]:
    """Components that exact links of one block with another (or itself) join, as pairs.

    Sizes prune first, then signatures, and the sets decide.
    """
    reps, components = (rows.column(c).to_numpy() for c in ("rep", "component"))
    first, second, inside = sides(rows)
    if not len(first) or not len(second):
        return []
    signatures, sets = _matrix(rows.column("signature").to_pylist()), [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    b_size, b_comp, b_ids, b_sig = sizes[second], components[second], reps[second], signatures[second]
    joined = Joined()
    for i in first:
        n = sizes[i]
        near = (100 * np.minimum(b_size, n) >= percent * np.maximum(b_size, n)) & (b_comp != components[i])
        if inside:
            near &= b_ids > reps[i]
        others = np.flatnonzero(near)
        if not len(others):
            continue
        for j in second[others[bayes_prune(np.broadcast_to(signatures[i], (len(others), PERMUTATIONS)), b_sig[others], bounds)]]:
            x, y = int(components[i]), int(components[j])
            if joined.apart(x, y) and linked(sets[i], sets[j], percent):
                joined.join(x, y)
    return joined.found


def _full_sets(docs: DataFrame, classes: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, shingles) of the classes with the given numbers (rep), from one row of each class."""
    heads = classes.select("rep", F.col("low").alias("__low"), F.col("raw").alias("__raw")).join(reps.distinct(), "rep", "left_semi")
    heads = small(materialise(heads, "near-heads"))
    texts = docs.join(heads, docs["doc_id"].eqNullSafe(heads["__low"]) & (docs["raw"] == heads["__raw"])).select("rep", "text")
    return materialise(texts.mapInArrow(_sets, "rep long, shingles binary"), "near-sets").dropDuplicates(["rep"])


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Exact links among the pairs (hub, partner), on the full sets of both texts."""
    sets = _full_sets(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("rep")))
    return compare_hubs(pairs, sets.withColumnRenamed("shingles", "data"), lambda x, y: _linked_sets(x, y, percent))


def _with_signatures(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    both = pairs.join(classes.select(F.col("rep").alias("a"), F.col("signature").alias("sig_a")), "a")
    return both.join(classes.select(F.col("rep").alias("b"), F.col("signature").alias("sig_b")), "b").select("a", "b", "sig_a", "sig_b")


def near_rows(docs: DataFrame, percent: int = PERCENT, join_ids: bool = True) -> DataFrame:
    """doc_id, raw (a hash of the text), n_shingles, component_id and kept for each row of docs (doc_id, text).

    With join_ids the nodes are doc_ids. Without, rows are told apart by their texts: repeated and null
    doc_ids join nothing, and of each component the rows of one text stay: that of the smallest doc_id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("raw"))
    bounds = least_matches(percent / 100)
    schema = "doc_id long, raw long, n_shingles long, words binary, signature binary, bands array<long>"
    signed = materialise(docs.mapInArrow(_sign, schema), "near-signed")

    # One row for each class: the one of its smallest id, which also tells where its text is found.
    usable = signed.where("n_shingles > 0")
    lows = usable.groupBy("words").agg(F.min("doc_id").alias("low"))
    lows = lows.select(F.col("words").alias("__words"), "low")
    heads = usable.join(lows, (F.col("words") == F.col("__words")) & F.col("doc_id").eqNullSafe(F.col("low")), "left_semi").dropDuplicates(["words"])
    classes = heads.select(F.monotonically_increasing_id().alias("rep"), "words", F.col("doc_id").alias("low"), "raw", "signature", "bands")
    classes = materialise(classes, "near-classes")
    numbers = classes.select("rep", "low", F.col("words").alias("__words"), F.col("raw").alias("__raw"))
    members = signed.select("doc_id", "raw", "n_shingles", "words").join(numbers, F.col("words") == F.col("__words"), "left")
    members = materialise(members.select("doc_id", "raw", "n_shingles", "rep", "low", F.coalesce(F.col("raw") == F.col("__raw"), F.lit(True)).alias("head")), "near-members")

    # Buckets of two or more classes, each row with the smallest class of its bucket.
    bands = classes.select("rep", F.explode("bands").alias("band"))
    hubs = bands.groupBy("band").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    buckets = materialise(bands.join(hubs, "band").where("rep <> hub"), "near-buckets")
    signatures = classes.select("rep", "signature")

    stars = buckets.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    survivors = _with_signatures(stars, signatures).mapInPandas(lambda it: _prune_pairs(it, bounds), "a long, b long")
    survivors = materialise(survivors, "near-stars")
    links = _verify(docs, classes, survivors, percent)
    if join_ids:
        shared = members.where("doc_id is not null and rep is not null").groupBy("doc_id").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first <> last")
        shared = shared.select(F.col("doc_id").alias("__id"), "first")
        links = links.unionAll(members.join(shared, F.col("doc_id") == F.col("__id")).select(F.col("rep").alias("a"), F.col("first").alias("b")).where("a <> b"))
    component = connected_components(links)

    # What the stars leave: members of one bucket in different components.
    labelled = buckets.join(component, buckets["rep"] == component["node"], "left").select("band", "rep", F.coalesce("component", "rep").alias("component"))
    open_bands = labelled.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    rows = materialise(labelled.join(open_bands, "band", "left_semi"), "near-open")
    sets = _full_sets(docs, classes, rows.select("rep"))
    rows = rows.join(signatures.join(sets, "rep"), "rep")
    found = compare_blocks(rows, lambda block: _compare_block(block, bounds, percent))
    # The second pass joins components, not documents: its graph has only what the blocks added.
    merged = connected_components(found)

    # Each component's smallest doc_id, and the first of its classes that has it (or, without any id, the first of all).
    nodes = labels_after(component, merged).join(classes.select(F.col("rep").alias("__rep"), "low"), F.col("node") == F.col("__rep")).select("node", "label", "low")
    rank = F.struct(F.col("low").isNull().alias("none"), "low", "node")
    best = nodes.groupBy("label").agg(F.min(rank).alias("best")).select(F.col("label").alias("__label"), "best")
    nodes = nodes.join(best, F.col("label") == F.col("__label")).select("node", F.col("best.low").alias("least"), F.col("best.node").alias("winner"))
    labelled = members.join(nodes, members["rep"] == nodes["node"], "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "low", "doc_id"))
    own_class = F.coalesce("winner", "rep", F.lit(-1)) == F.coalesce("rep", F.lit(-1))
    stays = F.col("doc_id").eqNullSafe(F.coalesce("least", "low", F.when(F.col("rep").isNull(), F.col("doc_id"))))
    kept = stays & (F.col("doc_id").isNotNull() | own_class) if join_ids else stays & own_class & F.col("head")
    return labelled.select("doc_id", "raw", "n_shingles", component_id.alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text)."""
    return near_rows(docs, percent).drop("raw")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
