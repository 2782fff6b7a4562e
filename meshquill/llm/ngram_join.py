"""N-gram Jaccard self-join: rare-first prefixes, length, positional and suffix filters, one verification a pair.

1. Order. Rows are read in blocks of about a million n-grams. Each block sends every bucket of the hash
   space its n-grams: those of one document only with the document, those of several once, with their
   number, so that an n-gram of all documents is one entry a block. A bucket adds up how often each occurs
   and answers its blocks for those that occur elsewhere too. Rare first means ordered by (number, hash);
   n-grams of one document can't be shared and are counted without being sent back.
2. Prefix. A set of n has at most n - ceil(percent * n) + 1 leading n-grams of which one is shared by any
   partner. Those that occur once fill the prefix first, so what is left to index is little. Sets that are
   equal are one class from here on.
3. Join. Classes that have an n-gram in both prefixes are candidates. In each bucket all are compared with
   its smallest class, the hub (as many pairs as rows). Buckets with one hub are one group from there on, as
   near copies share many. Once components are known, those of different components in a group are compared
   block by block (see `grouped`), each pair only in the group of the smallest hub that both have.
4. Filters, in this order: length; position (an n-gram shared at places i and j leaves at most the shorter
   rest); suffix (what lies behind the place is cut at fixed pivots of the hash space; the smaller of two
   parts bounds what they share). Those that pass are verified on the full sets.

In the index an n-gram is its bucket and 32 bits of its hash. Sets in which two n-grams fall together
are handled as multisets, so collisions cost candidates, never links; sets are verified by 64-bit hashes.

Defined cases: as for near-duplicates. A-Z are lower-cased; null texts and texts without words have no
n-grams and are linked with nothing; a shorter text has its whole sequence as its one n-gram; rows that
share a doc_id count as one node, whatever their texts; rows without a doc_id take part with their text
and have a null component_id; repeated rows keep one result row each; an empty input gives an empty
result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .grouped import Joined, compare_blocks, compare_hubs, labels_after, sides
from .near_dedup import linked, shingles
from .shared import hash_cache, materialise, small

PERCENT = 80
#: N-grams and documents of a block (document numbers take 16 bits).
BLOCK_TOKENS, BLOCK_DOCS = 1 << 20, 1 << 16
#: Parts into which pivots cut the hash space for the suffix filter.
PARTS = 32
_FIELDS = [("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("raw", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("idx", pa.binary()), ("slots", pa.binary()), ("many", pa.binary()), ("counts", pa.binary())]
_SCHEMA = "kind int, block long, bucket int, doc_id long, raw long, n long, digest binary, idx binary, slots binary, many binary, counts binary"
MEMBER, TOKENS, SHARED, DOCS = range(4)


def _pack(x: np.ndarray) -> bytes:
    return len(raw := x.tobytes()).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), kind)


def _rows(count: int, **columns) -> pa.RecordBatch:
    arrays = []
    for name, kind in _FIELDS:
        x = columns.get(name)
        arrays.append(pa.nulls(count, kind) if x is None else x if isinstance(x, pa.Array) else pa.array(x, kind) if isinstance(x, list) else pa.array([x] * count, kind))
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in _FIELDS])


def _block_rows(block: int, sets: list[np.ndarray], digests: list[bytes], buckets: int) -> Iterator[pa.RecordBatch]:
    """What a block sends: to each bucket its n-grams, to its own second half the shared ones and its documents."""
    sizes = np.array([len(s) for s in sets], np.int64)
    hashes = np.concatenate(sets)
    idx = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
    bucket, slot = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64)
    tokens = bucket << 32 | slot
    distinct, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    several = counts > 1
    alone = ~several[inverse]
    yield _rows(1, kind=SHARED, block=block, idx=[_pack(idx[~alone])], slots=[_pack(tokens[~alone])])
    yield _rows(1, kind=DOCS, block=block, slots=[_pack(sizes)], many=[_pack(np.frombuffer(b"".join(digests), np.uint8))])
    at = np.flatnonzero(alone)
    at = at[np.argsort(bucket[at], kind="stable")]  # within a bucket still by document, so that numbers pack well
    shared, numbers = distinct[several], counts[several]
    edges, shared_edges = np.searchsorted(bucket[at], np.arange(buckets + 1)), np.searchsorted(shared >> 32, np.arange(buckets + 1))
    used = np.flatnonzero((np.diff(edges) > 0) | (np.diff(shared_edges) > 0))
    singles = [at[edges[b] : edges[b + 1]] for b in used]
    multiples = [slice(shared_edges[b], shared_edges[b + 1]) for b in used]
    yield _rows(
        len(used), kind=TOKENS, block=block, bucket=used.tolist(),
        idx=[_pack(np.diff(idx[x], prepend=np.uint16(0))) for x in singles], slots=[slot[x].astype(np.uint32).tobytes() for x in singles],
        many=[(shared[x] & 0xFFFFFFFF).astype(np.uint32).tobytes() for x in multiples], counts=[_pack(numbers[x].astype(np.uint32)) for x in multiples],
    )


def _scan(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Members (one row for each document) and the rows of its blocks."""
    cache, base, k = hash_cache(), TaskContext.get().partitionId() << 32, 0
    sets: list[np.ndarray] = []
    digests: dict[bytes, None] = {}
    tokens = 0
    for batch in batches:
        counts, own = [], []
        for value in batch.column("text"):
            found, _ = shingles(value.as_py() or "", cache)
            digest = xxhash.xxh3_128_digest(found.tobytes())
            counts.append(len(found))
            own.append(digest)
            if len(found) and digest not in digests:
                digests[digest] = None
                sets.append(found)
                tokens += len(found)
            if tokens >= BLOCK_TOKENS or len(sets) >= BLOCK_DOCS:
                yield from _block_rows(base + k, sets, list(digests), buckets)
                sets, digests, tokens, k = [], {}, 0, k + 1
        yield _rows(len(own), kind=MEMBER, doc_id=batch.column("doc_id"), raw=batch.column("raw"), n=counts, digest=own)
    if sets:
        yield from _block_rows(base + k, sets, list(digests), buckets)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of one key each, from rows sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _count_bucket(rows: list[dict]) -> Iterator[tuple]:
    """(block, idx, slots, their counts, shared slots, their counts) of what occurs more than once in the corpus."""
    singles = [np.frombuffer(r["slots"], np.uint32) for r in rows]
    shared = [np.frombuffer(r["many"], np.uint32) for r in rows]
    lengths = [len(x) for x in (*singles, *shared)]
    weights = np.concatenate([np.ones(sum(lengths[: len(rows)]), np.int64), *(_unpack(r["counts"], np.uint32).astype(np.int64) for r in rows)])
    slots = np.concatenate([*singles, *shared])
    order = np.argsort(slots, kind="stable")
    ordered = slots[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    totals = np.empty(len(slots), np.int64)
    totals[order] = np.repeat(np.add.reduceat(weights[order], starts), np.diff(np.r_[starts, len(slots)]))
    parts = np.split(totals, np.cumsum(lengths)[:-1])
    for k, row in enumerate(rows):
        keep = parts[k] > 1
        if keep.any() or lengths[len(rows) + k]:
            idx = np.cumsum(_unpack(row["idx"], np.uint16), dtype=np.uint16)
            yield row["block"], _pack(idx[keep]), _pack(singles[k][keep]), _pack(parts[k][keep]), _pack(shared[k]), _pack(parts[len(rows) + k])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _groups(batches, "bucket"):
        out = list(_count_bucket(rows))
        if out:
            columns = [pa.array([x[k] for x in out], pa.int64() if k == 0 else pa.binary()) for k in range(6)]
            bucket = pa.array([rows[0]["bucket"]] * len(out), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([TOKENS] * len(out), pa.int32()), columns[0], bucket, *columns[1:]], ["kind", "block", "bucket", "idx", "slots", "df", "many", "many_df"])


def prefix_length(n: int | np.ndarray, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _block_prefixes(rows: list[dict], percent: int) -> list[tuple]:
    """(digest, record) of the block's documents that share a leading n-gram with another.

    A record holds n, the place of the first n-gram that is shared at all, the sizes of the suffix's parts,
    and the n-grams of the prefix from that place on, rarest first.
    """
    idx, tokens, numbers = [], [], []
    known, known_df = [], []
    own_idx = own_tokens = sizes = digests = None
    for r in rows:
        if r["kind"] == SHARED:
            own_idx, own_tokens = _unpack(r["idx"], np.uint16), _unpack(r["slots"], np.int64)
        elif r["kind"] == DOCS:
            sizes, digests = _unpack(r["slots"], np.int64), _unpack(r["many"], np.uint8)
        else:
            high = np.int64(r["bucket"]) << 32
            idx.append(_unpack(r["idx"], np.uint16))
            tokens.append(high | _unpack(r["slots"], np.uint32).astype(np.int64))
            numbers.append(_unpack(r["df"], np.int64))
            known.append(high | _unpack(r["many"], np.uint32).astype(np.int64))
            known_df.append(_unpack(r["many_df"], np.int64))
    if len(own_tokens):
        known, known_df = np.concatenate(known), np.concatenate(known_df)
        order = np.argsort(known)
        numbers.append(known_df[order][np.searchsorted(known[order], own_tokens)])
        idx.append(own_idx)
        tokens.append(own_tokens)
    if not idx:
        return []
    idx, tokens, numbers = np.concatenate(idx).astype(np.int64), np.concatenate(tokens), np.concatenate(numbers)
    order = np.lexsort((tokens, numbers, idx))
    idx, tokens = idx[order], tokens[order]
    counts = np.bincount(idx, minlength=len(sizes))
    starts = np.cumsum(counts) - counts
    first = sizes - counts  # place of a document's first n-gram that occurs elsewhere
    places = np.arange(len(idx)) - starts[idx] + first[idx]
    leading = prefix_length(sizes, percent)
    inside = places < leading[idx]
    rest = np.bincount(idx[~inside] * PARTS + part_of(tokens[~inside]), minlength=len(sizes) * PARTS).reshape(-1, PARTS)
    out = []
    for i in np.flatnonzero((counts > 0) & (first < leading)):
        own = tokens[starts[i] : starts[i] + min(counts[i], leading[i] - first[i])]
        record = np.concatenate([[sizes[i], first[i]], rest[i], own]).astype(np.int64)
        out.append((digests[16 * i : 16 * i + 16].tobytes(), record.tobytes()))
    return out


def part_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> 27) & (PARTS - 1)


def _prefixes(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for rows in _groups(batches, "block"):
        out = _block_prefixes(rows, percent)
        tokens = [np.frombuffer(r, np.int64)[2 + PARTS :] for _, r in out]
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.binary()), pa.array([r for _, r in out], pa.binary()), pa.array(tokens, pa.list_(pa.int64()))], ["digest", "record", "tokens"])


def first_shared(x: np.ndarray, y: np.ndarray, percent: int) -> int | None:
    """The first n-gram that both records' prefixes share, if length, position and suffix leave the pair a chance."""
    nx, ny = int(x[0]), int(y[0])
    if 100 * min(nx, ny) < percent * max(nx, ny):
        return None
    tx, ty = x[2 + PARTS :], y[2 + PARTS :]
    shared = np.isin(tx, ty)
    if not shared.any():
        return None
    i = int(shared.argmax())
    j = int((ty == tx[i]).argmax())
    enough = lambda most: (100 + percent) * (1 + most) >= percent * (nx + ny)
    if not enough(min(nx - int(x[1]) - i, ny - int(y[1]) - j) - 1):
        return None
    behind = [r[2 : 2 + PARTS] + np.bincount(part_of(t[at + 1 :]), minlength=PARTS) for r, t, at in ((x, tx, i), (y, ty, j))]
    return int(tx[i]) if enough(int(np.minimum(*behind).sum())) else None


def _after_hubs(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hubs of a class, sorted, and its record."""
    values = np.frombuffer(x, np.int64)
    return values[1 : 1 + values[0]], values[1 + values[0] :]


def _promising(x: bytes, y: bytes, percent: int) -> bool:
    return first_shared(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), percent) is not None


def _linked_sets(x: bytes, y: bytes, percent: int) -> bool:
    return linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)


def _compare_block(rows: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Components that links of one block with another (or itself) join: only pairs whose smallest common hub is the group's.

    Sizes prune first, then the parts of all n-grams that can be shared, then the filters of single pairs.
    """
    first, second, inside = sides(rows)
    if not len(first) or not len(second):
        return []
    hub = rows.column("band")[0].as_py()
    reps, components = (rows.column(c).to_numpy() for c in ("rep", "component"))
    hubs, records = zip(*map(_after_hubs, rows.column("signature").to_pylist()), strict=True)
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
    sizes = np.array([r[0] for r in records])
    parts = np.array([r[2 : 2 + PARTS] + np.bincount(part_of(r[2 + PARTS :]), minlength=PARTS) for r in records])
    joined = Joined()
    for i in first:
        near = (100 * np.minimum(sizes[second], sizes[i]) >= percent * np.maximum(sizes[second], sizes[i])) & (components[second] != components[i])
        if inside:
            near &= reps[second] > reps[i]
        others = second[near]
        others = others[(100 + percent) * np.minimum(parts[others], parts[i]).sum(axis=1) >= percent * (sizes[others] + sizes[i])]
        for j in others:
            x, y = int(components[i]), int(components[j])
            if joined.apart(x, y) and np.intersect1d(hubs[i], hubs[j])[0] == hub and first_shared(records[i], records[j], percent) is not None and linked(sets[i], sets[j], percent):
                joined.join(x, y)
    return joined.found


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = hash_cache()
    for batch in batches:
        found = [shingles(t.as_py() or "", cache)[0].tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(found, pa.binary())], ["rep", "data"])


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [np.array([len(h), *h], np.int64).tobytes() + r for h, r in zip(batch.column("hubs").to_pylist(), batch.column("data").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(out, pa.binary())], ["rep", "signature"])


def _full_sets(docs: DataFrame, classes: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, data) of the classes with the given numbers, from one row of each class."""
    heads = classes.select("rep", F.col("head.doc_id").alias("__id"), F.col("head.raw").alias("__raw")).join(reps.distinct(), "rep", "left_semi")
    heads = small(materialise(heads, "ngram-heads"))
    texts = docs.join(heads, docs["doc_id"].eqNullSafe(heads["__id"]) & (docs["raw"] == heads["__raw"])).select("rep", "text")
    return materialise(texts.mapInArrow(_sets, "rep long, data binary"), "ngram-sets").dropDuplicates(["rep"])


def prefix_records(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, raw, n, digest), and (digest, record, tokens) of the sets with shared leading n-grams."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scanned = materialise(docs.mapInArrow(lambda it: _scan(it, buckets), _SCHEMA), "ngram-blocks")
    tokens = scanned.where(F.col("kind") == TOKENS).select("bucket", "block", "idx", "slots", "many", "counts")
    answers = "kind int, block long, bucket int, idx binary, slots binary, df binary, many binary, many_df binary"
    counted = tokens.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count, answers)
    none = F.lit(None).cast("binary")
    own = scanned.where(F.col("kind").isin(SHARED, DOCS)).select("kind", "block", "bucket", "idx", "slots", none.alias("df"), "many", none.alias("many_df"))
    blocks = counted.unionAll(own).repartition("block").sortWithinPartitions("block")
    records = blocks.mapInArrow(lambda it: _prefixes(it, percent), "digest binary, record binary, tokens array<long>")
    return scanned.where(F.col("kind") == MEMBER).select("doc_id", "raw", "n", "digest"), records


def ngram_join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("raw"))
    members, records = prefix_records(docs, percent)
    heads = members.where("n > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "raw")).alias("head"), F.min("doc_id").alias("low"), F.max("n").alias("n"))
    records = records.dropDuplicates(["digest"]).withColumnRenamed("digest", "__digest")
    classes = heads.join(records, F.col("digest") == F.col("__digest"), "left").drop("__digest").withColumn("rep", F.monotonically_increasing_id())
    classes = materialise(classes, "ngram-classes")

    # Buckets of the index, each row with the smallest class of its bucket; then the groups of those.
    indexed = classes.where("record is not null").select("rep", "n", F.explode("tokens").alias("band"))
    hubs = indexed.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("hub"), F.max("rep").alias("__last")).where("hub.rep <> __last").drop("__last")
    grouped = indexed.join(hubs, "band").where("rep <> hub.rep").select(F.col("hub.rep").alias("band"), "rep", "n", F.col("hub.n").alias("hub_n")).distinct()
    grouped = materialise(grouped, "ngram-groups")
    stars = grouped.where(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")).select(F.col("band").alias("a"), F.col("rep").alias("b"))
    data = classes.where("record is not null").select("rep", F.col("record").alias("data"))
    survivors = materialise(compare_hubs(stars, data, lambda x, y: _promising(x, y, percent)), "ngram-survivors")
    links = compare_hubs(survivors, _full_sets(docs, classes, survivors.select(F.explode(F.array("a", "b")).alias("rep"))), lambda x, y: _linked_sets(x, y, percent))
    # Classes that share a doc_id are one node.
    numbered = members.join(classes.select(F.col("digest").alias("__digest"), "rep", "low"), F.col("digest") == F.col("__digest"), "left")
    numbered = materialise(numbered.select("doc_id", "n", "rep", "low"), "ngram-members")
    shared = numbered.where("doc_id is not null and rep is not null").groupBy("doc_id").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first <> last")
    shared = shared.select(F.col("doc_id").alias("__id"), "first")
    links = links.unionAll(numbered.join(shared, F.col("doc_id") == F.col("__id")).select(F.col("rep").alias("a"), F.col("first").alias("b")).where("a <> b"))
    component = connected_components(links)

    # What the stars leave: members of one group in different components.
    labelled = grouped.join(component, grouped["rep"] == component["node"], "left").select("band", "rep", F.coalesce("component", "rep").alias("component"))
    open_bands = labelled.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    rows = materialise(labelled.join(open_bands, "band", "left_semi"), "ngram-open")
    # A class's hubs are at most its n-grams: they go before its record.
    own_hubs = grouped.join(rows.select("rep").distinct(), "rep", "left_semi").groupBy("rep").agg(F.array_sort(F.collect_list("band")).alias("hubs"))
    led = own_hubs.join(data, "rep").select("rep", "hubs", "data").mapInArrow(_led, "rep long, signature binary")
    payload = led.join(_full_sets(docs, classes, rows.select("rep")).withColumnRenamed("data", "shingles"), "rep")
    merged = connected_components(compare_blocks(rows.join(payload, "rep"), lambda block: _compare_block(block, percent)))

    nodes = labels_after(component, merged).join(classes.select(F.col("rep").alias("__rep"), F.col("low").alias("__low")), F.col("node") == F.col("__rep"))
    least = nodes.groupBy(F.col("label").alias("__label")).agg(F.min("__low").alias("least"))
    nodes = nodes.join(least, F.col("label") == F.col("__label")).select("node", "least")
    out = numbered.join(nodes, F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "low", "doc_id")).alias("component_id"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
