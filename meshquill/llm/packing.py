"""Hierarchical multi-length packing of tokenised documents.

Each task tokenises the documents of its partition and packs them in one pass, without a shuffle:
whole windows of the longest tier are cut off, the remainder of a document is routed to the shortest
tier that holds it, each tier is packed from the longest down, gaps of long windows are filled from
shorter tiers: by the largest whole piece that fits, and only where none does by a cut. A cut leaves
two pieces of more than LEAST_CUT tokens wherever there is a piece long enough: for a smaller gap the
window's last piece goes back to its tier and a longer one is cut in its place.

What is left at the end of a partition (less than a window) is packed together with what all other
partitions leave, in as many tasks as it has pools; only the end of this second pass goes to windows
that shrink by powers of two, so that nothing is padded. Memory is one pool of POOL_TOKENS and the
longest document. The pieces are written once, and the windows of all tasks are dealt to step groups of
equal token counts by their place among all windows of their context: only the last group of a context
is partial.

Defined cases: a null text is empty and holds the end id only; null and repeated doc_ids are packed
like others (rows of the same id are told apart by nothing but their place); an empty input gives an
empty result. Further columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Memo, materialise, small
from .tokens import load_tokenizer

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
STEP_TOKENS = 65_536
POOL_TOKENS = 1 << 21
#: A cut that leaves no more than so many tokens on a side is avoided.
LEAST_CUT = 32
OUT_BYTES = 8 << 20
#: Ids of sequences and step groups hold the partition, or the context, above so many bits.
PART_BITS = 40
#: The second pass numbers its tasks from here on.
SECOND_PASS = 1 << 61
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())]
    + [("sequence_id", pa.int64()), ("offset", pa.int64()), ("context", pa.int32()), ("place", pa.int64())]
)
_SIMPLE = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,!?;:$%&*#|]*)")
#: White space beyond space, tab, newline and return: texts with one are cut at those four only.
_OTHER_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_SURE_SPACE = re.compile(r"[ \t\r\n]+")


def _byte_alphabet() -> list[str]:
    """The printable stand-ins of the 256 bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class WordEncoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes, from a cache of words.

    The tokenizer lower-cases, drops white space and never joins across it, so a text's ids are its
    words' ids in a row. Plain words go to the BPE model directly; all others through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.alphabet = _byte_alphabet()
        self.cores, self.marks, self.words = Memo(self._core), Memo(self._any), Memo(self._word)

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _core(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join(self.alphabet[b] for b in word.encode())
        return self._bytes([t.id for t in self.tokenizer.model.tokenize(shown)])

    def _any(self, word: str) -> bytes:
        return self._bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        if m := _SIMPLE.fullmatch(word):
            return self.cores[m[1].lower()] + (self.marks[m[2]] if m[2] else b"")
        return self._any(word)

    def encode(self, text: str) -> bytes:
        words = [w for w in _SURE_SPACE.split(text) if w] if _OTHER_SPACE.search(text) else text.split()
        return b"".join(map(self.words.__getitem__, words))


_encoders: dict[str, WordEncoder] = {}


class Packer:
    """Packs pieces (doc_id, start, ids, doc_tokens) into windows; emits rows of SCHEMA."""

    def __init__(self, base: int, tiers: tuple[int, ...]):
        self.tiers, self.longest = sorted(tiers), max(tiers)
        self.next_sequence = base
        self.places: Counter[int] = Counter()  # windows of each context so far
        self.pool: list[tuple] = []
        self.pooled = 0
        self.rows: list[tuple] = []
        self.out_bytes = 0

    def add(self, doc_id, ids: bytes, doc_tokens: int) -> None:
        start = 0
        while doc_tokens - start >= self.longest:
            self._emit([(doc_id, start, ids[4 * start : 4 * (start + self.longest)], doc_tokens)], self.longest)
            start += self.longest
        if start < doc_tokens:
            self.pool.append((doc_id, start, ids[4 * start :], doc_tokens))
            self.pooled += doc_tokens - start

    def _emit(self, window: list[tuple], context: int) -> None:
        place, offset = self.places[context], 0
        self.places[context] += 1
        for doc_id, start, ids, doc_tokens in window:
            length = len(ids) // 4
            self.rows.append((doc_id, start, length, ids, doc_tokens, self.next_sequence, offset, context, place))
            self.out_bytes += len(ids) + 64
            offset += length
        self.next_sequence += 1

    def flush(self, last: bool) -> None:
        """Pack the pool; unless it is the last, the one window that can't be filled goes back to it."""
        size = lambda piece: len(piece[2]) // 4
        shelf = sorted(self.pool, key=size)
        sizes = [size(p) for p in shelf]
        total = sum(sizes)

        def take(at: int) -> tuple:
            sizes.pop(at)
            return shelf.pop(at)

        def put(piece: tuple) -> None:
            at = bisect.bisect_left(sizes, size(piece))
            sizes.insert(at, size(piece))
            shelf.insert(at, piece)

        def cut(piece: tuple, length: int) -> tuple[tuple, tuple]:
            doc_id, start, ids, doc_tokens = piece
            return (doc_id, start, ids[: 4 * length], doc_tokens), (doc_id, start + length, ids[4 * length :], doc_tokens)

        while shelf:
            context = next(t for t in self.tiers if t >= sizes[-1])
            if total < context:  # too little for a window of this tier: it shrinks, or waits for more
                if not last:
                    break
                context = 1 << (total.bit_length() - 1)
            window, gap = [], context
            while gap:
                at = bisect.bisect_right(sizes, gap) - 1  # best fit
                if at >= 0:
                    piece = take(at)
                else:
                    if gap <= LEAST_CUT and window and sizes[-1] > gap + size(window[-1]) + LEAST_CUT:
                        gap += size(window[-1])
                        put(window.pop())
                    long_enough = bisect.bisect_right(sizes, gap + LEAST_CUT)
                    piece, rest = cut(take(long_enough if long_enough < len(sizes) else len(sizes) - 1), gap)
                    put(rest)
                window.append(piece)
                gap -= size(piece)
            total -= context
            self._emit(window, context)
        self.pool, self.pooled = shelf, total

    def leave(self) -> None:
        """What waits in the pool becomes rows without a sequence."""
        for doc_id, start, ids, doc_tokens in self.pool:
            self.rows.append((doc_id, start, len(ids) // 4, ids, doc_tokens, None, None, None, None))
        self.pool, self.pooled = [], 0

    def drain(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[] for _ in SCHEMA]
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)
        self.rows, self.out_bytes = [], 0
        return batch


def _pack(batches: Iterator[pa.RecordBatch], path: str, end_id: int, tiers: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    encoder, end = _encoders[path], end_id.to_bytes(4, "little")
    packer = Packer(TaskContext.get().partitionId() << PART_BITS, tiers)
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            ids = encoder.encode(text.as_py() or "") + end
            packer.add(doc_id.as_py(), ids, len(ids) // 4)
            if packer.pooled >= POOL_TOKENS:
                packer.flush(last=False)
            if packer.out_bytes >= OUT_BYTES:
                yield packer.drain()
    packer.flush(last=False)
    packer.leave()
    yield packer.drain()


def _pack_rest(batches: Iterator[pa.RecordBatch], tiers: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """The second pass: pieces that first-pass tasks left, of any of them."""
    packer = Packer(SECOND_PASS + (TaskContext.get().partitionId() << PART_BITS), tiers)
    for batch in batches:
        for row in batch.to_pylist():
            packer.pool.append((row["doc_id"], row["start"], row["ids"], row["doc_tokens"]))
            packer.pooled += len(row["ids"]) // 4
        if packer.pooled >= POOL_TOKENS:
            packer.flush(last=False)
        if packer.out_bytes >= OUT_BYTES:
            yield packer.drain()
    packer.flush(last=True)
    yield packer.drain()


def _pieces(docs: DataFrame, tokenizer: str, end_id: int, tiers: tuple[int, ...], ids: bool) -> DataFrame:
    """One row for each piece, written once; place counts the windows of its context before it in the same task. Without `ids`, only their crc32 is kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, context int, place long"
    crc = F.crc32("ids").alias("ids_crc32")
    first = rows.mapInArrow(lambda it: _pack(it, tokenizer, end_id, tiers), schema)
    if not ids:
        first = first.withColumns({"ids_crc32": crc, "ids": F.when(F.col("sequence_id").isNull(), F.col("ids"))})
    first = materialise(first, "packed")
    left = first.where("sequence_id is null")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    rest = left.select("doc_id", "start", "ids", "doc_tokens").repartition(max(-(-tokens // POOL_TOKENS), 1))
    second = rest.mapInArrow(lambda it: _pack_rest(it, tiers), schema)
    if not ids:
        second = second.withColumn("ids_crc32", crc)
    second = materialise(second, "packed-rest")
    pieces = first.where("sequence_id is not null").unionByName(second)
    return pieces if ids else pieces.drop("ids")


def _grouped(pieces: DataFrame, step_tokens: int) -> DataFrame:
    """place replaced by step_group: windows are counted by task and context, and the counts added up."""
    pieces = pieces.withColumn("__part", F.shiftright("sequence_id", PART_BITS))
    counts = pieces.groupBy("context", "__part").agg((F.max("place") + 1).alias("n"))  # a few rows for each task
    running = F.sum("n").over(Window.partitionBy("context").orderBy("__part")) - F.col("n")
    before = counts.select(F.col("context").alias("__context"), F.col("__part").alias("__task"), running.alias("__before"))
    joined = pieces.join(small(before), (F.col("context") == F.col("__context")) & (F.col("__part") == F.col("__task")))
    nth = F.floor((F.col("__before") + F.col("place")) / F.greatest(F.floor(F.lit(step_tokens) / F.col("context")), F.lit(1)))
    group = F.shiftleft(F.col("context").cast("long"), PART_BITS) + nth
    return joined.select(*(c for c in pieces.columns if c not in ("place", "__part")), group.alias("step_group"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row for each piece, with its ids (binary, little-endian unsigned 32-bit), context and step_group."""
    return _grouped(_pieces(docs, tokenizer, end_id, tiers, ids=True), step_tokens)


def packed_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, context and step_group."""
    import public_tokenizers

    pieces = _pieces(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, TIERS, ids=False)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "place"]
    return _grouped(pieces.select(*columns), STEP_TOKENS)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
