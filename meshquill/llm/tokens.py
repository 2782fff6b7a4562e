"""Token counts: batch encoding inside Arrow functions that return lengths only.

Texts are cut at safe boundaries (before a run of spaces or newlines that follows another character;
no token of a byte-level BPE spans such a place), so one long text costs no more memory than many
short ones. Pieces met before come from a bounded cache of lengths; the rest are encoded in batches of
a fixed number of bytes.

Defined cases: a null text is empty (0 bytes, 0 tokens); rows with a null or repeated doc_id keep one
result row each; special strings inside a text become single tokens, as is the library's default; an
empty input gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import CACHE_BYTES, CACHE_KEY

CONTEXT = 1024
#: Bytes of text that are looked up together, and bytes of unseen pieces in one call of the encoder.
GROUP_BYTES, BATCH_BYTES = 1 << 20, 1 << 18
#: Characters from which texts are cut for sentencepiece models, and of each part.
LONG_TEXT, PART_CHARS = 1 << 18, 1 << 16
_WORD_GAP = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
_PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Other characters that some engines take for white space: texts with one are cut only after a sure non-space.
_OTHER_SPACE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_SURE_CUT = re.compile(r"(?<=[A-Za-z0-9.,;:!?])(?=[ \n])")

#: Loaded once in each Python worker.
_encoders: dict = {}


def pieces_of(text: str) -> list[str]:
    if _OTHER_SPACE.search(text):
        return [p for p in _SURE_CUT.split(text) if p]
    return _PIECE.findall(text)


def load_tokenizer(path: str):
    """The tokenizer of a .json file, single-threaded: Spark runs the tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


class LengthEncoder:
    """Token counts of texts by .json (tokenizers) or .model (sentencepiece) files."""

    def __init__(self, path: str):
        self.lengths: dict[str, int] = {}
        self.held = 0
        self.pieces = path.endswith(".model")
        if self.pieces:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            # Cuts between words are safe where no piece goes on behind a word's end and a part starts as a word does.
            inner = any("\u2581" in self.model.id_to_piece(i).lstrip("\u2581") for i in range(self.model.get_piece_size()))
            whole, parts = self.model.encode("one two a"), self.model.encode(["one", "two", "a"])
            self.cut_words = not inner and whole == sum(parts, [])
        else:
            self.model = load_tokenizer(path)

    def _encode(self, new: list[str]) -> None:
        batch, size = [], 0
        for i, piece in enumerate(new):
            batch.append(piece)
            size += _bytes(piece)
            if size >= BATCH_BYTES or i == len(new) - 1:
                found = self.model.encode_batch_fast(batch, add_special_tokens=False)
                self.lengths.update(zip(batch, map(len, found), strict=True))
                batch, size = [], 0

    def _parts(self, text: str) -> list[str]:
        """A long text cut at single spaces between ASCII words, which start every part as they start a word; others whole."""
        if len(text) < LONG_TEXT or not self.cut_words:
            return [text]
        parts, start = [], 0
        while start < len(text):
            at = _WORD_GAP.search(text, start + PART_CHARS)
            end = at.start() if at else len(text)
            parts.append(text[start:end])
            start = end + 1
        return parts

    def counts(self, texts: list[str]) -> list[int]:
        if self.pieces:
            return [sum(len(x) for x in self.model.encode(self._parts(t), num_threads=1)) for t in texts]
        cut = [pieces_of(t) for t in texts]
        if self.held > CACHE_BYTES:
            self.lengths.clear()
            self.held = 0
        new = list(set().union(*cut) - self.lengths.keys())
        self._encode(new)
        get = self.lengths.__getitem__
        out = [sum(map(get, pieces)) for pieces in cut]
        for piece in new:  # long pieces seldom come again: they would hold the memory of thousands of words
            if len(piece) > CACHE_KEY:
                del self.lengths[piece]
            else:
                self.held += sys.getsizeof(piece) + 130
        return out


def _encoder(path: str) -> LengthEncoder:
    if path not in _encoders:
        _encoders[path] = LengthEncoder(path)
    return _encoders[path]


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path)
    for batch in batches:
        counts: list[int] = []
        group: list[str] = []
        size = 0
        for value in batch.column("text"):
            text = value.as_py() or ""
            group.append(text)
            size += _bytes(text)
            if size >= GROUP_BYTES:
                counts += encoder.counts(group)
                group, size = [], 0
        counts += encoder.counts(group)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
        )


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = CONTEXT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; no shuffle, only lengths leave Python."""
    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(lambda it: _count(it, tokenizer), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
