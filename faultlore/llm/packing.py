"""Harmonic packing of tokenized documents.

A piece whose length is in (capacity / (k + 1), capacity / k] belongs to class k,
whose bins take exactly k pieces each, whatever these are: so every worker fills
the bins of its classes on its own and no bin is ever searched for.

Documents are cut where this leaves no padding: into full sequences and then the
powers of two that make up the rest, from the largest.  Class k = capacity /
length then fills its bins to the brim.  A worker's last bin of a class may lack
pieces; it is split into sequences of a power of two of pieces, whose lengths are
powers of two again and are not padded.

Pieces are dealt to workers by a hash of document and start, so a class that holds
most pieces is spread over all workers.

Edge cases.  A null or empty text has the one id that ends every document.  A
repeated row is packed again; rows with a null ``doc_id`` are packed like others.
Texts are tokenized whole; a string of an added token of the vocabulary is that
token, as in the tokenizers library.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultlore.llm.common import column, slices, texts

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Units of text that a Python worker remembers the ids of; their longest.
REMEMBERED, LONGEST = 100_000, 48


class Encoder:
    """Ids of a text, as 32-bit little-endian numbers, remembered by unit of text.

    A space before a character that is no white space always begins a pre-token of
    the pattern, so a text is encoded unit by unit between such spaces.  ``added``
    has the ids of added tokens; the text between these is encoded by itself.
    """

    def __init__(self, vocabulary: str, pattern: str, added: dict[str, int] | None = None):
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._known: dict[str, bytes] = {}
        self._added = {token: i.to_bytes(4, "little") for token, i in (added or {}).items()}
        longest_first = sorted(self._added, key=len, reverse=True)
        self._split = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if self._added else None

    def _fresh(self, unit: str) -> bytes:
        ids = self._encoding.encode_ordinary(unit)
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _unit(self, unit: str) -> bytes:
        ids = self._fresh(" " + unit)
        if len(unit) <= LONGEST:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[unit] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if self._split is None or not self._split.search(text):
            return self._ordinary(text)
        parts = self._split.split(text)
        return b"".join(self._added[p] if k % 2 else self._ordinary(p) for k, p in enumerate(parts))

    def _ordinary(self, text: str) -> bytes:
        units = re.split(r" (?=\S)", text) if re.search(r" \s", text) else text.split(" ")
        known = self._known
        out = [self._fresh(units[0])]
        for unit in units[1:]:
            ids = known.get(unit)
            out.append(self._unit(unit) if ids is None else ids)
        return b"".join(out)


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer's JSON and their ids."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if odd := [t["content"] for t in tokens if t["single_word"] or t["lstrip"] or t["rstrip"]]:
        raise ValueError(f"added tokens that depend on what is beside them are not supported: {odd}")
    return {t["content"]: t["id"] for t in tokens}


def cuts(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full sequences, then falling powers of two."""
    out, start = [(i, capacity) for i in range(0, tokens - capacity + 1, capacity)], tokens // capacity * capacity
    while start < tokens:
        length = 1 << ((tokens - start).bit_length() - 1)
        out.append((start, length))
        start += length
    return out


def pieces(docs: DataFrame, capacity: int = 1024, vocabulary: str | None = None, pattern: str | None = None,
           end_id: int = 0, added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece of each row of ``docs`` (doc_id, text), with the ids' checksum.

    ``added`` has the added tokens and their ids; without a ``vocabulary`` of one's
    own, they are those of byte_bpe_50k.
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("capacity must be a power of two")
    if vocabulary is None or pattern is None:
        import public_tokenizers

        if vocabulary is None and added is None:
            added = added_tokens(str(public_tokenizers.path("byte_bpe_50k.json")))
        vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN

    def cut(batches):
        encode = Encoder(str(vocabulary), pattern, added)
        last = end_id.to_bytes(4, "little")
        for batch in batches:
            for part, _, _ in slices(batch):
                out: tuple[list, ...] = ([], [], [], [], [])
                for doc_id, text in zip(column(part, "doc_id").to_pylist(), texts(part).to_pylist()):
                    ids = encode(text) + last
                    tokens = len(ids) // 4
                    for start, length in cuts(tokens, capacity):
                        row = doc_id, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), tokens
                        for values, value in zip(out, row):
                            values.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def packed(of: DataFrame, capacity: int = 1024, workers: int | None = None) -> DataFrame:
    """``of`` (columns of ``pieces``) with ``sequence_id`` and ``offset``.

    Lengths are from 1 to ``capacity``.  A class of a power of two whose pieces all
    have its full length is kept apart from others of the class, since its last
    bin can be split without padding.
    """
    spark = of.sparkSession
    workers = workers or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fixed = (F.col("length") * F.col("k") == capacity) & (F.col("k").bitwiseAND(F.col("k") - 1) == 0)
    dealt = (of.withColumn("k", F.floor(F.lit(capacity) / F.col("length")).cast("long"))
             .withColumn("fixed", fixed.cast("long"))
             .withColumn("worker", F.pmod(F.xxhash64("doc_id", "start"), F.lit(workers)).cast("long")))
    group = Window.partitionBy("worker", "k", "fixed")
    row = F.row_number().over(group.orderBy("doc_id", "start", "ids_crc32", "length")) - 1
    placed = (dealt.withColumn("row", row.cast("long")).withColumn("n", F.count("*").over(group))
              .withColumn("bin", F.floor(F.col("row") / F.col("k"))).withColumn("slot", F.col("row") % F.col("k"))
              .withColumn("last", F.col("n") - F.col("bin") * F.col("k")))
    # in a last bin of m pieces, the highest bit in which m and the slot differ names the part
    part = F.when((F.col("fixed") == 1) & (F.col("last") < F.col("k")),
                  F.length(F.bin(F.col("last").bitwiseXOR(F.col("slot"))))).otherwise(0).cast("long")
    placed = placed.withColumn("part", part)
    bits = (capacity + 1).bit_length()
    sequence = F.shiftleft((F.col("worker") * 2 + F.col("fixed")) * (1 << bits) + F.col("k"), 40 - bits) + F.col("bin")
    in_bin = Window.partitionBy("worker", "k", "fixed", "bin", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (placed.withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0)))
            .withColumn("sequence_id", sequence * 16 + F.col("part"))
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))


def packed_documents(docs: DataFrame, capacity: int = 1024) -> DataFrame:
    return packed(pieces(docs, capacity), capacity)
