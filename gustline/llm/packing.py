"""Packing by power-of-two decomposition.

A document of n tokens (its end id included) is cut into as many pieces of
``most`` tokens as fit and then into one piece for each binary digit of the
rest, longest first. Each piece is a sequence of its own, in the bucket of its
length: no sequence crosses documents and none needs padding, because a batch
takes sequences of one bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustline.llm.common import by_text, id_and_text, in_arrow, materialize
from gustline.llm.tokens import END, Coder

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, at long, ids binary"


def cuts(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; most is a power of two."""
    out, at = [], 0
    while n - at >= most:
        out.append((at, most))
        at += most
    size = most
    while at < n:
        size //= 2
        if n - at >= size:
            out.append((at, size))
            at += size
    return out


def _kernel(tokenizer: str, most: int, with_ids: bool, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = Coder.of(tokenizer, keep), TaskContext.get().partitionId(), {}
        for docs, texts in by_text(batches):
            for i in range(0, len(docs), 512):
                rows = []
                for doc, ids in zip(docs[i : i + 512], coder.encode(texts[i : i + 512])):
                    ids += END
                    n = len(ids) // 4
                    for start, size in cuts(n, most):
                        piece = ids[4 * start : 4 * (start + size)]
                        at = seen.get(size, 0)
                        seen[size] = at + 1
                        rows.append((doc, start, size, zlib.crc32(piece), n, part, at, piece if with_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=[x.split()[0] for x in _PIECE.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer: str, most: int = 1024, with_ids: bool = True, keep: int = 400_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset [, ids].

    sequence_id numbers the sequences from 0, those of one length together and
    the longest first; ids are little-endian unsigned 32-bit integers. A null or
    empty text is one piece that holds the end id; rows with the same doc_id,
    and rows without one, are packed each on their own; other columns are left
    out; an empty table gives no rows. The pieces are written to the shared
    folder before they are numbered, so that a repeated task can't number them
    differently; what is gathered to number them is one count per task and length. keep bounds a
    worker's cache of encoded words, which takes about 160 MB as set; it changes no result.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")
    pieces = materialize(id_and_text(docs).transform(in_arrow, _kernel(tokenizer, most, with_ids, keep), _PIECE), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.max("at").alias("last"))
    # one row per length (11 of them) and task: the sum runs within each length, then over the lengths
    by_length = counts.groupBy("length").agg(F.sum(F.col("last") + 1).alias("n"))
    longer = by_length.select("length", (F.sum("n").over(Window.orderBy(F.desc("length"))) - F.col("n")).alias("base"))
    within = F.sum(F.col("last") + 1).over(Window.partitionBy("length").orderBy("part")) - F.col("last") - 1
    bases = counts.select("length", "part", within.alias("before")).join(longer, "length").select("length", "part", (F.col("base") + F.col("before")).alias("base"))
    out = pieces.join(bases, ["length", "part"]).withColumn("sequence_id", F.col("base") + F.col("at")).withColumn("offset", F.lit(0).cast("long"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))
