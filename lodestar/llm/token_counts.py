"""Token counts of documents in flat, unindexed token files: search for the separator, stitch across blocks.

A token file is a sequence of 32-bit ids in which an end-of-document id follows each document; nothing says where
documents begin. Files are read as blocks of ``BLOCK`` ids. In each block numpy searches for the separator at once, which
gives the lengths of the documents that lie inside; the block before the first separator and after the last one is
stitched by prefix scans over the block summaries of its file: the number of separators before gives the documents'
ordinals, and the last separator's place so far gives what a document carries into the block.

Edge cases: null and empty texts are documents of no tokens; a separator at a block's border, blocks without separators
and a file's end without one (the rest counts as a document that isn't ended) are all counted; an empty table gives no
rows; rows alike count apart, null keys stay null; columns other than key and text aren't read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import slices, written

BLOCK = 1 << 16
#: Bytes of texts that are encoded at a time.
TEXT_BYTES = 1_000_000
_encoders: dict = {}


def encoder(ranks: str, pattern: str) -> Callable[[str], list[int]]:
    """Ids of ordinary text, by a rank file."""
    if ranks not in _encoders:
        import tiktoken

        with open(ranks, "rb") as f:
            found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[ranks] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=found, special_tokens={}).encode_ordinary
    return _encoders[ranks]


def token_files(df: DataFrame, ranks: str, pattern: str, separator: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """One flat token file a task, as blocks (file, block, payload), and the list of what was written (file, ordinal, key)."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file = encoder(ranks, pattern), TaskContext.get().partitionId()
        rest, block, ordinal = np.empty(0, "<u4"), 0, 0

        def out(blocks: list[bytes], keys: pa.Array) -> pa.RecordBatch:
            n, m = len(blocks), len(keys)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * (n + m), pa.int64()),
                    pa.array([*range(block, block + n), *[None] * m], pa.int64()),
                    pa.array([*blocks, *[None] * m], pa.binary()),
                    pa.array([*[None] * n, *range(ordinal, ordinal + m)], pa.int64()),
                    pa.concat_arrays([pa.nulls(n, keys.type), keys]),
                ],
                names=["file", "block", "payload", "ordinal", key],
            )

        for batch in batches:
            keys = batch.column(key)
            for i, end in slices(batch.column(text), TEXT_BYTES):
                texts = batch.column(text).slice(i, end - i).to_pylist()
                flat = np.concatenate([rest, *(np.array([*encode(t or ""), separator], "<u4") for t in texts)])
                whole = len(flat) // BLOCK
                yield out([flat[k * BLOCK : (k + 1) * BLOCK].tobytes() for k in range(whole)], keys.slice(i, end - i))
                rest, block, ordinal = flat[whole * BLOCK :], block + whole, ordinal + end - i
        if len(rest):
            yield out([rest.tobytes()], keys.slice(0, 0))

    made = written(df.select(key, text).mapInArrow(run, f"file long, block long, payload binary, ordinal long, `{key}` {kind}"), "token-files")
    return made.filter("payload is not null").select("file", "block", "payload"), made.filter("payload is null").select("file", "ordinal", key)


def counts(blocks: DataFrame, separator: int, all_ended: bool = False) -> DataFrame:
    """file, ordinal, n_tokens, ended for each document of the files (file, block, payload: 32-bit little-endian ids).
    ``all_ended``: every file is known to end with a separator, so nothing is left after the last."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for payload in batch.column("payload"):
                ids = np.frombuffer(payload.as_buffer(), "<u4")
                ends = np.flatnonzero(ids == separator)
                some = len(ends) > 0
                rows.append((len(ids), len(ends), int(ends[0]) if some else None, int(ends[-1]) if some else None, (np.diff(ends) - 1).tolist()))
            columns = [list(x) for x in zip(*rows, strict=True)] if rows else [[]] * 5
            types = [pa.int64()] * 4 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["file", "block", "n", "ends", "first", "last", "inner"])

    found = blocks.mapInArrow(scan, "file long, block long, n long, ends long, first long, last long, inner array<bigint>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumns({"start": F.coalesce(F.sum("n").over(before), F.lit(0)), "ordinal": F.coalesce(F.sum("ends").over(before), F.lit(0))})
    found = found.withColumn("open", F.coalesce(F.max(F.col("start") + F.col("last") + 1).over(before), F.lit(0)))
    carried = F.col("start") - F.col("open")
    ended = found.filter("ends > 0").select("file", "ordinal", F.posexplode(F.concat(F.array(carried + F.col("first")), "inner")).alias("i", "n_tokens"))
    ended = ended.select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    if all_ended:
        return ended
    rest = found.groupBy("file").agg(F.sum("ends").alias("ordinal"), (F.sum("n") - F.coalesce(F.max(F.col("start") + F.col("last") + 1), F.lit(0))).alias("n_tokens"))
    return ended.unionByName(rest.filter("n_tokens > 0").withColumn("ended", F.lit(False)))


def count_documents(df: DataFrame, ranks: str, pattern: str, separator: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and n_tokens of each document: written to token files, counted there, and told apart by their ordinals."""
    blocks, listed = token_files(df, ranks, pattern, separator, key, text)
    return listed.join(counts(blocks, separator, all_ended=True), ["file", "ordinal"]).select(key, "n_tokens")
