"""What the operators of this subpackage share: reading tables, writing cut points, word patterns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts count words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This session's folder for written tables, below ``spark.checkpoint.dir``. Where that is unset and everything runs in one
    local process (tests), a new temporary folder; on a cluster, an error."""
    found = spark.conf.get("lodestar.scratch.dir", None)
    if not found:
        top = spark.conf.get("spark.checkpoint.dir", None)
        master = spark.sparkContext.master
        if not top and master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{top}/lodestar-{uuid.uuid4().hex}" if top else "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("lodestar.scratch.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: its lineage ends there, so a lost
    executor costs no recomputation beyond the table, and several readers share one computation. A result reads its tables
    when it is read itself, so they stay until ``clean_up``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Delete all tables that ``written`` has made in this session. Results not yet written elsewhere can't be read after it."""
    if found := spark.conf.get("lodestar.scratch.dir", None):
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        spark.conf.unset("lodestar.scratch.dir")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, changed where ``df`` has such columns already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text, as two long columns ``t1`` and ``t2``."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


#: Arrow types of the columns that ``map_texts`` adds, by their DDL names.
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def slices(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Starts and ends of runs of rows of about ``size`` bytes, by the lengths alone: a value isn't unpacked before its turn."""
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(column).fill_null(0).to_pylist(), 1):
        held += n
        if held >= size or i == len(column):
            yield start, i
            start, held = i, 0


def map_texts(df: DataFrame, keep: list[str], text: str, fn: Callable[[], Callable[[list], dict[str, list]]], out: dict[str, str], size: int = 1_000_000, arrow: dict[str, pa.DataType] | None = None) -> DataFrame:
    """The columns ``keep`` as they are (nulls and large integers too) and those that ``fn()(texts)`` makes of about
    ``size`` bytes of texts at a time. ``fn`` is called once a task. ``out``: name -> DDL type of a new column;
    ``arrow``: the Arrow types of nested ones."""
    types = {c: (arrow or {}).get(c) or _ARROW[t] for c, t in out.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = fn()
        for batch in batches:
            for start, end in slices(batch.column(text), size):
                made = make(batch.column(text).slice(start, end - start).to_pylist())
                kept = [batch.column(c).slice(start, end - start) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(made[c], t) for c, t in types.items())], names=[*keep, *types])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{c}` {t}" for c, t in out.items())])
    return df.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, text]))).mapInArrow(run, schema)
