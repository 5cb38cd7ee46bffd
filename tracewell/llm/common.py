"""Helpers shared by the operators: Arrow passes over rows, checkpoints, names."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Text bytes handled at once inside a task; what a pass holds is a small multiple of it.
SLICE_BYTES = 8 << 20


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` of about ``most`` bytes; a larger row stands alone."""
    if not batch.num_rows:
        return
    step = max(1, int(most * batch.num_rows / max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def annotate(df: DataFrame, inputs: Sequence[str], fields: T.StructType, make: Callable[[], Callable],
             name: str, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with a struct column ``name`` computed row by row.

    ``make()`` runs once in each task and returns a function that turns the Arrow
    columns ``inputs`` of some rows into a list with a tuple for each row, or into
    a tuple with an Arrow array for each field. There is no shuffle, and text is held in slices.
    """
    kept = list(df.columns if keep is None else keep)
    sent = df.select(*kept, *[c for c in dict.fromkeys(inputs) if c not in kept])
    schema = T.StructType([sent.schema[c] for c in kept] + [T.StructField(name, fields, False)])
    names = [f.name for f in fields]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch):
                out = work(*[part.column(c) for c in inputs])
                if isinstance(out, list):
                    cols = list(zip(*out, strict=True)) or [()] * len(names)
                    out = [pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]
                made = pa.StructArray.from_arrays(list(out), fields=[pa.field(n, a.type) for n, a in zip(names, out, strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [made], names=[*kept, name])

    return sent.mapInArrow(run, schema)


def texts(col: pa.Array) -> list[str]:
    """Python strings; null is empty."""
    return ["" if t is None else t for t in col.to_pylist()]


def raw(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes; null is empty."""
    return [b"" if t is None else t for t in col.cast(pa.binary()).to_pylist()]


def _shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only a session of this one machine, as in tests, gets one where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder of ``spark.checkpoint.dir`` and read from there.

    The files outlive the executors that wrote them.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def per_worker(key: tuple, make: Callable[[], object]) -> object:
    """The value of ``make()``, shared by the tasks of a Python worker, which keeps one for each first part of a key."""
    home = sys.modules.setdefault("_tracewell_kept", types.ModuleType("_tracewell_kept"))
    kept = home.__dict__.setdefault("kept", {})
    if key not in kept:
        for old in [k for k in kept if k[0] == key[0]]:
            del kept[old]
        kept[key] = make()
    return kept[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the checkpoint folder and read back: for wide rows, which it compresses."""
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
