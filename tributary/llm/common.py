"""Shared pieces of the training-data operators: Arrow kernels, folds, samples, checkpoints."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The folder that holds this package.
HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Bytes of text that one kernel call sees at most (one text more if that text alone is larger).
SLICE_BYTES = 4 << 20

#: Bytes of one Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table as Spark reads it, from any path that Spark's readers open."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes as well as by rows, so that long texts do not pile up in one batch.

    Python workers also look for this package where the driver found it, for sessions started outside its folder.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", HOME)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("bB").isdigit() or int(now.rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; where none is set a local session (tests) gets one, a cluster an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        set_to = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
        if not set_to and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(set_to or os.path.join(tempfile.gettempdir(), "tributary-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate data that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialized(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, where a lost executor does not take it along."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written to ``folder`` and read again: unlike a checkpoint it forgets the size that Spark estimated for it.

    In loops of joins these estimates are products, whose digits multiply from round to round until planning stands still.
    """
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def give_back() -> None:
    """Returns memory that a task has freed to the system: a worker lives on for tasks of other operators, and what its
    allocators keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def local_table(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """Rows of the driver as a DataFrame by way of Arrow: a list of rows that Spark takes as it is passes through Python
    workers of its own on the executors, which live on beside those of the kernels."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = [pa.array([r[i] for r in rows], arrow_type(f.dataType)) for i, f in enumerate(struct.fields)]
    return spark.createDataFrame(pa.table(columns, names=struct.names), struct)


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def slices(values: list, size: Callable = len, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``values`` of about ``limit`` bytes; every range has at least one value."""
    start = total = 0
    for i, v in enumerate(values):
        n = 0 if v is None else size(v)
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(values):
        yield start, len(values)


def byte_lists(col: pa.Array) -> list:
    """UTF-8 bytes of a string column, None for null."""
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def text_kernel(kernel: Callable[[list], dict], schema: str, raw: bool = True, limit: int = SLICE_BYTES):
    """A column function that runs ``kernel`` on slices of a text column, of about ``limit`` bytes.

    ``kernel`` takes a list of bytes (``raw``) or strings with None for null and returns a list or array for each
    field of ``schema``; the function yields a struct column, so all other columns stay in the JVM untouched.
    """
    struct = T.StructType.fromDDL(schema)
    fields = [(f.name, f.dataType) for f in struct.fields]

    def run(col: pa.Array) -> pa.Array:
        values = byte_lists(col) if raw else col.to_pylist()
        parts = []
        for a, b in slices(values, limit=limit):
            got = kernel(values[a:b])
            parts.append(pa.StructArray.from_arrays([pa.array(got[n], type=arrow_type(k)) for n, k in fields], names=[n for n, _ in fields]))
        del values
        give_back()
        if not parts:
            return pa.array([], type=pa.struct([(n, arrow_type(k)) for n, k in fields]))
        return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)

    run.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returnType=struct)


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores behind it until no column has it; names differ if they differ in more than case."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def without(columns: Iterable[str], names: Iterable[str]) -> list[str]:
    """The columns that no one of ``names`` replaces; Spark takes names that differ in case only for the same."""
    gone = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in gone]


def with_struct(df: DataFrame, made: Column, names: Iterable[str], keep: Iterable[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) and the fields of the struct column ``made``; a clashing name, in whatever case, gives way to the field."""
    names = list(names)
    kept = without(df.columns if keep is None else keep, names)
    tmp = free("__made", kept)
    return df.select(*[F.col(f"`{c}`") for c in kept], made.alias(tmp)).select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"{tmp}.{n}").alias(n) for n in names])


def salted(big: DataFrame, small: DataFrame, key: str, ways: int = 16, how: str = "inner") -> DataFrame:
    """The join of ``big`` with ``small``, whose keys are distinct, with each key's rows of ``big`` dealt to ``ways`` tasks.

    ``small`` goes along ``ways`` times; so it must be the side of few rows, and ``big`` the one with hot keys.
    """
    salt = free("__salt", [*big.columns, *small.columns])
    deal = F.pmod(F.xxhash64(*[c for c in big.columns if c != key]), F.lit(ways)).cast("int")
    return big.withColumn(salt, deal).join(small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))), [key, salt], how).drop(salt)


def labelled_sample(docs: DataFrame, label: str, bound: int, key: str = "doc_id") -> list[tuple]:
    """(key, label) of at most ``bound`` rows for each label value: those of smallest hash, found without a global sort.

    A count for each label gives the share of the hash range that holds about 1.2 x ``bound`` rows; one job over all
    labels brings the distinct rows in these shares to the driver, which takes the first of each. Null keys and labels
    are left out; repeated (key, label) rows count once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("k"), F.col(label).alias("y")).where("k is not null and y is not null")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    tops = []
    for y, n in counts.items():
        share = min(1.0, (1.2 * bound + 200) / n)
        tops.append((y, int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1))
    shares = F.broadcast(local_table(spark, tops, T.StructType([T.StructField("y", rows.schema["y"].dataType), T.StructField("top", T.LongType())])))
    spread = F.xxhash64(F.lit(20260517), F.col("k")).alias("h")
    got = rows.select("k", "y", spread).join(shares, "y").where("h <= top").select("y", "h", "k").distinct().toArrow()
    by: dict = {}
    for y, h, k in zip(*[got.column(c).to_pylist() for c in ("y", "h", "k")]):
        by.setdefault(y, []).append((h, k))
    return [(k, y) for y in sorted(by, key=str) for _, k in sorted(by[y])[:bound]]


def runs(batches, n_keys: int):
    """Tables of whole groups: rows of equal first ``n_keys`` columns are adjacent in the batches and stay together."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        if held:
            table = pa.concat_tables([*held, table])
        cols = [table.column(i).to_numpy() for i in range(n_keys)]
        new = np.zeros(table.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        last = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if last:
            yield table.slice(0, last), np.concatenate([[0], np.flatnonzero(new[:last])])
        held = [table.slice(last)]
    if held:
        table = pa.concat_tables(held)
        new = np.zeros(table.num_rows, bool)
        for i in range(n_keys):
            c = table.column(i).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        yield table, np.concatenate([[0], np.flatnonzero(new)])


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 50, balance: bool = True) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    if not len(x) or y.min() == y.max():
        w[-1] = 0.0 if not len(x) else (2.0 if y[0] == 1 else -2.0)
        return w
    sw = np.where(y == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean())) if balance else np.ones(len(y))
    ridge = np.eye(x1.shape[1]) * l2 * len(y) / 100
    ridge[-1, -1] = 1e-9
    for _ in range(rounds):
        p = sigmoid(x1 @ w)
        g = x1.T @ (sw * (p - y)) + ridge @ w
        h = (x1 * (sw * p * (1 - p))[:, None]).T @ x1 + ridge
        step = np.linalg.solve(h + 1e-9 * np.eye(len(w)), g)
        size = np.abs(step).max()
        w -= step * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-7:
            break
    return w
