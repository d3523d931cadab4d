"""What the operators of this subpackage share: inputs, shared files, folds."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import time
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, so that no other column of the input can clash."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gristmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 1 << 21
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """From now on this session sends Arrow batches of BATCH_BYTES at most: by default 64 MB, which two tasks and
    their workers hold several times. For applications; operators leave the session as it is."""
    spark.conf.set(_BATCH, str(BATCH_BYTES))


@contextmanager
def scratch(spark: SparkSession):
    """What store() writes inside goes to one folder, which is removed at the end; only lasting tables stay.
    What runs inside gets Arrow batches of BATCH_BYTES, so that long texts do not fill a worker."""
    if _scratch.get():
        yield
        return
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _scratch.set(folder)
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        _scratch.reset(token)
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)
        remove(spark, folder)


#: Seconds after which a worker that goes on with its groups gives back again what it has freed.
GIVE_BACK = 2.0


def lean(heavy: str | None = None) -> None:
    """Drops what else is kept and heavy from this Python worker, which Spark uses again and again, and makes it
    give back to the system what it frees: large arrays at once, where the C library can, the rest now and then."""
    others = sys.__dict__.setdefault("_gristmill_heavy", {})
    dropped = [others.pop(name) for name in list(others) if name != heavy]

    def make():
        try:
            ctypes.CDLL(None).mallopt(-3, 1 << 19)  # M_MMAP_THRESHOLD: also, it no longer grows
        except (AttributeError, OSError):
            pass
        return True

    kept("lean", make)
    if dropped or time.monotonic() - sys.__dict__.get("_gristmill_gave", 0.0) > GIVE_BACK:
        dropped.clear()
        give_back()


def give_back() -> None:
    """Returns to the system what Arrow and the C library hold for later: a worker keeps it between tasks otherwise."""
    sys.__dict__["_gristmill_gave"] = time.monotonic()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def small_batches(batches, column: str = "text", heavy: str | None = None):
    """The same rows in slices of about BATCH_BYTES of one column, one row at least; heavy: what is kept meanwhile."""
    lean(heavy)
    for batch in batches:
        rows = max(1, int(batch.num_rows * BATCH_BYTES / max(1, batch.column(column).nbytes)))
        if rows >= batch.num_rows:
            yield batch
        else:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
        del batch
    give_back()


def work_dir(spark: SparkSession) -> str:
    return _scratch.get() or shared_dir(spark)


def store(df: DataFrame, tag: str, lasting: bool = False) -> DataFrame:
    """Writes df below the shared folder and reads it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark) if lasting else work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Removes what store() has written."""
    remove(df.sparkSession, df.stored_at)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_fold(mod: int, rest: int) -> Column:
    """Whether crc32(doc_id as text) mod `mod` is `rest`; a null id never is."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(crc % F.lit(mod) == F.lit(rest), F.lit(False))


#: Ids that are broadcast to pick rows out; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def pick(docs: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """The rows of docs whose doc_id is (keep) or is not in ids, which has that one column."""
    own = fresh(docs, "id")
    ids = store(ids.select(F.col("doc_id").alias(own)).distinct(), "picked", lasting=True)
    few = ids.count() <= BROADCAST_IDS
    how = "left_semi" if keep else "left_anti"
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col(own)), how)


def distinct_ids(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").count().where("count > 1").limit(1).count()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_path(name: str) -> str:
    """Where this machine has a vocabulary file of the tokenizer package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def resolved(path) -> str:
    """A path, or what a function that is called where the file is opened gives."""
    return path() if callable(path) else path


def kept(name: str, make, heavy: bool = False):
    """make(), once for each Python process; of what is heavy, only the last is held, until a worker does something else."""
    held = sys.__dict__.setdefault("_gristmill_heavy" if heavy else "_gristmill", {})
    if name not in held:
        if heavy:
            held.clear()
        held[name] = make()
    return held[name]


#: Edges that one task joins up by itself; more are joined by rounds over all tasks.
FEW_EDGES = 250_000


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(id, root): the least id that links reach, for every id in edges (a, b).

    Up to FEW_EDGES edges (counted first, 16 bytes each) go through one task.  More
    take rounds of least-neighbour hooking and pointer jumping over tables in the
    shared folder, until no label changes; the number of rounds grows with the
    logarithm of the longest path, and a hub is pre-aggregated by the partial
    minimum before each shuffle."""
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if edges.count() <= FEW_EDGES:
        return store(edges.coalesce(1).mapInArrow(union_find, "id bigint, root bigint"), tag)
    edges = store(edges.distinct(), tag)
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = store(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("root")), tag)
    while True:
        seen = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        hooked = label.join(seen, "id").select("id", "root", F.least("root", "near").alias("new"))
        # the root of a label hooks to the least label that any of its members sees
        by_root = hooked.groupBy(F.col("root").alias("id")).agg(F.min("new").alias("best"))
        up = store(hooked.join(by_root, "id", "left").select("id", "root", F.least("new", "best").alias("new")), tag)
        jump = up.select(F.col("id").alias("new"), F.col("new").alias("next"))
        far = store(up.join(jump, "new", "left").select("id", "root", F.least("new", "next").alias("new")), tag)
        changed = far.where("new <> root").limit(1).count()
        drop(label)
        drop(up)
        label = far.select("id", F.col("new").alias("root"))
        label.stored_at = far.stored_at
        if not changed:
            return label


def union_find(batches):
    """(id, root) of all edges (a, b) of one task."""
    parent: dict[int, int] = {}
    for batch in batches:
        for pair in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            tops = []
            for x in pair:
                path = []
                while (up := parent.setdefault(x, x)) != x:
                    path.append(x)
                    x = up
                for y in path:
                    parent[y] = x
                tops.append(x)
            parent[max(tops)] = min(tops)
    roots = []
    for x in parent:
        while parent[x] != x:
            x = parent[x]
        roots.append(x)
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array(roots, pa.int64())], ["id", "root"])
