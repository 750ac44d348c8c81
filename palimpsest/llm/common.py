"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a
    folder set here where a session of one process names none (local tests only).
    A cluster that names none is an error."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isEmpty():
        if not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    return set_dir.get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def drop_table(staged: DataFrame) -> None:
    """Delete a table of stage_table() that nothing reads any more."""
    drop_path(staged.sparkSession, staged._staged_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of new_path() that nothing reads any more."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (dots as two underscores) that hold within the block."""
    before = {k: spark.conf.get(k.replace("__", "."), None) for k in values}
    for k, v in values.items():
        spark.conf.set(k.replace("__", "."), v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k.replace("__", "."))
            else:
                spark.conf.set(k.replace("__", "."), v)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and reread it: cuts the lineage, and lost
    executors cost no more than the tasks they were running. The write's shuffle
    files go as soon as it ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch holds; texts may be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))


def id_split(col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def spread_partitions(spark: SparkSession, rows: int, per_task: int) -> int:
    """How many groups of about per_task rows; no fewer than one."""
    return max(1, -(-rows // per_task))


def text_bytes(column):
    """A string column of an Arrow batch as a list of bytes or None."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def numbered(docs: DataFrame, name: str = "_row") -> DataFrame:
    """docs with a row number that every scan of the result repeats. A column of
    that name, in whatever case, is an error, not overwritten.

    A plain file scan numbers its rows alike each time; anything else is first
    written to the shared folder. How files are split must not change between
    scans, so what it would take from the cores at hand, which change as executors
    come and go, is held fixed for the session.
    """
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the rows already have a column {name}")
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    nodes = {line.lstrip(" +-:").split(" ")[0] for line in plan.splitlines() if line.strip()}
    if not all(n.startswith(("Project", "Relation")) for n in nodes):
        docs = stage_table(docs, "rows")
    return docs.withColumn(name, F.monotonically_increasing_id())


_BASE = 0x9E3779B97F4A7C15
_HELD: dict = {}


def _tables(n: int):
    """Random values of the 256 bytes, powers of an odd base and their inverses,
    for at least n places."""
    import numpy as np

    if len(_HELD.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _HELD[name] = np.multiply.accumulate(table)
        _HELD["value"] = np.random.default_rng(2024).integers(0, 2**64, 256, dtype=np.uint64)
        _HELD["second"] = np.random.default_rng(4202).integers(0, 2**64, 256, dtype=np.uint64)
        _HELD["space"] = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
        _HELD["sign"] = ~np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
    return _HELD["value"], _HELD["up"], _HELD["down"]


def _words(parts: list, lower: bool, gaps: str, twice: bool):
    """Words of a group of texts: (lower-cased bytes, first and past byte of each
    word, hashes, second hashes or None, words of each text)."""
    import numpy as np

    data = b"\n".join(parts) + b"\n"
    data = np.frombuffer(data.lower() if lower else data, dtype=np.uint8)
    value, up, down = _tables(len(data))
    gap = _HELD[gaps][data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate([[0], edge])
    first, past = edge[::2], edge[1::2]  # the last byte is a gap
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(value[data] * up[: len(data)], out=total[1:])
    h = mix((total[past] - total[first]) * down[first] + (past - first).astype(np.uint64) * np.uint64(_BASE))
    second = None
    if twice:
        np.cumsum(_HELD["second"][data] * up[: len(data)], out=total[1:])
        second = mix((total[past] - total[first]) * down[first] + np.uint64(0xC2B2AE3D27D4EB4F))
    bounds = np.cumsum([len(p) + 1 for p in parts])
    return data, first, past, h, second, np.diff(np.searchsorted(first, bounds), prepend=0)


def word_groups(texts: list, lower: bool = False, group: int = 1 << 19, gaps: str = "space", twice: bool = False):
    """(index of the first text, what ``_words`` gives) of groups of about group
    bytes, whole texts each."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < group):
            size += len(texts[end] or b"") + 1
            end += 1
        yield at, _words([t or b"" for t in texts[at:end]], lower, gaps, twice)
        at = end


def hash_words(texts: list, lower: bool = False, group: int = 1 << 19, twice: bool = False):
    """64-bit hashes of the words (runs of other than ASCII white space) of all
    texts, one after another, and the number of words of each text; with twice a
    second, independent hash of each word stands between them.

    A word's hash is a polynomial of random values of its bytes, taken from
    running sums over the text, so no word is ever handled by itself."""
    import numpy as np

    found = [w for _, w in word_groups(texts, lower, group, twice=twice)]
    hashes = np.concatenate([np.zeros(0, dtype=np.uint64), *(w[3] for w in found)])
    counts = np.concatenate([np.zeros(0, dtype=np.int64), *(w[5] for w in found)])
    if twice:
        return hashes, np.concatenate([np.zeros(0, dtype=np.uint64), *(w[4] for w in found)]), counts
    return hashes, counts


def powers(base: int, n: int):
    import numpy as np

    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


class Stretches:
    """Hashes of any stretch [a, b) of words, 64 bits for each array of word
    hashes."""

    #: Fixed odd multipliers of the two polynomials.
    BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self, *hashes):
        import numpy as np

        n = len(hashes[0])
        self.sums, self.back = [], []
        for v, base in zip(hashes, self.BASES, strict=False):
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(v * powers(base, n), out=total[1:])
            self.sums.append(total)
            self.back.append(powers(pow(base, -1, 2**64), n + 1))

    def of(self, k: int, a, b):
        return mix((self.sums[k][b] - self.sums[k][a]) * self.back[k][a])


def mix(x):
    """A bijection on uint64 arrays that spreads every bit."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
