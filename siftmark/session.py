"""Session helpers: shared scratch space, materialisation and size-checked broadcasts.

Everything that cuts lineage goes to the folder that the cluster names in
``spark.checkpoint.dir`` (a path every executor and the driver can reach), as Parquet written by
Spark's own committer, so a lost executor costs a task retry and never the result.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of these in memory, beyond which a side is joined by shuffle instead of broadcast (see ``broadcast_if_small``).
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20
#: What a row takes in a table of hashes besides its values.
ROW_BYTES = 32
#: Tasks over which ``lookup`` deals the rows of one key.
SALTS = 16
#: A key is hot if it has more rows than this, and more than one in so many of all rows.
HOT_ROWS, HOT_KEYS = 1_000, 1_000
#: Words of 64 bits in the map by which ``join_texts`` leaves out rows without a partner (1 MB).
MAP_WORDS = 1 << 17

_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, below ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset, a local session gets a temporary folder
    of its machine; on a cluster, whose executors don't share that, RuntimeError is raised.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _scratch:
        base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if not base and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="siftmark-")
        _scratch[app] = f"{base.rstrip('/')}/siftmark-{app}"
        atexit.register(_clean, spark, _scratch[app])
    return _scratch[app]


def _clean(spark: SparkSession, path: str) -> None:
    """Delete the scratch folder at exit, if the session still runs."""
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    except Exception:  # noqa: BLE001 - the JVM may be gone already; the folder is scratch
        pass


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the scratch folder and return a DataFrame that reads it.

    Cuts lineage, lets later stages start from statistics of real files, and stops a plan from
    being computed once for each branch that uses it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``max_rows`` rows of at most ``max_bytes`` in all, else leave it alone.

    The driver builds what is broadcast, several times over, so bytes are those of the values and not of the compressed files.

    The bounds are ``BROADCAST_ROWS`` and ``BROADCAST_BYTES`` if none are given. ``df`` should be a materialised table: cheap to count, of known size.
    """
    return F.broadcast(df) if _is_small(df, max_rows, max_bytes) else df


def _is_small(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> bool:
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most, room = BROADCAST_ROWS if max_rows is None else max_rows, BROADCAST_BYTES if max_bytes is None else max_bytes
    if size > room or most < 0:
        return False
    width = F.coalesce(F.octet_length(F.to_json(F.struct("*"))), F.lit(0)) + ROW_BYTES
    found = df.limit(most + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return found.n <= most and found.bytes <= room


def lookup(rows: DataFrame, found: DataFrame, on: list[str], spread: list[str], how: str = "inner", salts: int = SALTS, counts: str | None = None) -> DataFrame:
    """Join ``rows``, whose keys may be hot, with a materialised table of one row (or few) for each key.

    A small table is broadcast. Of a larger one each row is sent ``salts`` times, and the rows of a
    key are dealt over as many tasks by a hash of the columns ``spread``. A table that grows with
    ``rows`` names the column ``counts`` with the number of rows of its key: it is shuffled at any
    size, only its hot keys (at most ``HOT_KEYS``, which are broadcast) are dealt out, and the
    column is left out of the result.
    """
    if counts is None and _is_small(found):
        return rows.join(F.broadcast(found), on, how)
    salt, last = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"), F.lit(salts - 1)
    if counts is None:
        dealt = rows.withColumn("_salt", salt)
    else:
        total = found.agg(F.sum(counts)).first()[0] or 0
        is_hot = F.col(counts) > max(HOT_ROWS, total // HOT_KEYS)
        hot = found.where(is_hot).select(*on, F.lit(True).alias("_hot"))
        dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
        last = F.when(is_hot, last).otherwise(0)
    copied = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
    return dealt.join(copied if counts is None else copied.drop(counts), [*on, "_salt"], how).drop("_salt")


def join_texts(texts: DataFrame, found: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Inner join of ``doc_id, mark, text`` with a materialised table of ``_id, _mark`` and more; null ids are equal.

    A table smaller than the map is broadcast. For a larger one the texts are shuffled, but only those
    whose bit is set in a map of the table's keys (``MAP_WORDS``, whatever the size of the table); the
    join settles the rest, so a map that is too full costs a shuffle and never the result.
    """
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    if _is_small(found, max_rows, 8 * MAP_WORDS):
        return texts.join(F.broadcast(found), same)
    own, theirs = F.xxhash64("doc_id", "mark"), F.xxhash64("_id", "_mark")
    word = lambda h: F.pmod(h, F.lit(MAP_WORDS))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int"))
    set_bits = found.select(word(theirs).alias("id"), bit(theirs).alias("bits")).groupBy("id").agg(F.bit_or("bits").alias("bits"))
    words = texts.sparkSession.range(MAP_WORDS).join(set_bits, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    one = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("_map"))  # MAP_WORDS entries
    maybe = F.element_at("_map", (word(own) + 1).cast("int")).bitwiseAND(bit(own)) != 0
    return texts.join(F.broadcast(materialize(one, "map")), maybe, "left_semi").join(found, same)
