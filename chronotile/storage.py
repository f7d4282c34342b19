"""Written tables in the folder that driver and executors share: lineage ends there, and lost executors lose nothing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode
    (one machine, as in tests), and an error on a cluster, whose machines share no such folder."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    try:
        return spark.conf.get("spark.checkpoint.dir").rstrip("/")
    except Exception:  # unset
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share") from None
        path = "file://" + tempfile.mkdtemp(prefix="chronotile-")
        spark.conf.set("spark.checkpoint.dir", path)
        return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_roots: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{shared_dir(spark)}/tables-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(drop_tables, spark, app)
    return _roots[app]


def drop_tables(spark: SparkSession, app: str | None = None) -> None:
    """Deletes what `written` has put into the shared folder."""
    root = _roots.pop(app or spark.sparkContext.applicationId, None)
    if root:
        try:
            _delete(spark, root)
        except Exception:  # the session has ended; the shared folder is cleaned by its owner
            pass


#: Rows and bytes that go to a Python worker at once while `written` runs: whole texts are long rows.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    schema = df.schema
    before = {k: spark.conf.get(k) for k in BATCH}
    for k, most in BATCH.items():
        spark.conf.set(k, str(min(int(before[k].rstrip("bB")), most)))
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes written tables that no later read needs."""
    for df in frames:
        spark = df.sparkSession
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if "/tables-" in f:
                _delete(spark, f)
