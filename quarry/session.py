"""Session construction and shared-folder helpers.

On a cluster the session is created by the platform; ``get_session`` only
fills in settings that are unset. The checkpoint folder comes from
``spark.checkpoint.dir`` as the cluster names it; a private folder is
created only when that setting is missing (local runs and tests).
"""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings applied when the session is built here. AQE re-plans joins and
# coalesces/splits shuffle partitions at run time; skew-join splitting
# handles a key that holds a large share of rows.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # delete reliable-checkpoint files once their RDDs are garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "quarry") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_PRIVATE_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The setting is read, never changed (Spark rejects runtime changes to
    it). Without it, a checkpoint folder already set on the SparkContext is
    used; failing that, a private folder is created once per application
    where the master is local, and on a cluster it is an error: a local
    folder there is on the driver's machine alone.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        try:
            path = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:  # noqa: BLE001 - not a SQL conf in some versions
            path = None
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = sc.applicationId
        if app not in _PRIVATE_ROOTS:
            _PRIVATE_ROOTS[app] = tempfile.mkdtemp(prefix="quarry-ckpt-")
        path = _PRIVATE_ROOTS[app]
    return path.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make ``DataFrame.checkpoint`` write under the shared folder, and make
    this package importable on the executors."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(checkpoint_root(spark))
    ship_code(spark)
    return sc.getCheckpointDir()


_SHIPPED: set[str] = set()


def _package_zip() -> bytes:
    import io
    import os
    import zipfile
    root = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _dirs, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    arc = os.path.join("quarry", os.path.relpath(full, root))
                    info = zipfile.ZipInfo(arc, date_time=(2020, 1, 1, 0, 0, 0))
                    with open(full, "rb") as fh:
                        zf.writestr(info, fh.read())
    return buf.getvalue()


def ship_code(spark: SparkSession) -> None:
    """Python workers import ``quarry`` for pandas UDFs and mapInPandas. The
    package is zipped into the shared folder (Hadoop FileSystem API) and
    added with ``addPyFile`` once per Spark application."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    data = _package_zip()
    digest = hashlib.sha1(data).hexdigest()[:12]
    path = shared_path(spark, "pyfiles", f"quarry-{digest}.zip")
    if not fs_exists(spark, path):
        p, fs = _fs(spark, path)
        out = fs.create(p, True)
        out.write(bytearray(data))
        out.close()
    sc.addPyFile(path)
    _SHIPPED.add(app)


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (visible to every executor)."""
    return "/".join([checkpoint_root(spark), "quarry", *parts])


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fs_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def fs_touch(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.create(p, True).close()


def derived_path(spark: SparkSession, name: str, *keys: str) -> str:
    """Stable location for a table that Spark derives from the inputs.

    The key hash makes the path depend on the input location, so that
    different scale factors never share a derived table.
    """
    digest = hashlib.sha1("|".join(keys).encode()).hexdigest()[:12]
    return shared_path(spark, "derived", f"{name}-{digest}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back. For loops of many rounds: unlike a
    checkpoint, what is read back carries no size estimates and constraints of the plans before it,
    which would grow from round to round."""
    import uuid
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = shared_path(spark, "rounds", uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def laid_out(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` written once to the shared folder as a table bucketed by ``keys``, one bucket for each
    shuffle partition. Joins and groupings by these keys then read it in place; only the other side
    of a join moves."""
    import uuid
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"quarry_layout_{uuid.uuid4().hex[:16]}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys)
     .option("path", shared_path(spark, "layout", name)).saveAsTable(name))
    return spark.table(name)
