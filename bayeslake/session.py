"""Session construction and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import warnings
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings this library relies on: AQE re-plans joins and coalesces small
# shuffles, and splits a skewed partition of the big side of a lookup join.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8,
              app: str = "bayeslake", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(RECOMMENDED_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and is read, never replaced;
    without it a cluster run is refused. Only a local master gets a private
    folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="bayeslake-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


@contextmanager
def compiled_in_parts(spark: SparkSession):
    """For actions on rows of many computed columns: a stage whose generated code would be
    one method over the JVM's limit of 8000 bytes, which is then interpreted, runs operator
    by operator instead, each compiled in small methods. Results are the same."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


# ---- scratch folders and who removes them -------------------------------------------
_current: ContextVar["ScratchRun | None"] = ContextVar("bayeslake_scratch_run", default=None)


def remove_scratch(spark: SparkSession, paths) -> None:
    """Delete scratch folders; one that cannot be deleted is reported, not raised."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        try:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
        except Exception as e:  # the run's own error, if any, must not be hidden
            warnings.warn(f"scratch folder {p} was not removed: {e}")


class ScratchRun:
    """The scratch folders made while it is the current run."""

    def __init__(self, spark: SparkSession, outer: "ScratchRun | None"):
        self.spark, self.outer, self.paths = spark, outer, []

    def hand_out(self, df: DataFrame) -> DataFrame:
        """Give the folder of a table from ``kept`` (or of any frame with ``scratch``)
        to the enclosing run, or to nobody: it outlives this run."""
        self.paths.remove(df.scratch)
        if self.outer:
            self.outer.paths.append(df.scratch)
        return df

    def result(self, df: DataFrame) -> DataFrame:
        """``df`` written now and handed out: what a run leaves behind."""
        return self.hand_out(kept(df))


@contextmanager
def scratch_run(spark: SparkSession):
    """Own the scratch folders made inside the block and remove them when it ends,
    also by an error. Frames are lazy: read or write what is wanted inside the block, or
    take it out by ``run.result``. Runs nest; without one, folders stay until the
    deployment clears ``spark.checkpoint.dir`` or a model's ``release``::

        with scratch_run(spark):
            near_duplicates(docs).write.parquet(target)
    """
    run = ScratchRun(spark, _current.get())
    token = _current.set(run)
    try:
        yield run
    finally:
        _current.reset(token)
        remove_scratch(spark, run.paths)


def _own(path: str) -> str:
    run = _current.get()
    if run:
        run.paths.append(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder, owned by the current run."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return _own(f"{base}/{name}-{uuid.uuid4().hex}")


def kept(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` whose files the current run owns; ``scratch`` names their folder."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    out.scratch = _own(out._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
    return out
