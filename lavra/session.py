"""Session factory and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lavra.contracts import ContractError

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "lavra", **conf: str) -> SparkSession:
    """A session with UTC time, ANSI casts left on and adaptive execution; ``conf`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that all machines share.

    A temporary folder of this machine takes its place where it is unset and the master is ``local``: tests, a laptop.
    On a cluster each executor would write to a disk of its own, so there its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ContractError(f"spark.checkpoint.dir is not set, and master {master} needs a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="lavra-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``."""
    return f"{_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def state_dir(spark: SparkSession, *names: str) -> str:
    """The folder of that name, the same in each run: below ``spark.lavra.state.dir``, else ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.lavra.state.dir", None) or f"{_checkpoint_dir(spark)}/lavra-state"
    return "/".join([base.rstrip("/"), *names])


def folders(spark: SparkSession, path: str, holding: str) -> list[str]:
    """The sorted names of the folders in ``path`` that hold the file ``holding``."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(hadoop(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(hadoop(path))]
    return sorted(n for n in names if fs.exists(hadoop(f"{path}/{n}/{holding}")))


def delete_folder(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    hadoop(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(hadoop(path), True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, the sizes are known to the
    planner, and the rows survive the loss of any executor. The folder goes with ``release``, at the latest when the
    driver ends."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(hadoop)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that ``materialize`` wrote, but for the first ``since`` (``written()`` tells how many there are);
    what was derived from them can then no longer be computed. Gives how many went."""
    gone = _written[since:]
    del _written[since:]
    for path in gone:
        delete_folder(spark, path)
    return len(gone)


def written() -> int:
    return len(_written)


def ship_package() -> None:
    """Give the workers this package, once per application: Python functions sent to them import from it.

    Needed wherever the package is not installed on the executors; harmless where it is.
    """
    context = SparkSession.active().sparkContext
    if getattr(context, "_lavra_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lavra-package-")) / "lavra.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(Path("lavra") / path.relative_to(root)))
    context.addPyFile(str(target))
    context._lavra_shipped = True
