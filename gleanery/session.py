"""Session and table helpers shared by the queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gleanery")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders of local applications, by id.
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where that is unset, a temporary one, for a
    local master only: the executors of a cluster don't see each other's disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        folder = _own_folders.get(application) or _own_folders.setdefault(application, tempfile.mkdtemp(prefix="gleanery-"))
    return folder.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """The folder of this application below the shared one."""
    return f"{shared_folder(spark)}/gleanery-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder, read back: what follows neither repeats what made it nor depends on the
    executors that made it. With `by`, a filter on that column reads the files of its value alone."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
