"""Tables and shared folders for the operators."""

from __future__ import annotations

import uuid
from contextlib import suppress

from py4j.java_collections import JavaArray
from py4j.java_gateway import JavaClass, JavaGateway
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where none is set: one of our own in a local session, as in tests, an error on a cluster."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        current = sc._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = current.get() if current.isDefined() else "file:///tmp/riskloom-shared"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/riskloom-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """The frame as a table in the shared folder: lineage ends there, and lost executors don't matter."""
    spark = df.sparkSession
    path = new_path(spark, what)
    # the table replaces what was shuffled for it, so those files go when it is done;
    # the driver describes the plan anew after each shuffle: with the tree alone that is several times less text
    meanwhile = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.ui.explainMode": "simple"}
    before = {key: spark.conf.get(key, None) for key in meanwhile}
    for key, value in meanwhile.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    give_back(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


#: Share of the driver's largest heap from which its garbage is collected between tables.
HEAP_SHARE = 0.75


def give_back(spark: SparkSession) -> str | None:
    """Return to the system what the driver's JVM has freed; what the JVM says of it.

    Compilers and hundreds of short-lived threads leave freed memory in the C library's
    arenas, which keeps it for as long as the JVM lives; a heap that grew by garbage
    shrinks only when it is collected in full. A JVM without the command keeps its arenas.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    runtime = jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        jvm.java.lang.System.gc()
    strings = gateway.new_array(jvm.java.lang.String, 0)
    server, name = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    # the server's class is not open, its interface is
    kinds = [jvm.java.lang.Class.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", _array(gateway, jvm.java.lang.Class, kinds))
    with suppress(Py4JJavaError):
        return invoke.invoke(server, _array(gateway, jvm.java.lang.Object, [name, "systemTrimNativeHeap", strings, strings]))
    return None


def _array(gateway: JavaGateway, kind: JavaClass, values: list) -> JavaArray:
    out = gateway.new_array(kind, len(values))
    for i, value in enumerate(values):
        out[i] = value
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables that written() made and that nothing will read again."""
    for frame in frames:
        jvm = frame.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(frame._written_at)
        where.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def free_name(columns: list[str], name: str) -> str:
    """The name, or one made from it, that none of the columns has (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of an Arrow batch for operators over whole texts: some megabytes, whatever the executors' memory.
TEXT_BATCH_ROWS = 2000


def text_batches(df: DataFrame) -> DataFrame:
    """The frame, after seeing to it that Python workers get its texts in small Arrow batches."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXT_BATCH_ROWS:
        conf.set(key, str(TEXT_BATCH_ROWS))
    return df
