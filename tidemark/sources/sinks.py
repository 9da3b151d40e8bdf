"""Writers that publish whole results or nothing."""

from __future__ import annotations

import hashlib
import json
import unicodedata
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share.

    ``spark.checkpoint.dir`` names it; a session on one machine may go without.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    top = top or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a table that no later job reads."""
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A small JSON file, or None where there is none."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def write_json_once(spark: SparkSession, path: str, value: dict) -> bool:
    """Create a small JSON file whole; false, and nothing changed, if it is there.

    The text goes to a name of its own first; the rename takes the place only if
    it is free, so of two writers one gets it.
    """
    fs, where = _fs(spark, path)
    aside = where.suffix(f".{uuid.uuid4().hex}.tmp")
    stream = fs.create(aside, False)
    stream.write(json.dumps(value, sort_keys=True, ensure_ascii=False).encode())
    stream.close()
    try:
        return not fs.exists(where) and _renamed(fs, spark, aside, where)
    finally:
        fs.delete(aside, False)


def _renamed(fs, spark: SparkSession, source, target) -> bool:
    """Rename without replacing; false if the target came to be meanwhile."""
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(source, target, none)
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            return False
        raise
    return True


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], record: dict) -> None:
    """Write tables and a JSON record beside the place, then move them there.

    A reader sees all of it or none; a run that fails leaves nothing behind,
    and an existing record is never replaced.
    """
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    staged = f"{path}.{uuid.uuid4().hex}.tmp"
    _, temporary = _fs(spark, staged)
    try:
        for name, df in tables.items():
            df.write.parquet(f"{staged}/{name}.parquet")
        spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.text(f"{staged}/record.json")
        if not fs.rename(temporary, target):
            raise OSError(f"{path} could not be published")
    finally:
        if fs.exists(temporary):
            fs.delete(temporary, True)


def append_months(df: DataFrame, path: str, month: str = "ym") -> None:
    """Append rows by month, one writer a month and task group."""
    df.repartition(month, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("append").partitionBy(month).parquet(path)


def stage_months(df: DataFrame, path: str, run: str, month: str = "ym") -> None:
    """First phase: a run's rows by month beside the store; readers see nothing."""
    df.repartition(month).write.mode("overwrite").partitionBy(month).parquet(f"{path}/_staged/{run}")


def commit_months(spark: SparkSession, path: str, run: str) -> int:
    """Second phase: note the run as committed, then move its files into their
    months; how many moved. Doing it again after a loss moves what is left."""
    fs, staged = _fs(spark, f"{path}/_staged/{run}")
    _, mark = _fs(spark, f"{path}/_committed/{run}")
    if not fs.exists(mark):
        fs.create(mark, False).close()
    moved = 0
    if fs.exists(staged):
        for month in fs.listStatus(staged):
            if not month.isDirectory():
                continue
            _, into = _fs(spark, f"{path}/{month.getPath().getName()}")
            fs.mkdirs(into)
            for file in fs.listStatus(month.getPath()):
                _, target = _fs(spark, f"{into}/{run}-{file.getPath().getName()}")
                moved += bool(fs.rename(file.getPath(), target))
        fs.delete(staged, True)
    return moved


def recover_months(spark: SparkSession, path: str) -> tuple[int, int]:
    """(finished, discarded) runs: staged rows move if their run was committed, else go."""
    fs, top = _fs(spark, f"{path}/_staged")
    finished = discarded = 0
    for run in [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []:
        if fs.exists(_fs(spark, f"{path}/_committed/{run}")[1]):
            commit_months(spark, path, run)
            finished += 1
        else:
            fs.delete(_fs(spark, f"{path}/_staged/{run}")[1], True)
            discarded += 1
    return finished, discarded


def files_state(spark: SparkSession, *paths: str) -> str:
    """What identifies the present files under ``paths``: names, sizes and times of change.

    Only the listing is read, and it is summed up in executors. Hidden files, and the
    order of listing, do not count.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    mark = F.xxhash64("path", "length", "modificationTime")
    found = files.agg(F.count("*"), F.sum("length"), F.bit_xor(mark), F.sum(mark.cast("decimal(20)"))).first()
    return ",".join(map(str, found))


def prepared(spark: SparkSession, path: str, fingerprint: dict, build, sources: tuple[str, ...] = (), key: str | None = None, order: tuple[str, ...] = (), buckets: int | None = None) -> tuple[DataFrame, bool]:
    """(table, whether it was there): a result kept under a hash of what it depends on.

    ``sources`` are paths whose files count too: a file that is added, taken away or
    written again makes a new table. With a ``key`` the table is bucketed by it and
    sorted by it and ``order``, so that windows and groups of the key read it
    without an exchange; all rows of a key lie in one bucket.
    """
    depends = fingerprint | {"files": files_state(spark, *sources)} if sources else fingerprint
    layout = {"key": key, "order": list(order), "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))} if key else {}
    name = hashlib.sha256(json.dumps([depends, layout] if key else depends, sort_keys=True).encode()).hexdigest()[:16]
    where = f"{path}/{name}.parquet"
    fs, target = _fs(spark, f"{where}/_SUCCESS")
    there = fs.exists(target)
    if not key:
        if not there:
            build().write.mode("overwrite").parquet(where)
        return spark.read.parquet(where), there
    # Buckets are known to the catalogue only, which may be a new one; the files say the rest.
    table = f"prepared_{hashlib.sha256(where.encode()).hexdigest()[:16]}"
    if not there:
        n = layout["buckets"]
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete_path(spark, where)  # what a build that was cut off has left
        build().repartition(n, key).write.mode("overwrite").option("path", where).bucketBy(n, key).sortBy(key, *order).saveAsTable(table)
    elif not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(where).schema)
        sort = ", ".join(f"`{x}`" for x in (key, *order))
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY ({sort}) INTO {layout['buckets']} BUCKETS LOCATION '{where}'")
    return spark.table(table), there


def append_raw(rows: DataFrame, path: str) -> None:
    """Raw bodies as compressed JSON lines; earlier ones stay."""
    rows.write.mode("append").option("compression", "gzip").json(path)


class Presets:
    """Named settings as JSON files, one a revision, changed only from the
    revision last read: of two writers of one revision the second is refused."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _folder(self, name: str) -> str:
        return f"{self.path}/{hashlib.sha256(name.casefold().encode()).hexdigest()[:16]}"

    def read(self, name: str) -> dict | None:
        fs, where = _fs(self.spark, self._folder(name))
        names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
        newest = max((x for x in names if x.endswith(".json")), default=None)
        return None if newest is None else read_json(self.spark, f"{self._folder(name)}/{newest}")

    def write(self, name: str, settings: dict, revision: int = 0) -> int:
        """Store settings; ``revision`` is the one they were read with, 0 for new."""
        name = unicodedata.normalize("NFC", name).strip()
        if not 1 <= len(name) <= 64 or any(unicodedata.category(x) == "Cc" for x in name):
            raise ValueError("a name has 1 to 64 characters and no control characters")
        old = self.read(name)
        value = {"name": name, "settings": settings, "revision": revision + 1}
        if (old["revision"] if old else 0) != revision or not write_json_once(self.spark, f"{self._folder(name)}/{revision + 1:08d}.json", value):
            raise ValueError("changed elsewhere; read it again")
        return revision + 1


def merged(base: dict, override: dict) -> dict:
    """Settings with some of them replaced, at any depth; neither input changes."""
    out = dict(base)
    for k, v in override.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append only rows whose keys the store lacks; how many these are."""
    spark = df.sparkSession
    fs, where = _fs(spark, path)
    if fs.exists(where):
        df = df.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    df = df.dropDuplicates(keys).persist()
    n = df.count()
    if n:
        df.write.mode("append").parquet(path)
    df.unpersist()
    return n
