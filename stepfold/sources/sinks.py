"""Sinks: datasets by config, request files, result tables, manifests and cards."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, *by: str) -> None:
    (df.write.partitionBy(*by) if by else df.write).mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Appends JSON lines, a file for each task; Spark's commit takes the place of a lock."""
    df.write.mode("append").json(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Appends CSV files with a header each; Spark's commit keeps a failed attempt out."""
    df.write.mode("append").option("header", True).option("escape", '"').csv(path)


class AppendLog:
    """The micro-batches of streams that are appended to a folder: which are there, each once.

    A batch is written to a folder that readers pass over. Then one file of its own name in the log says so, which
    appears at once or not at all; with it the rows count. Last its folder gets a name that plain readers see. A batch
    that is replayed after a failure is written again if the log doesn't have it, and only finished if it has. Batches
    go by an id that lies in the stream's checkpoint, so another stream may append to the same folder.
    """

    def __init__(self, spark: SparkSession, path: str, checkpoint: str):
        self.spark, self.path = spark, path.rstrip("/")
        known = f"{checkpoint.rstrip('/')}/append-id"
        if not self._fs(known).exists(self._at(known)):
            self._create(known, uuid.uuid4().hex)
        self.id = _small_text(spark, known)

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._at(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _create(self, path: str, text: str) -> None:
        """A small file that is there as a whole or not at all."""
        folder, name = path.rsplit("/", 1)
        draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
        write_text(self.spark, draft, text)
        if not self._fs(path).rename(self._at(draft), self._at(path)):
            raise OSError(f"{path} can't be made")

    def write(self, df: DataFrame, batch: int) -> None:
        entry = f"{self.path}/_log/{batch:020d}-{self.id}"
        if not self._fs(entry).exists(self._at(entry)):
            staged = f"_staged/{batch:020d}-{uuid.uuid4().hex}"
            append_rows(df, f"{self.path}/{staged}")
            self._commit(entry, staged)
        self._finish(entry, batch)

    def _commit(self, entry: str, staged: str) -> None:
        self._fs(entry).mkdirs(self._at(f"{self.path}/_log"))
        self._create(entry, staged)

    def _finish(self, entry: str, batch: int) -> None:
        staged = f"{self.path}/{_small_text(self.spark, entry)}"
        if self._fs(staged).exists(self._at(staged)):
            self._fs(staged).rename(self._at(staged), self._at(f"{self.path}/batch={batch:020d}-{self.id}"))


def _small_text(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    file = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(file)).decode()
    finally:
        file.close()


def append_stream(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Rows of a stream appended as they finish, each micro-batch once, also if it is replayed after a failure; see appended(). Gives the query."""
    log = AppendLog(stream.sparkSession, path, checkpoint)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(log.write)
    return (writer.trigger(**trigger) if trigger else writer).start()


def appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all micro-batches that the log of append_stream() has."""
    path = path.rstrip("/")
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    log = at(f"{path}/_log")
    folders = []
    for entry in fs.listStatus(log) if fs.exists(log) else []:  # a small file for each micro-batch
        if not (name := entry.getPath().getName()).startswith("."):
            staged = f"{path}/{_small_text(spark, entry.getPath().toString())}"
            folders.append(staged if fs.exists(at(staged)) else f"{path}/batch={name}")
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("recursiveFileLookup", True).csv(folders)


def dataset(df: DataFrame, path: str, *by: str) -> None:
    """Parquet, in a folder for each value of `by`."""
    (df.write.partitionBy(*by) if by else df.write).mode("overwrite").parquet(path)


def results(rates: DataFrame, folder: str, experiment: str) -> str:
    """One CSV of hit rates, <folder>/<experiment>_newest_results; a row for each cell of a leaderboard, so one file will do."""
    path = f"{folder}/{experiment}_newest_results"
    order = ["model", "seq_len", "qtype"]
    rates.select("seq_len", "qtype", "model", "hit").coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file of that name, by Hadoop's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


#: Elements that are made pretty at once: a batch of Spark's has thousands, each of maybe many kilobytes.
AT_ONCE = 100


def _pretty(batch: pa.RecordBatch, space: str) -> Iterator[pa.RecordBatch]:
    """The last column's JSON made pretty, few rows at a time."""
    for at in range(0, batch.num_rows, AT_ONCE):
        few = batch.slice(at, AT_ONCE)
        texts = [space + json.dumps(json.loads(x), ensure_ascii=False, indent=2).replace("\n", "\n" + space) for x in few.column(few.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*few.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "value"])


def _elements(df: DataFrame, indent: int, *leave: str) -> DataFrame:
    """The rows in their order as pretty JSON, `indent` spaces further in, as a column value beside the columns left out."""
    kinds = df.select(*leave).schema
    value = F.to_json(F.struct(*(c for c in df.columns if c not in leave)), {"ignoreNullFields": "false"}).alias("value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _pretty(batch, " " * indent)

    return df.select(*leave, value).mapInArrow(run, kinds.add("value", "string"))


#: What parts the elements of an array, in the parts that tasks write.
_COMMA = ",\n"


def _array_file(spark: SparkSession, parts: str, path: str, head: str, tail: str, empty: str) -> None:
    """One file of a head, the elements that a folder's files hold in order, and a tail. Bytes are copied from stream to stream, so that memory doesn't grow with them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at, folder = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(parts)
    fs = folder.getFileSystem(conf)
    files = sorted((x for x in fs.listStatus(folder) if x.isFile() and x.getLen()), key=lambda x: x.getPath().getName()) if fs.exists(folder) else []
    files = [x for x in files if x.getPath().getName().startswith("part-")]
    if not files:
        return write_text(spark, path, empty)
    out = at.getFileSystem(conf).create(at, True)
    try:
        out.write(bytearray(head.encode()))
        for x in files:
            part = fs.open(x.getPath())
            try:
                jvm.org.apache.commons.io.IOUtils.copyLarge(part, out, 0, x.getLen() - (len(_COMMA) if x is files[-1] else 0))
            finally:
                part.close()
        out.write(bytearray(tail.encode()))
    finally:
        out.close()


def _scratch(spark: SparkSession, path: str) -> tuple[str, Callable[[], None]]:
    """A folder beside a path, and what removes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.parts-{uuid.uuid4().hex}")
    return at.toString(), lambda: at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def kept(df: DataFrame, path: str) -> Iterator[DataFrame]:
    """The rows as a table beside a path, made once for several uses, which goes with them."""
    folder, remove = _scratch(df.sparkSession, path)
    try:
        df.write.parquet(folder)
        yield df.sparkSession.read.schema(df.schema).parquet(folder)
    finally:
        remove()


def json_array(df: DataFrame, path: str, order: str) -> int:
    """One pretty JSON array in a single file, for programs that read nothing else. Tasks write its parts in order beside it; the driver only joins their bytes. Gives the number of rows."""
    spark, seen = df.sparkSession, Observation()
    parts, remove = _scratch(spark, path)
    try:
        _elements(df.orderBy(order), 2).observe(seen, F.count(F.lit(1)).alias("n")).write.option("lineSep", _COMMA).text(parts)
        _array_file(spark, parts, path, "[\n", "\n]", "[]")
        return seen.get["n"]
    finally:
        remove()


def config_files(records: DataFrame, shots: DataFrame, folder: str) -> list[str]:
    """test.json ({"access": "public", "data": [...]}) and shots.json ({"data": [...]}) of each config; records and shots have a column config. Tasks write the parts of each file in order, the driver joins their bytes. Gives the configs."""
    spark = records.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    made = {}
    try:
        for name, df in (("test", records), ("shots", shots)):
            made[name] = _scratch(spark, f"{folder}/{name}")
            _elements(df.orderBy("config", "meta.id"), 4, "config").write.partitionBy("config").option("lineSep", _COMMA).text(made[name][0])
        at = spark._jvm.org.apache.hadoop.fs.Path(made["test"][0])
        found = [x.getPath().getName() for x in at.getFileSystem(conf).listStatus(at) if x.isDirectory()]
        configs = sorted(found)  # a folder for each config
        for part in configs:
            config = unquote(part.removeprefix("config="))
            for name, head in (("test", '{\n  "access": "public",\n  "data": '), ("shots", '{\n  "data": ')):
                _array_file(spark, f"{made[name][0]}/{part}", f"{folder}/{config}/{name}.json", head + "[\n", "\n  ]\n}", head + "[]\n}")
        return [unquote(x.removeprefix("config=")) for x in configs]
    finally:
        for _, remove in made.values():
            remove()


def summary(df: DataFrame) -> DataFrame:
    """One row: the configs and how many rows there are."""
    return df.agg(F.array_sort(F.collect_set("config")).alias("configs"), F.count("*").alias("n"))


def dataset_info(df: DataFrame, path: str, name: str, language: str, mode: str, version: str = "1.0.0") -> dict:
    """The summary of a set of configs, written as dataset_info.json."""
    row = summary(df).first()
    info = {"name": name, "version": version, "language": language, "mode": mode, "tasks": row.configs, "total_samples": row.n}
    write_text(df.sparkSession, f"{path}/dataset_info.json", json.dumps(info, indent=2))
    return info


def manifest(stats: DataFrame, path: str, **said) -> dict:
    """eval_manifest.json: what was said of a run and its one row of statistics."""
    row = stats.first()
    out = {**said, "sample_stats": row.asDict() if row else None}
    write_text(stats.sparkSession, f"{path}/eval_manifest.json", json.dumps(out, ensure_ascii=False, indent=2))
    return out


def dataset_card(configs: list[str], splits: tuple[str, ...] = ("test", "shots")) -> str:
    """The YAML head of a dataset card: where the files of each split of each config are."""
    lines = ["---", "configs:"]
    for config in configs:
        lines += [f"- config_name: {config}", "  data_files:"]
        for split in splits:
            lines += [f"  - split: {split}", f"    path: config={config}/split={split}/*.parquet"]
    return "\n".join([*lines, "---", ""])


def requests(df: DataFrame, path: str, model: str, url: str = "/v1/chat/completions") -> None:
    """Batch request lines of df (custom_id, messages)."""
    body = F.struct(F.lit(model).alias("model"), F.col("messages"))
    df.select(F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), F.lit(url).alias("url"), body.alias("body"))).alias("value")).write.mode("overwrite").text(path)


def records(df: DataFrame, prefix: str, instruction: str) -> DataFrame:
    """Records (instruction, inputs, outputs, meta) and config <prefix>_<task>_<seq_len> of df (qid, task, qtype, seq_len, atype, context, question, answer)."""
    meta = F.struct(F.col("qid").cast("int").alias("id"), F.struct(F.col("task").alias("task_type"), "seq_len", "atype").alias("categories"))
    name = F.concat_ws("_", F.lit(prefix), F.replace(F.lower("task"), F.lit("-"), F.lit("_")), F.col("seq_len").cast("string"))
    return df.select(name.alias("config"), F.lit(instruction).alias("instruction"), F.struct("context", "question").alias("inputs"), F.col("answer").cast("string").alias("outputs"), meta.alias("meta"))


def prompt(record: DataFrame) -> DataFrame:
    text = F.replace(F.replace(F.col("instruction"), F.lit("{context}"), F.col("inputs.context")), F.lit("{question}"), F.col("inputs.question"))
    return record.withColumn("prompt", F.trim(text))
