"""Scans: datasets, answer files, sample logs and images. Schemas are given, never inferred."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepfold.operators.curation import padded_id
from stepfold.sources import split_scan

SAMPLE = "qid string, seq_len int, qtype string, atype string, question string, answer string, sequence array<struct<step_id:int,rooms:map<string,array<string>>>>, metadata array<struct<step_id:int,rooms:map<string,boolean>>>, n_relevant_rooms_per_step array<int>, n_relevant_rooms int"
LOG = "resps array<array<string>>, filtered_resps array<string>, target string, exact_match double, doc struct<inputs:struct<question:string>,meta:struct<id:int,atype:string,seq_len:int,categories:struct<task_type:string,seq_len:int,atype:string>>>"
ANSWERS = "qid string, seq_len string, qtype string, atype string, question string, answer string, Predicted_Answer string"
LEGACY_NAMES = {"Answer": "answer", "N_steps": "seq_len", "Type": "qtype"}


def samples(spark: SparkSession, path: str, file: str | None = None) -> DataFrame:
    """A JSON array of samples, or many under len_*/questions.json, each read by many tasks; missing totals are counted again from metadata. `file` names a column for the path of each sample's file."""
    found = split_scan.json_objects(spark, path, SAMPLE)
    df = found.select("x.*", *([F.col("file").alias(file)] if file else []))
    per_step = F.transform("metadata", lambda m: F.size(F.filter(F.map_values(m["rooms"]), lambda x: x)))
    steps = F.coalesce("n_relevant_rooms_per_step", per_step)
    return df.withColumn("n_relevant_rooms_per_step", steps).withColumn("n_relevant_rooms", F.coalesce("n_relevant_rooms", F.aggregate(steps, F.lit(0), lambda a, x: a + x)))


def answer_files(spark: SparkSession, path: str, columns: str = ANSWERS) -> DataFrame:
    """Answer CSVs, each read by many tasks, with the model from the file name (answers_ORG_NAME.csv) and old column names made new.

    A record that doesn't fit the header stays, as a row whose column malformed holds it; count them, or see well_formed.
    """
    kinds: dict[tuple[str, ...], list[str]] = {}
    files = listed(spark, path)
    for file, header in (split_scan.csv_headers(spark, files) if files else {}).items():
        kinds.setdefault(header, []).append(file)
    parts = []
    for header, files in kinds.items():
        part = split_scan.csv_records(split_scan.values(spark, files, "csv").where("not first"), header)
        name = F.regexp_extract(F.substring_index("file", "/", -1), r"answers_(.*)\.csv$", 1)
        parts.append(part.withColumn("model", F.regexp_replace(name, "^([^_]*)_", "$1/")).drop("file").withColumnsRenamed(LEGACY_NAMES))
    if not parts:
        return spark.createDataFrame([], columns + ", malformed string, model string")
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def well_formed(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows that fit their header, and how many do not."""
    # Spark refuses a query of the malformed column alone, so another one of the file is counted with it
    bad = df.agg(F.count("malformed"), F.count(F.coalesce(*(c for c in df.columns if c not in ("malformed", "model"))))).first()[0]
    return df.where("malformed is null").drop("malformed"), bad


def usable(df: DataFrame, column: str = "Predicted_Answer") -> DataFrame:
    """Rows whose prediction is there and isn't an error."""
    return df.where(~F.coalesce(F.lower(column).contains("error"), F.lit(True)))


def sample_logs(spark: SparkSession, path: str, prefix: str = r"[a-z]+_\w+?") -> DataFrame:
    """JSON-lines logs under any depth, with config from samples_<config>_<date>."""
    df = spark.read.schema(LOG).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(path)
    return df.select("*", F.regexp_extract(F.col("_metadata.file_name"), rf"samples_({prefix})_\d{{4}}", 1).alias("config"))


def listed(spark: SparkSession, path: str) -> list[str]:
    """The files that a glob names, or those of a folder, in order of their names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = list(fs.globStatus(at) or [])
    if len(found) == 1 and found[0].isDirectory():
        found = list(fs.listStatus(found[0].getPath()))
    names = (x.getPath().toString() for x in found)
    return sorted((f for f in names if f.rsplit("/", 1)[-1][0] not in "_."), key=lambda f: f.rsplit("/", 1)[-1])


def latest(spark: SparkSession, path: str) -> DataFrame:
    """task, old_em of the newest results file by name; the others aren't read. No rows without a file."""
    files = listed(spark, path)
    if not files:
        return spark.createDataFrame([], "task string, old_em double")
    newest = spark.read.schema("results map<string,map<string,string>>").option("multiLine", True).json(files[-1])
    return newest.select(F.explode("results").alias("task", "m")).select("task", F.col("m")["exact_match,scoring"].cast("double").alias("old_em"))


def completed(spark: SparkSession, path: str) -> DataFrame:
    """qid of the rows of output CSVs that are done: a prediction is there and isn't an error. No rows where no file is there yet."""
    if not listed(spark, path):
        return spark.createDataFrame([], "qid string")
    return usable(answer_files(spark, path)).select(padded_id(F.col("qid")).alias("qid")).distinct()


def in_context(spark: SparkSession, path: str | None) -> DataFrame:
    """Few-shot examples, none (with a warning) where the file isn't there."""
    if path and listed(spark, path):
        return samples(spark, path)
    if path:
        warnings.warn(f"no in-context examples at {path}", stacklevel=2)
    return spark.createDataFrame([], SAMPLE)


def hub_dataset(spark: SparkSession, root: str, config: str, split: str) -> DataFrame:
    """Parquet files of one config and split, under <root>/<config>/<split>*.parquet or <root>/<config>/<split>/."""
    for pattern in (f"{root}/{config}/{split}", f"{root}/{config}/{split}*.parquet", f"{root}/{config}/{split}-*"):
        if files := listed(spark, pattern):
            return spark.read.parquet(*files)
    raise FileNotFoundError(f"no split {split} of {config} under {root}")


def external_scores(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """Scores of other benchmarks: id and the columns of `names` (theirs: ours) as numbers, without rows that lack any; '.' in ids becomes '_'."""
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    (first, ident), *rest = names.items()
    scores = [F.col(f"`{a}`").try_cast("double").alias(b) for a, b in rest]
    return df.select(F.replace(F.col(f"`{first}`"), F.lit("."), F.lit("_")).alias(ident), *scores).dropna()


def steps_csv(spark: SparkSession, path: str, chars: list[str], name: str = r"([^/]+)$", key: str | None = None) -> DataFrame:
    """Wide sequence files, a row for each step, as seq, step_id, at: an array of (ch_ord, ch, room); seq is what `name` finds in a path, the file name if not told otherwise.

    Files of many sequences have a first column `key` that tells each row's; the steps of one are in one file, in their order.
    """
    columns = ([key] if key else []) + chars
    df = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).csv(path)
    seq = F.col(f"`{key}`") if key else F.regexp_extract("_metadata.file_path", name, 1)
    at = F.array(*(F.struct(F.lit(k).alias("ch_ord"), F.lit(c).alias("ch"), F.col(f"`{c}`").alias("room")) for k, c in enumerate(chars)))
    # parts of a file by where they start, as they need not be read in that order, then its rows as they come
    rows = df.select(seq.alias("seq"), at.alias("at"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    # parts of a fixed number: short rows become arrays, so those put together by size would be few and large
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "seq")
    return rows.select("seq", F.row_number().over(Window.partitionBy("seq").orderBy("_start", "_row")).alias("step_id"), "at")


def sequences_csv(spark: SparkSession, path: str, chars: list[str], name: str = r"([^/]+)$", key: str | None = None) -> DataFrame:
    """The files of steps_csv() as state rows."""
    return steps_csv(spark, path, chars, name, key).select("seq", "step_id", F.explode("at").alias("x")).select("seq", "step_id", "x.*")


def with_sequences(questions: DataFrame, sequences: DataFrame, path: str = "sequence_path") -> DataFrame:
    """Question rows with the sequence of the file that each names, of sequences_csv() or, with less to group, steps_csv(): an array of (step_id, map of character to room), null where the file isn't there."""
    if "at" in sequences.columns:
        steps = sequences.select("seq", "step_id", F.array_sort(F.transform("at", lambda x: F.struct(x["ch"].alias("ch"), x["room"].alias("room")))).alias("e"))
    else:
        steps = sequences.groupBy("seq", "step_id").agg(F.array_sort(F.collect_list(F.struct("ch", "room"))).alias("e"))
    whole = steps.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("step_id", "e"))).alias("s"))
    whole = whole.select("seq", F.transform("s", lambda x: F.struct(x["step_id"].alias("step_id"), F.map_from_entries(x["e"]).alias("at"))).alias("sequence"))
    return questions.join(whole, F.substring_index(F.col(path), "/", -1) == F.col("seq"), "left").drop("seq")


#: The start of every PNG file, and a black picture of one pixel that stands for one that can't be read.
PNG = "89504E470D0A1A0A"
DUMMY = "iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAAAAAA6fptVAAAACklEQVR4nGNgAAAAAgABSK+kcQAAAABJRU5ErkJggg=="


def image_files(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """path, content of the images under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def images(spark: SparkSession, path: str) -> DataFrame:
    """folder, frames: data URLs of the frames of each folder in order; a file that is no PNG counts as a dummy."""
    df = image_files(spark, path)
    good = F.startswith(F.hex("content"), F.lit(PNG))
    url = F.concat(F.lit("data:image/png;base64,"), F.when(good, F.base64("content")).otherwise(DUMMY))
    rows = df.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), "path", url.alias("url"))
    return rows.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("path", "url"))).alias("x")).select("folder", F.transform("x", lambda e: e["url"]).alias("frames"))


def with_images(rows: DataFrame, files: DataFrame, key: str, paths: str = "images") -> tuple[DataFrame, int]:
    """`rows` with contents, the images that each names in order, without those that aren't there; and how many aren't."""
    each = rows.select(key, F.posexplode(paths).alias("nth", "path"))
    named = files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("name"), "content")
    joined = each.withColumn("name", F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)).join(named, "name", "left")
    missing = joined.where("content is null").count()
    if missing:
        warnings.warn(f"{missing} images are missing and skipped", stacklevel=2)
    got = joined.where("content is not null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("nth", "content"))).alias("x"))
    got = got.select(key, F.transform("x", lambda e: e["content"]).alias("contents"))
    return rows.join(got, key, "left"), missing


def text_steps(line: F.Column) -> F.Column:
    """Steps of the old text form 'Step N: Room: [a, b]; ...', one a line; raises on a malformed line."""

    def step(x):
        ok = x.rlike(r"^(?:Step|Шаг) \d+: .+$")
        rooms = F.transform(F.split(F.regexp_replace(x, r"^(?:Step|Шаг) \d+: ", ""), r";\s*"), lambda r: F.struct(F.regexp_extract(r, r"^([^:]+):", 1).alias("k"), F.array_remove(F.split(F.regexp_extract(r, r"\[(.*)\]", 1), r",\s*"), "").alias("v")))
        checked = F.when(ok, F.regexp_extract(x, r"(\d+)", 1)).otherwise(F.raise_error(F.concat(F.lit("malformed step: "), x)).cast("string"))
        return F.struct(checked.cast("int").alias("step_id"), F.map_from_entries(rooms).alias("rooms"))

    return F.transform(F.split(F.trim(line), "\n"), step)
