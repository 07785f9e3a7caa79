"""Command lines: python -m stepfold <command> ... Each reads and writes files; see --help of a command."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfold.functions import answers, wording
from stepfold.model import CHARS, DEFAULT_N_QUESTIONS, DEFAULT_SEED, DEFAULT_SEQ_LENGTHS, LEADERBOARD_LENGTHS, LEADERBOARD_TASKS, TASKS, GenerationConfig
from stepfold.operators import curation, leaderboard
from stepfold.plans import generate, records
from stepfold.sources import sinks, tables


def _session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _config(a: argparse.Namespace) -> GenerationConfig:
    return GenerationConfig(seed=a.seed, seq_lengths=a.seq_lengths, n_questions=a.n_questions, question_types=a.question_types)


def run_generate(a: argparse.Namespace, spark: SparkSession) -> int:
    if a.list_question_types:
        print("\n".join(TASKS))
        return 0
    sinks.json_array(generate.samples(spark, _config(a)), a.output_path, "qid")
    for r in generate.count_by_length(tables.samples(spark, a.output_path)).orderBy("seq_len").collect():
        print(f"length {r.seq_len}: {r.n}")
    return 0


def run_benchmark(a: argparse.Namespace, spark: SparkSession) -> int:
    """Records of a leaderboard set, config by config, with shots and a summary."""
    config = _config(a)
    made = generate.samples(spark, config, language=a.language)
    recs = records.benchmark_records(made, a.language, a.mode, a.prefix)
    few = _no_shots(recs)
    if a.n_few_shot:
        examples = generate.in_context_examples(spark, config, a.n_few_shot, tuple(n for n in (8, 16) if n <= a.few_shot_max_len) or (8,))
        few = records.attached_shots(_configs(config, a.prefix, spark), records.shot_records(curation.indexed(examples, ["example_id"])), a.n_few_shot, whole_pool=False, prefix=a.prefix)
    with sinks.kept(recs, f"{a.output_dir}/records") as recs:
        sinks.config_files(recs, few, a.output_dir)
        print(json.dumps(sinks.dataset_info(recs, a.output_dir, a.prefix, a.language, a.mode), ensure_ascii=False))
    return 0


def _configs(config: GenerationConfig, prefix: str, spark: SparkSession) -> DataFrame:
    names = sorted(records.config_name(prefix, TASKS[q], n) for q in config.get_question_types() for n in config.seq_lengths)
    return spark.createDataFrame([(x,) for x in names], "config string")


def run_publish(a: argparse.Namespace, spark: SparkSession) -> int:
    """A generated set in its published shape: Parquet by config and split, with the head of a dataset card."""
    config = _config(a)
    recs = records.benchmark_records(generate.samples(spark, config, language=a.language), a.language, prefix=a.prefix)
    test = records.normalized_records(records.numbered(recs, "meta.id"))
    examples = generate.in_context_examples(spark, config, a.n_shots, (8, 16))
    shots = records.attached_shots(_configs(config, a.prefix, spark), records.shot_records(curation.indexed(examples, ["example_id"])), a.n_shots, prefix=a.prefix)
    both = test.withColumn("split", F.lit("test")).unionByName(shots.withColumn("split", F.lit("shots")))
    sinks.dataset(both, a.output_dir, "config", "split")
    configs = [r.config for r in _configs(config, a.prefix, spark).collect()]
    sinks.write_text(spark, f"{a.output_dir}/README.md", sinks.dataset_card(configs, ("shots", "test")))
    return 0


def _no_shots(recs: DataFrame) -> DataFrame:
    return recs.where(F.lit(False))


def run_render(a: argparse.Namespace, spark: SparkSession) -> int:
    """Drawings of the steps of samples, as SVG texts by sample and step."""
    rows = records.chosen(tables.samples(spark, a.input_path), a.qids, a.limit)
    steps = rows.select("qid", F.explode("sequence").alias("s")).select("qid", "s.step_id", F.explode(records.rooms_of_chars(F.col("s.rooms"))).alias("ch", "room"))
    state = steps.select(F.col("qid").alias("seq_id"), "step_id", (F.array_position(F.array(*map(F.lit, CHARS)), F.col("ch")) - 1).cast("int").alias("ch_ord"), "ch", "room")
    sinks.jsonl(records.svg_frames(records.frame_layout(state)), a.output_dir)
    return 0


def run_requests(a: argparse.Namespace, spark: SparkSession) -> int:
    """Batch request lines of the samples that aren't done yet."""
    rows = tables.samples(spark, a.data_path)
    if a.done:
        rows = curation.remaining(rows.withColumn("qid", curation.padded_id(F.col("qid"))), tables.completed(spark, a.done), "qid")
    frames = F.transform("sequence", records.step_line)
    text = records.joined_text(frames, F.col("question"), a.prefix_question)
    if a.in_context and a.n_examples:
        pool = tables.in_context(spark, a.in_context).select(F.col("qid").alias("example_id"), "qtype", "seq_len", "question", "answer", F.transform("sequence", records.step_line).alias("frames"))
        own = curation.few_shots(rows.select("qid", "qtype", "seq_len"), pool, a.n_examples)
        each = own.select("qid", F.posexplode(F.split("shots", ",")).alias("nth", "example_id")).join(pool.drop("qtype"), "example_id")
        shots = each.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("nth", "seq_len", "question", "frames", "answer"))).alias("examples"))
        rows = rows.join(shots, "qid", "left")
        text = F.concat_ws("\n\n", F.nullif(records.in_context_prompt(F.col("examples"), a.header), F.lit("")), text)
    messages = F.array(F.struct(F.lit("user").alias("role"), text.alias("content")))
    sinks.requests(rows.select(F.col("qid").alias("custom_id"), messages.alias("messages")), a.output, a.model)
    return 0


def run_score(a: argparse.Namespace, spark: SparkSession) -> int:
    """Hit rates of the answer files of an experiment."""
    rows, bad = tables.well_formed(tables.answer_files(spark, f"{a.input_dir}/{a.exp_name}/qa_pairs_answers_*.csv"))
    if bad:
        print(f"{bad} malformed lines are left out", file=sys.stderr)
    rates = leaderboard.hit_rates(answers.legacy_scored(rows))
    print(sinks.results(rates, a.output_dir, a.exp_name))
    return 0


def run_leaderboard(a: argparse.Namespace, spark: SparkSession) -> int:
    """Heatmap tables of a results file."""
    rates, missing = leaderboard.only_models(_rates(spark, a.results), a.models or [])
    if missing:
        print(f"not found: {', '.join(missing)}", file=sys.stderr)
    for name, table in {"lengths": leaderboard.pivoted(rates, "seq_len", "qtype"), "models": leaderboard.pivoted(rates, "model", "qtype"), "harmonic": leaderboard.pivoted(rates, "model", "qtype", leaderboard.harmonic)}.items():
        sinks.append_rows(table.coalesce(1), f"{a.output_dir}/{name}")
    return 0


def _rates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("seq_len int, qtype string, model string, hit double").csv(path)


def run_correlate(a: argparse.Namespace, spark: SparkSession) -> int:
    """Correlations of mean hits with other benchmarks, by length."""
    names = dict(x.split("=", 1) for x in a.columns)
    scores = tables.external_scores(spark, a.scores, names)
    hits = leaderboard.mean_hits(_rates(spark, a.results))
    ident, *others = names.values()
    models = hits.select(F.replace("model", F.lit("."), F.lit("_")).alias("model")).distinct()
    matched = leaderboard.fuzzy_matched(models, scores.withColumnRenamed(ident, "id"))
    both = hits.withColumn("model", F.replace("model", F.lit("."), F.lit("_"))).join(matched, "model")
    long = both.select("seq_len", F.col("hit").alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("benchmark"), F.col(c).alias("x")) for c in others))).alias("s")).select("seq_len", "y", "s.*")
    sinks.append_rows(leaderboard.correlated(long, "seq_len", "benchmark").coalesce(1), a.output)
    return 0


def _logs(spark: SparkSession, path: str) -> DataFrame:
    logs = answers.batch_answers(tables.sample_logs(spark, path))
    task = F.regexp_extract("config", r"^(.*)_(\d+)$", 1)
    gold = answers.normalized(F.col("target"), F.col("atype"))
    return logs.withColumn("task", task).withColumn("seq_len", F.regexp_extract("config", r"_(\d+)$", 1).try_cast("int")).withColumn("em", answers.exact(F.col("pred"), gold))


def run_report(a: argparse.Namespace, spark: SparkSession) -> int:
    """The table of a run by task and length, its total and its weighted score."""
    cells = leaderboard.token_table(_logs(spark, a.run_dir)).withColumn("model", F.lit(a.model))
    cells.orderBy("task", "seq_len").show(1000, False)
    leaderboard.model_summary(cells).show(truncate=False)
    return 0


def run_rescore(a: argparse.Namespace, spark: SparkSession) -> int:
    """New scores of a run by task against those of its newest results file."""
    new = _logs(spark, a.run_dir).withColumn("task", F.col("config")).withColumn("model", F.lit(a.model)).groupBy("model", "task").agg(F.avg("em").alias("em"))
    old = tables.latest(spark, f"{a.run_dir}/results_*.json").withColumn("model", F.lit(a.model))
    leaderboard.rescored(new, old).orderBy("task").show(1000, False)
    return 0


def run_validate(a: argparse.Namespace, spark: SparkSession) -> int:
    """Statistics and gates of a run; 1 if it fails."""
    logs = _logs(spark, a.run_dir).withColumn("model", F.lit(a.model))
    stats = leaderboard.run_stats(logs)
    if stats.isEmpty():
        print("FAIL: no samples")
        return 1
    sinks.manifest(stats, a.run_dir, model=a.model, expect_thinking=a.expect_thinking)
    row = leaderboard.gated(stats, a.expect_thinking == "yes").first()
    failures = [x for x in row.failures.split(",") if x and not (a.expect_thinking == "any" and "thinking" in x)]
    print(json.dumps(stats.first().asDict(), ensure_ascii=False, indent=2))
    if row.warning:
        print("WARN: truncated")
    for x in failures:
        print("FAIL:", x)
    return int(bool(failures) or a.strict and bool(row.warning))


def run_patch(a: argparse.Namespace, spark: SparkSession) -> int:
    """A published set with its prompts and wordings put right, written as a new one."""
    rows = tables.hub_dataset(spark, a.root, a.config, a.split).withColumn("config", F.lit(a.config))
    out = records.patched(records.numbered(rows, "meta.id")).drop("idx", "config")
    sinks.dataset(out, f"{a.output}/{a.config}/{a.split}")
    return 0


def run_convert(a: argparse.Namespace, spark: SparkSession) -> int:
    """A set whose contexts are in the old text form, with JSON lines instead; fails if any doesn't hold the same steps."""
    rows = tables.hub_dataset(spark, a.root, a.config, a.split)
    text = F.col("inputs.context")
    out = rows.withColumn("jsonl", records.jsonl_of(tables.text_steps(text)))
    if bad := out.where(~records.round_trips(text, F.col("jsonl"), tables.text_steps)).count():
        print(f"{bad} contexts differ", file=sys.stderr)
        return 1
    sinks.dataset(out.withColumn("inputs", F.struct(F.col("jsonl").alias("context"), F.col("inputs.question").alias("question"))).drop("jsonl"), f"{a.output}/{a.config}/{a.split}")
    return 0


def run_serialise(a: argparse.Namespace, spark: SparkSession) -> int:
    """Sequence CSVs as steps, joined to the questions that name them."""
    questions = spark.read.option("multiLine", True).json(a.questions)
    sinks.jsonl(tables.with_sequences(questions, tables.steps_csv(spark, a.sequences, a.chars), a.path_column), a.output)
    return 0


def run_translate(a: argparse.Namespace, spark: SparkSession) -> int:
    rows = tables.samples(spark, a.input_path)
    said = rows.withColumn("question", wording.translate_question(F.col("question"))).withColumn("answer", records.localized_nobody(F.col("answer"), "ru"))
    sinks.json_array(said, a.output_path, "qid")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stepfold", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *required: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=run.__doc__)
        p.set_defaults(run=run)
        for x in required:
            p.add_argument(f"--{x.replace('_', '-')}", required=True)
        return p

    def generation(p: argparse.ArgumentParser, lengths: list[int], types: list[str] | None) -> None:
        p.add_argument("--seq-lengths", type=int, nargs="+", default=lengths)
        p.add_argument("--n-questions", type=int, default=DEFAULT_N_QUESTIONS)
        p.add_argument("--question-types", nargs="+", default=types)
        p.add_argument("--seed", type=int, default=DEFAULT_SEED)

    p = command("generate", run_generate)
    p.add_argument("--output-path", default="questions.json")
    p.add_argument("--list-question-types", action="store_true")
    generation(p, DEFAULT_SEQ_LENGTHS, None)
    p = command("benchmark", run_benchmark, "output_dir")
    generation(p, LEADERBOARD_LENGTHS, LEADERBOARD_TASKS)
    p.add_argument("--mode", choices=["text", "image"], default="text")
    p.add_argument("--language", choices=["en", "ru"], default="en")
    p.add_argument("--prefix", default="rooms")
    p.add_argument("--n-few-shot", type=int, default=0)
    p.add_argument("--few-shot-max-len", type=int, default=16)
    p = command("publish", run_publish, "output_dir")
    generation(p, LEADERBOARD_LENGTHS, LEADERBOARD_TASKS)
    p.add_argument("--language", choices=["en", "ru"], default="ru")
    p.add_argument("--prefix", default="rooms")
    p.add_argument("--n-shots", type=int, default=5)
    p = command("render", run_render, "input_path", "output_dir")
    p.add_argument("--qids", nargs="+")
    p.add_argument("--limit", type=int)
    p = command("requests", run_requests, "data_path", "output", "model")
    p.add_argument("--done")
    p.add_argument("--prefix-question", action="store_true")
    p.add_argument("--in-context")
    p.add_argument("--n-examples", type=int, default=0)
    p.add_argument("--header", default="Examples:")
    p = command("score", run_score)
    p.add_argument("--exp-name", default="main")
    p.add_argument("--input-dir", default="data")
    p.add_argument("--output-dir", default="results")
    p = command("leaderboard", run_leaderboard, "results", "output_dir")
    p.add_argument("--models", nargs="+")
    command("correlate", run_correlate, "results", "scores", "output").add_argument("--columns", nargs="+", required=True, help="theirs=ours; the first names the model")
    for name, run in (("report", run_report), ("rescore", run_rescore)):
        command(name, run, "run_dir", "model")
    p = command("validate", run_validate, "run_dir", "model")
    p.add_argument("--expect-thinking", choices=["yes", "no", "any"], default="any")
    p.add_argument("--strict", action="store_true")
    for name, run in (("patch", run_patch), ("convert", run_convert)):
        command(name, run, "root", "config", "output").add_argument("--split", default="test")
    p = command("serialise", run_serialise, "questions", "sequences", "output")
    p.add_argument("--chars", nargs="+", default=CHARS)
    p.add_argument("--path-column", default="sequence_path")
    command("translate", run_translate, "input_path", "output_path")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(a, spark or _session())


if __name__ == "__main__":
    sys.exit(main())
