"""Benchmark records: prompts, configs, nested metadata, text forms, patches and frame layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfold.model import CHARS, LEADERBOARD_LENGTHS, LEADERBOARD_TASKS, NOBODY, ROOMS, RU_NOBODY, TASKS
from stepfold.operators.curation import first_per

# The instructions of records, by language and kind of context, and the ten Russian prompts that published sets go through.
INSTRUCTIONS = {
    ("en", "text"): """Task:
Analyze the character movements and room positions across the steps.

Context:
The JSON step sequence shows which characters are located in which rooms.
{context}

Answer format:
Answer with one word or one number using the format: Answer: X

Question:
{question}

Answer:""",
    ("en", "image"): """Task:
Analyze the character movements and room positions across the steps.

Context:
The image sequence shows character positions in rooms at each step.
{context}

Answer format:
Answer with one word or one number using the format: Answer: X

Question:
{question}

Answer:""",
    ("ru", "text"): """Задача:
Проанализируй перемещения и расположение персонажей по шагам.

Контекст:
Последовательность шагов в формате JSON показывает, какие персонажи находятся в каких комнатах.
{context}

Формат ответа:
Ответь одним словом или одним числом в формате: Ответ: X

Вопрос:
{question}

Ответ:""",
    ("ru", "image"): """Задача:
Проанализируй перемещения и расположение персонажей по шагам.

Контекст:
Последовательность изображений показывает расположение персонажей в комнатах на каждом шаге.
{context}

Формат ответа:
Ответь одним словом или одним числом в формате: Ответ: X

Вопрос:
{question}

Ответ:""",
}
PROMPTS = [
    """Задача:
Проанализируй перемещения и расположение персонажей по шагам.

Контекст:
Последовательность шагов в формате JSON показывает, какие персонажи находятся в каких комнатах.
{context}

Формат ответа:
Ответь одним словом или одним числом в формате: Ответ: X

Вопрос:
{question}

Ответ:""",
    """Задача:
Определи ответ на вопрос по последовательности состояний комнат.

Контекст:
Каждая строка — JSON-объект шага: комнаты и находящиеся в них персонажи.
{context}

Формат ответа:
Укажи один ответ: имя персонажа, название комнаты или число. Последняя строка ответа должна иметь формат: Ответ: X

Вопрос:
{question}

Ответ:""",
    """Задача:
Реши задачу о том, где и сколько времени находились персонажи.

Контекст:
Данные заданы как упорядоченная последовательность JSON-записей шагов с комнатами и персонажами.
{context}

Формат ответа:
Напиши ровно один ответ после префикса Ответ:. Пример: Ответ: Кухня

Вопрос:
{question}

Ответ:""",
    """Задача:
Вычисли нужный факт о присутствии персонажей в комнатах.

Контекст:
Используй все JSON-шаги последовательности как временной ряд расположений.
{context}

Формат ответа:
Ответ должен состоять из префикса Ответ: и одного слова или числа.

Вопрос:
{question}

Ответ:""",
    """Задача:
Найди краткий ответ по истории перемещений персонажей.

Контекст:
Ниже приведены шаги в формате JSON, где для каждой комнаты указан список присутствующих персонажей.
{context}

Формат ответа:
Верни только один результат в формате: Ответ: X

Вопрос:
{question}

Ответ:""",
    """Задача:
Ответь на вопрос о перемещениях персонажей между комнатами.

Контекст:
Дана последовательность шагов в виде JSON-объектов; на каждом шаге указано, кто находится в каждой комнате.
{context}

Формат ответа:
Последняя строка должна быть в формате: Ответ: X, где X — одно имя, одна комната или одно число.

Вопрос:
{question}

Ответ:""",
    """Задача:
Определи требуемый факт по временной последовательности расположений.

Контекст:
Каждый шаг — JSON-объект, описывающий состояние всех комнат и присутствующих персонажей.
{context}

Формат ответа:
Дай краткий ответ после префикса Ответ:. Пример: Ответ: Иван

Вопрос:
{question}

Ответ:""",
    """Задача:
Проанализируй все шаги и вычисли ответ на вопрос.

Контекст:
Ниже приведены состояния комнат во времени в формате JSON; порядок шагов важен.
{context}

Формат ответа:
Используй ровно один результат в форме: Ответ: X

Вопрос:
{question}

Ответ:""",
    """Задача:
Найди персонажа, комнату или число, которые требуются в вопросе.

Контекст:
JSON-последовательность показывает распределение персонажей по комнатам на каждом шаге.
{context}

Формат ответа:
Запиши один ответ с префиксом Ответ:, например: Ответ: 12

Вопрос:
{question}

Ответ:""",
    """Задача:
Сопоставь вопрос со всеми состояниями комнат и выведи краткий результат.

Контекст:
Используй полную последовательность JSON-шагов, чтобы учесть все посещения и совпадения.
{context}

Формат ответа:
Ответ должен иметь вид: Ответ: X. X — одно слово или одно число.

Вопрос:
{question}

Ответ:""",
]
ALONE = " в одиночестве"
CROWD_OLD, CROWD_NEW = "Сколько раз возникала толпа (", "Сколько шагов существовала толпа ("
#: Ids of shots start here, so that none is that of a test record.
SHOTS_OFFSET = 10_000


def instruction(language: str = "en", mode: str = "text") -> str:
    """The prompt of a record, with {context} and {question} to be filled in; any language but 'ru' is English."""
    return INSTRUCTIONS["ru" if language == "ru" else "en", "image" if mode == "image" else "text"]


def task_tree(prefix: str = "rooms") -> list[dict]:
    """The leaves of the evaluation group: one for each leaderboard task and length."""
    return [{"name": config_name(prefix, TASKS[q], n), "task": TASKS[q], "qtype": q, "seq_len": n} for q in LEADERBOARD_TASKS for n in LEADERBOARD_LENGTHS]


def config_name(prefix: str, task: str, seq_len: int) -> str:
    return f"{prefix}_{task.lower().replace('-', '_')}_{seq_len}"


def task_of_config(config: Column, prefix: str = "rooms") -> dict[str, Column]:
    """task, seq_len and qtype (null for an unknown task) that a config name holds."""
    pattern = rf"^(?:{prefix}_)?(.*)_(\d+)$"
    task = F.replace(F.upper(F.regexp_extract(config, pattern, 1)), F.lit("_"), F.lit("-"))
    types = F.create_map(*(F.lit(x) for q, t in TASKS.items() for x in (t, q)))
    return {"task": task, "seq_len": F.regexp_extract(config, pattern, 2).try_cast("int"), "qtype": F.element_at(types, task)}


# nested metadata


def dense_metadata(cells: DataFrame, lengths: DataFrame, rooms: list[str] = ROOMS) -> DataFrame:
    """seq_id, metadata: for every step of a sequence (seq_id, seq_len) whether each room is one of `cells` (seq_id, step_id, room)."""
    steps = cells.groupBy("seq_id", "step_id").agg(F.collect_set("room").alias("here"))
    marked = steps.groupBy("seq_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("step_id").cast("int"), "here"))).alias("at"))

    def step(i: Column) -> Column:
        here = F.coalesce(F.element_at("at", i), F.array().cast("array<string>"))
        entries = F.array(*(F.struct(F.lit(r).alias("key"), F.array_contains(here, r).alias("value")) for r in rooms))
        return F.struct(i.alias("step_id"), F.map_from_entries(entries).alias("rooms"))

    both = lengths.select("seq_id", F.col("seq_len").cast("int").alias("seq_len")).join(marked, "seq_id", "left").withColumn("at", F.coalesce("at", F.create_map().cast("map<int,array<string>>")))
    return both.select("seq_id", F.transform(F.sequence(F.lit(1), F.col("seq_len")), step).alias("metadata"))


def relevant_counts(metadata: Column) -> tuple[Column, Column]:
    """How many rooms are relevant at each step, and in all."""
    steps = F.transform(metadata, lambda m: F.size(F.filter(F.map_values(m["rooms"]), lambda x: x)))
    return steps, F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def rooms_of_chars(rooms: Column) -> Column:
    """The inverse of a step's map: the room of each character."""
    pairs = F.flatten(F.transform(F.map_entries(rooms), lambda e: F.transform(e["value"], lambda c: F.struct(c.alias("key"), e["key"].alias("value")))))
    return F.map_from_entries(pairs)


SEQUENCE = "array<struct<step_id:int,rooms:map<string,array<string>>>>"
METADATA = "array<struct<step_id:int,rooms:map<string,boolean>>>"


def to_dict(df: DataFrame, name: str = "value") -> DataFrame:
    """Samples as JSON texts, null fields included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def from_dict(texts: DataFrame, schema: str, name: str = "value") -> DataFrame:
    """Samples from JSON texts; totals that are missing are counted again from the metadata."""
    df = texts.select(F.from_json(name, schema).alias("x")).select("x.*")
    steps, _ = relevant_counts(F.col("metadata"))
    df = df.withColumn("n_relevant_rooms_per_step", F.coalesce("n_relevant_rooms_per_step", steps))
    return df.withColumn("n_relevant_rooms", F.coalesce("n_relevant_rooms", F.aggregate("n_relevant_rooms_per_step", F.lit(0), lambda a, x: a + x)))


# text forms


def step_line(step: Column) -> Column:
    """A step as a JSON line with ', ' and ': ' between, as other writers have it."""
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    room = lambda e: F.concat(quoted(e["key"]), F.lit(": ["), F.array_join(F.transform(e["value"], quoted), ", "), F.lit("]"))
    return F.concat(F.lit('{"step_id": '), step["step_id"].cast("string"), F.lit(', "rooms": {'), F.array_join(F.transform(F.map_entries(step["rooms"]), room), ", "), F.lit("}}"))


def jsonl_of(steps: Column) -> Column:
    return F.array_join(F.transform(steps, step_line), "\n")


def round_trips(text: Column, jsonl: Column, parse) -> Column:
    """Whether a context in the old text form and one in JSON lines hold the same steps, numbered from 1. parse reads the text form."""
    read = F.transform(F.split(jsonl, "\n"), lambda x: F.from_json(x, "step_id int, rooms map<string,array<string>>"))
    in_order = F.forall(F.transform(read, lambda x, i: x["step_id"] == i + 1), lambda ok: F.coalesce(ok, F.lit(False)))
    return (jsonl_of(parse(text)) == jsonl) & in_order


def joined_text(frames: Column, question: Column, question_first: Column | bool = False) -> Column:
    """Frames, one a line, with the question after or before them."""
    first = F.lit(question_first) if isinstance(question_first, bool) else question_first
    text = F.array_join(frames, "\n")
    return F.when(first, F.concat_ws("\n", question, text)).otherwise(F.concat_ws("\n", text, question))


def flat_examples(samples: DataFrame) -> DataFrame:
    """text and answer of samples (frames, question, answer), as the first version of the set had them."""
    return samples.select(joined_text(F.col("frames"), F.col("question")).alias("text"), F.col("answer").cast("string").alias("answer"))


def in_context_prompt(examples: Column, header: str) -> Column:
    """The few-shot part of a prompt from an array of (seq_len, question, frames, answer); empty without any."""

    def block(x: Column, i: Column) -> Column:
        parts = [F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(" (len="), x["seq_len"].cast("string"), F.lit("):")), F.concat(F.lit("Question: "), x["question"]), F.concat(F.lit("Sequence:\n"), F.array_join(x["frames"], "\n")), F.concat(F.lit("Answer: {'answer': '"), x["answer"], F.lit("'}"))]
        return F.concat_ws("\n", *parts)

    some = F.array_join(F.concat(F.array(F.lit(header)), F.transform(examples, block)), "\n\n")
    return F.when(F.size(examples) > 0, some).otherwise("")


# records


def image_paths(qid: Column, seq_len: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), seq_len), lambda i: F.format_string("%s/step_%04d.png", qid, i))


def benchmark_records(samples: DataFrame, language: str = "en", mode: str = "text", prefix: str = "rooms") -> DataFrame:
    """config, instruction, inputs, outputs, meta of samples (qid, seq_len, qtype, atype, question, answer, sequence); an unknown type is its own task."""
    task = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in TASKS.items() for x in kv)), F.col("qtype")), F.col("qtype"))
    name = F.concat_ws("_", F.lit(prefix), F.replace(F.lower(task), F.lit("-"), F.lit("_")), F.col("seq_len").cast("string"))
    said = localized_nobody(F.col("answer").cast("string"), language)
    meta = [F.col("qid").try_cast("int").alias("id"), task.alias("task"), F.col("qtype"), F.col("seq_len"), F.col("atype")]
    context = jsonl_of(F.col("sequence"))
    if mode == "image":
        meta.append(image_paths(F.col("qid"), F.col("seq_len")).alias("images"))
        context = F.lit("")
    return samples.select(name.alias("config"), F.lit(instruction(language, mode)).alias("instruction"), F.struct(context.alias("context"), F.col("question")).alias("inputs"), said.alias("outputs"), F.struct(*meta).alias("meta"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with idx, their place from 0 in the given order within a config."""
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("config").orderBy(*order)) - 1)


def cyclic_prompt(idx: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PROMPTS)), F.pmod(idx, F.lit(len(PROMPTS))).cast("int") + 1)


def normalized_records(records: DataFrame) -> DataFrame:
    """Records with idx in the published shape: a prompt by turns, and categories under meta with defaults for what is missing."""
    categories = F.struct(F.coalesce("meta.task", F.lit("unknown")).alias("task_type"), F.coalesce("meta.seq_len", F.lit(0)).alias("seq_len"), F.coalesce("meta.atype", F.lit("person")).alias("atype"))
    meta = F.struct(F.coalesce("meta.id", F.col("idx") + 1).cast("int").alias("id"), categories.alias("categories"))
    return records.select("config", cyclic_prompt(F.col("idx")).alias("instruction"), "inputs", "outputs", meta.alias("meta"))


def shot_records(examples: DataFrame) -> DataFrame:
    """Records of few-shot examples (idx, qtype, seq_len, atype, question, answer, sequence), with ids beyond SHOTS_OFFSET."""
    task = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in TASKS.items() for x in kv)), F.col("qtype")), F.col("qtype"))
    categories = F.struct(task.alias("task_type"), F.coalesce("seq_len", F.lit(0)).alias("seq_len"), F.coalesce("atype", F.lit("person")).alias("atype"))
    meta = F.struct((F.lit(SHOTS_OFFSET + 1) + F.col("idx")).cast("int").alias("id"), categories.alias("categories"))
    inputs = F.struct(jsonl_of(F.col("sequence")).alias("context"), F.col("question"))
    return examples.select(cyclic_prompt(F.col("idx")).alias("instruction"), inputs.alias("inputs"), F.col("answer").cast("string").alias("outputs"), meta.alias("meta"))


def attached_shots(configs: DataFrame, shots: DataFrame, k: int = 5, whole_pool: bool = True, prefix: str = "rooms") -> DataFrame:
    """config with up to k shots of its task, by id; for a task without shots the first k of all, or none."""
    named = configs.select("config").distinct().withColumns(task_of_config(F.col("config"), prefix)).select("config", "task")
    own = first_per(shots.withColumn("task", F.col("meta.categories.task_type")), k, ["task"], "meta.id")
    found = named.join(own, "task")
    if whole_pool:
        bare = named.join(own.select("task").distinct(), "task", "left_anti")
        found = found.unionByName(bare.join(F.broadcast(shots.orderBy("meta.id").limit(k))), allowMissingColumns=True)
    return found.select("config", *shots.columns)


def with_split(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both parts as one table with a column split; rows of `train` that say test already are replaced by those of `test`."""
    old = train.where("split <> 'test'") if "split" in train.columns else train.withColumn("split", F.lit("train"))
    return old.unionByName(test.drop("split").withColumn("split", F.lit("test")), allowMissingColumns=True)


def localized_nobody(answer: Column, language: str) -> Column:
    return F.when(answer == NOBODY, RU_NOBODY).otherwise(answer) if language == "ru" else answer


def patched(records: DataFrame) -> DataFrame:
    """Records with idx and config: prompts by turns and the wording of two tasks put right. Doing it twice changes nothing more."""
    q = F.col("inputs.question")
    task = F.regexp_extract("config", r"_(dc_[a-z]+_[a-z])_\d+$", 1)
    q = F.when(task == "dc_whs_c", F.replace(q, F.lit(ALONE), F.lit(""))).when(task == "dc_cc_i", F.replace(q, F.lit(CROWD_OLD), F.lit(CROWD_NEW))).otherwise(q)
    return records.withColumn("instruction", cyclic_prompt(F.col("idx"))).withColumn("inputs", F.struct(F.col("inputs.context").alias("context"), q.alias("question")))


def vocabulary(language: str) -> dict[str, list[str]]:
    """Rooms and people in a language, in the order of the English ones."""
    from stepfold.model import RU_CHARS, RU_ROOMS

    return {"rooms": RU_ROOMS, "people": [*RU_CHARS, RU_NOBODY]} if language == "ru" else {"rooms": ROOMS, "people": [*CHARS, NOBODY]}


def swapped(answer: Column, language: str = "ru") -> Column:
    """An English answer in a language's words; others stay."""
    from_, to = ([*v["rooms"], *v["people"]] for v in map(vocabulary, ("en", language)))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in zip(from_, to, strict=True) for x in kv)), answer), answer)


# frames

# The grid that frames are drawn on and where the characters stand in a room.
COLUMNS, GRID_ROWS, WIDTH, HEIGHT, GAP, LIFT = 3, 2, 1.0, 1.5, 0.1, 0.08
PLACES = [(0.25, 0.8), (0.75, 0.8), (0.25, 0.25), (0.75, 0.25), (0.5, 0.5)]


def frame_layout(state: DataFrame, rooms: list[str] = ROOMS) -> DataFrame:
    """seq_id, step_id, ch, room, x, y, label_y: where each character is drawn in the frame of a step."""
    at = F.array_position(F.array(*map(F.lit, rooms)), F.col("room")) - 1
    place = F.element_at(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in PLACES)), F.col("ch_ord") + 1)
    x = (at % COLUMNS) * (WIDTH + GAP) + place["x"] * WIDTH
    y = (GRID_ROWS - 1 - F.floor(at / COLUMNS)) * (HEIGHT + GAP) + place["y"] * HEIGHT
    return state.select("seq_id", "step_id", "ch", "room", x.alias("x"), y.alias("y"), (y + LIFT).alias("label_y"))


def svg_frames(layout: DataFrame, rooms: list[str] = ROOMS) -> DataFrame:
    """seq_id, step_id, svg: a drawing of each step, as text."""
    boxes = "".join(f'<rect x="{i % COLUMNS * (WIDTH + GAP):g}" y="{i // COLUMNS * (HEIGHT + GAP):g}" width="{WIDTH:g}" height="{HEIGHT:g}"/><text x="{i % COLUMNS * (WIDTH + GAP) + 0.02:g}" y="{i // COLUMNS * (HEIGHT + GAP) + HEIGHT - 0.02:g}">{r}</text>' for i, r in enumerate(rooms))
    high = GRID_ROWS * (HEIGHT + GAP) - GAP
    number = lambda c: F.bround(c, 3).cast("string")
    dot = F.concat(F.lit('<circle r="0.06" cx="'), number(F.col("x")), F.lit('" cy="'), number(high - F.col("y")), F.lit('"/><text x="'), number(F.col("x")), F.lit('" y="'), number(high - F.col("label_y")), F.lit('">'), F.col("ch"), F.lit("</text>"))
    steps = layout.groupBy("seq_id", "step_id").agg(F.array_sort(F.collect_list(F.struct("ch", dot.alias("d")))).alias("x"))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="-0.05 -0.05 {COLUMNS * (WIDTH + GAP):g} {high + 0.3:g}" font-size="0.12" fill="none" stroke="black" stroke-width="0.01">'
    caption = F.concat(F.lit(f'<text x="{WIDTH * 1.5 + GAP:g}" y="{high + 0.2:g}">Step '), F.col("step_id").cast("string"), F.lit("</text></svg>"))
    return steps.select("seq_id", "step_id", F.concat(F.lit(head + boxes), F.array_join(F.transform("x", lambda e: e["d"]), ""), caption).alias("svg"))


def chosen(samples: DataFrame, qids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Samples to render: those of the ids if any are given, then at most `limit`, by qid."""
    rows = samples.where(F.col("qid").isin(qids)) if qids else samples
    return rows.orderBy("qid").limit(limit) if limit else rows
