"""Generated questions: each cell holds as many as are asked for, where few sequences have an answer too."""

from stepfold.model import GenerationConfig
from stepfold.plans import generate


def test_cells_are_full(spark):
    config = GenerationConfig(seq_lengths=[1, 2], n_questions=20, question_types=["room_empty", "n_empty"])
    sizes = {(r.seq_len, r.qtype): r["count"] for r in generate.questions(spark, config).groupBy("seq_len", "qtype").count().collect()}
    assert sizes == {(n, q): 20 for n in (1, 2) for q in ("room_empty", "n_empty")}


def test_default_configuration_is_full(spark):
    from stepfold import registry

    rows = registry.QUERIES["gen_questions"](spark, "").groupBy("seq_len", "qtype").count().collect()
    assert len(rows) == 8 * 24 and {r["count"] for r in rows} == {50}
