"""State-sequence analytics on PySpark.

The names here are the library's front: configuration, generation, reshaping, saving and the registry of questions. They
are imported when they are first asked for, so that importing one part doesn't import all.
"""

from importlib import import_module

_HOME = {
    "GenerationConfig": "stepfold.model",
    "QUESTIONS": "stepfold.operators.questions",
    "questions": "stepfold.plans.generate",
    "samples": "stepfold.plans.generate",
    "in_context_examples": "stepfold.plans.generate",
    "sequences": "stepfold.plans.state",
    "dense_metadata": "stepfold.plans.records",
    "relevant_counts": "stepfold.plans.records",
    "to_dict": "stepfold.plans.records",
    "from_dict": "stepfold.plans.records",
    "json_array": "stepfold.sources.sinks",
    "jsonl": "stepfold.sources.sinks",
}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_HOME[name]), name)
