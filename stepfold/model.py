"""Data model: configuration, dimensions and fixed names."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

# Default configuration, languages and task codes.
DEFAULT_SEED = 0xBADFACE
DEFAULT_SEQ_LENGTHS = [1, 2, 4, 8, 16, 32, 64, 128]
DEFAULT_N_QUESTIONS = 50
ROOMS = ["Kitchen", "Bathroom", "Garden", "Office", "Bedroom", "Hallway"]
CHARS = ["Sandra", "Mary", "John", "Daniel", "Michael"]
NOBODY = "Nobody"
ATYPES = ["person", "room", "number"]
RU_ROOMS = ["Кухня", "Ванная", "Сад", "Офис", "Спальня", "Коридор"]
RU_CHARS = ["Сандра", "Мария", "Иван", "Даниил", "Михаил"]
RU_NOBODY = "Никто"
RU_PLACES = ["на Кухне", "в Ванной", "в Саду", "в Офисе", "в Спальне", "в Коридоре"]
FEMALE = ["Sandra", "Mary"]
TASKS = {
    "first_app": "FA-FA-R", "char_on_char_first_app": "FA-CCFA-R", "first_at_room": "FA-FR-C", "room_on_char_first_app": "FA-RCFA-C", "n_room_on_char_first_app": "FA-NRFA-I",
    "final_app": "FI-FA-R", "char_on_char_final_app": "FI-CCFA-R", "last_at_room": "FI-LR-C", "room_on_char_final_app": "FI-RCFA-C", "n_room_on_char_final_app": "FI-NRFA-I",
    "char_at_frame": "FX-CF-R", "room_at_frame": "FX-RF-C", "char_on_char_at_frame": "FX-CCF-C", "n_char_at_frame": "FX-NCF-I", "n_empty": "FX-NE-I",
    "room_empty": "DC-RE-R", "where_spend": "DC-WS-R", "crowded_room": "DC-CR-R", "who_spend": "DC-WHS-C", "spend_alone": "DC-SA-C",
    "spend_together": "DC-ST-C", "steps_in_room": "DC-SR-I", "rooms_visited": "DC-RV-I", "crowd_count": "DC-CC-I",
}
LEADERBOARD_TASKS = ["spend_alone", "steps_in_room", "crowd_count", "where_spend", "who_spend"]
LEADERBOARD_LENGTHS = [32, 64, 128]

ATYPE_OF_CODE = {"R": "room", "C": "person", "I": "number"}


def atype(qtype: str) -> str:
    return ATYPE_OF_CODE[TASKS[qtype][-1]]


@dataclass(frozen=True)
class GenerationConfig:
    """What to generate; raises ValueError where it makes no sense."""

    seed: int = DEFAULT_SEED
    seq_lengths: list[int] = field(default_factory=lambda: list(DEFAULT_SEQ_LENGTHS))
    n_questions: int = DEFAULT_N_QUESTIONS
    question_types: list[str] | None = None
    rooms: list[str] = field(default_factory=lambda: list(ROOMS))
    chars: list[str] = field(default_factory=lambda: list(CHARS))
    target_keyframes: int | list[int] | tuple[int, int] | None = None

    def __post_init__(self):
        for name in ("seq_lengths", "rooms", "chars"):
            if not getattr(self, name):
                raise ValueError(f"{name} is empty")
        if self.n_questions < 1:
            raise ValueError("n_questions is below 1")
        goal = self.target_keyframes
        if isinstance(goal, list | tuple) and len(goal) != 2:
            raise ValueError("target_keyframes is neither a number nor a range of two")
        low, high = self.keyframes
        if goal is not None and not (isinstance(low, int) and isinstance(high, int)):
            raise ValueError("target_keyframes is not whole numbers")
        if goal is not None and (low < 1 or high < low):
            raise ValueError("target_keyframes is below 1 or an inverted range")

    @property
    def keyframes(self) -> tuple[int | None, int | None]:
        """Least and greatest number of key frames; None for any."""
        goal = self.target_keyframes
        return tuple(goal) if isinstance(goal, list | tuple) else (goal, goal)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> GenerationConfig:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})

    def get_question_types(self) -> list[str]:
        chosen = list(TASKS) if self.question_types is None else self.question_types
        if unknown := [q for q in chosen if q not in TASKS]:
            raise ValueError(f"unknown question types: {unknown}")
        return chosen
