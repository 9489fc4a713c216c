"""Options and fixed values shared by every stage."""

from __future__ import annotations

import string
from dataclasses import asdict, dataclass, fields

REQUIRED_COLUMNS = (
    "id_registro",
    "texto",
    "canal_origem",
    "data",
    "classe_macro",
    "classe_detalhada",
)

MISSING_LABEL = "Não informado"

# The strings a CSV reader treats as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Stopword list of the regex tokeniser.
STOPWORDS = (
    "a", "ao", "aos", "as", "com", "da", "das", "de", "do", "dos", "e", "em", "entre", "na",
    "nas", "no", "nos", "o", "os", "ou", "para", "por", "que", "se", "sem", "um", "uma",
)

ASCII_PUNCTUATION = string.punctuation


class CasewiseError(Exception):
    """An expected failure, with a message meant for the person running the job."""


@dataclass(frozen=True)
class TextOptions:
    """Preprocessing switches and column names.

    ``lemmatize``, ``use_spacy``, ``language`` and ``spacy_model`` are kept so that stored
    options survive a round trip; tokenisation always uses the regex definition.
    """

    source_column: str = "texto"
    original_column: str = "texto_original"
    processed_column: str = "texto_processado"
    tokens_column: str = "texto_tokens"
    lowercase: bool = True
    remove_punctuation: bool = True
    remove_stopwords: bool = False
    lemmatize: bool = False
    normalize_text: bool = True
    clean_whitespace: bool = True
    use_spacy: bool = False
    language: str = "pt"
    spacy_model: str = "pt_core_news_sm"

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, stored: object) -> "TextOptions":
        """Rebuild stored options; unknown keys are ignored, anything but a dict gives the defaults."""
        if not isinstance(stored, dict):
            return cls()
        known = {field.name for field in fields(cls)}
        return cls(**{key: value for key, value in stored.items() if key in known})

    def active_steps(self) -> list[str]:
        """Names of the active steps, in the order they run."""
        steps = (
            (self.normalize_text, "normalizacao"),
            (self.clean_whitespace, "limpeza_espacos"),
            (self.lowercase, "lowercase"),
            (self.remove_punctuation, "remocao_pontuacao"),
            (self.remove_stopwords, "remocao_stopwords"),
            (self.lemmatize, "lematizacao"),
            (True, "tokenizacao"),
        )
        return [name for active, name in steps if active]

    def step_labels(self) -> list[str]:
        """The same steps with the accented labels shown next to a prediction."""
        # Display form of each step name.
        shown = {
            "normalizacao": "normalização",
            "limpeza_espacos": "limpeza de espaços",
            "remocao_pontuacao": "remoção de pontuação",
            "remocao_stopwords": "remoção de stopwords",
            "lematizacao": "lematização",
            "tokenizacao": "tokenização",
        }
        return [shown.get(step, step) for step in self.active_steps()]


@dataclass(frozen=True)
class TrainOptions:
    """Split, vocabulary and solver settings of the classifier.

    The solver stops when no component of the mean gradient exceeds ``tolerance``. A model with at most
    ``task_values`` vector entries is fitted inside one task, a larger one by passes over all tasks.
    """

    test_size: float = 0.2
    seed: int = 42
    max_features: int = 5000
    max_iter: int = 2000
    tolerance: float = 1e-6
    task_values: int = 1_000_000


HISTORY_FEATURES = 4000
TOP_K = 3
