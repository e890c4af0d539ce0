"""Where a reader model plugs in: its settings, and predictions from examples."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers

#: Model families, told by a part of the model's name, the first that fits.
FAMILIES = ("mbart", "bartpho", "vit5", "mt5")
#: The language code of the family that needs one.
LANGUAGES = {"mbart": "vi_VN"}

#: A reader takes (query_id, source) and gives (query_id, prediction).
Reader = Callable[[DataFrame], DataFrame]


def model_family(name: str) -> str:
    return next((f for f in FAMILIES if f in name.lower()), "generic")


def greedy_settings(name: str, language_ids: Mapping[str, int] | None = None) -> dict[str, object]:
    """Greedy decoding; a family with a language code starts with it."""
    settings: dict[str, object] = {"num_beams": 1, "do_sample": False}
    language = LANGUAGES.get(model_family(name))
    if language:
        if not language_ids or language not in language_ids:
            raise ValueError(f"the tokenizer of {name} has no {language}")
        settings["forced_bos_token_id"] = language_ids[language]
    return settings


def predict(examples: DataFrame, method: str, reader: Reader, most: int | None = None, budget: int | None = None) -> DataFrame:
    """``examples(query_id, question, answer, contexts)`` through a reader:
    (query_id, question, prediction, reference).  ``budget``: the tokens of a passage that
    the prompt shows."""
    contexts = F.col("contexts") if budget is None else answers.cut_contexts(F.col("contexts"), budget)
    prompts = examples.select("query_id", answers.build_source(F.col("question"), contexts, method, most).alias("source"))
    targets = examples.select("query_id", "question", answers.build_target(F.col("answer")).alias("reference"))
    return targets.join(reader(prompts), "query_id").select("query_id", "question", "prediction", "reference")


def extractive_reader(prompts: DataFrame) -> DataFrame:
    """A stand-in for a model: the two sentences of the prompt's passages that share
    most words with its question.  Never to be reported as a neural reader."""
    blocks = F.split("source", "\n\n")
    question = F.regexp_replace(F.get(blocks, F.lit(1)), "^question: ", "")
    passages = F.array_join(F.slice(blocks, F.lit(3), F.size(blocks)), "\n")
    return prompts.select("query_id", T.concise_fact(passages, question).alias("prediction"))
