"""Optional outside services: a language model behind a callable, never needed by the rest."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the model asked if the environment names none.
DEFAULT_MODEL = "gpt-5.2"
#: A model: prompt and content (a text, an image, or a list of images) to an answer.
Model = Callable[[str, object], str]


def model_available() -> bool:
    """Whether a key is set, even an empty one."""
    return "OPENAI_API_KEY" in os.environ


def model_id(default: str = DEFAULT_MODEL) -> str:
    return os.environ.get("OPENAI_API_MODEL", default)


def ask(rows: DataFrame, keys: list[str], content: str, prompt: str, model: Model, parallel: int = 5) -> DataFrame:
    """``keys``, answer: the model's answer for every row, on ``parallel`` partitions; a failing call gives an empty answer.

    A row whose content is null or empty is not asked and gives no answer row.
    """
    kinds = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]
    kind = rows.schema[content].dataType
    there = F.size(content) > 0 if isinstance(kind, T.ArrayType) else F.length(content) > 0
    if isinstance(kind, T.StringType):
        there = F.length(F.trim(content)) > 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers = []
            for t in b[content]:
                try:
                    answers.append(model(prompt, t) or "")
                except Exception:  # noqa: BLE001 - an outside service may fail in any way
                    answers.append("")
            yield b[keys].assign(answer=answers)

    return rows.filter(there).select(*keys, content).repartition(parallel).mapInPandas(run, ", ".join([*kinds, "answer string"]))
