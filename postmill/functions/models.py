"""Python models as detectors and analysers, loaded once in each worker.

`load` is a function without arguments that gives the model, a function from a list of texts to
a list of answers. It runs where the texts are, when the first batch comes, and its model serves
every later task of the same Python worker. Batches travel as Arrow data.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.language import UNKNOWN

_LOADED: dict[str, Any] = {}
_ANALYSIS = pa.struct([
    ("required_studies", pa.string()), ("technologies_required", pa.list_(pa.string())),
    ("experience_years_needed", pa.int32()), ("salary_offered", pa.int32()), ("token_cost", pa.int32()),
])


class _Loaded:
    """A key for a model; what it names stays in the worker's process."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list]]):
        self.load, self.key = load, uuid.uuid4().hex

    def model(self) -> Callable[[list[str]], list]:
        if self.key not in _LOADED:
            _LOADED[self.key] = self.load()
        return _LOADED[self.key]


def _answered(loaded: _Loaded, batches: Iterator[pa.Array], blank: Any) -> Iterator[list]:
    """Answers of the model for texts that are not blank, `blank` for the others."""
    for batch in batches:
        texts = batch.to_pylist()
        asked = [n for n, text in enumerate(texts) if text is not None and text.strip()]
        out = [blank] * len(texts)
        answers = loaded.model()([texts[n] for n in asked]) if asked else []
        for n, answer in zip(asked, answers, strict=True):
            out[n] = answer
        yield out


class ModelDetector:
    """A language detector; the model answers (language, confidence) for each text."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]]):
        self._loaded = _Loaded(load)

    def detect(self, text: Column) -> Column:
        return self.detect_with_confidence(text)["lang"]

    def detect_with_confidence(self, text: Column) -> Column:
        loaded = self._loaded

        @F.arrow_udf("lang string, confidence double")
        def detect(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for answers in _answered(loaded, batches, (UNKNOWN, 0.0)):
                langs, shares = ([a[i] for a in answers] for i in (0, 1))
                yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(shares, pa.float64())], ["lang", "confidence"])

        return detect(text)


def model_analyser(load: Callable[[], Callable[[list[str]], list[dict | None]]]) -> Callable[[Column], Column]:
    """An analyser; the model answers the fields of an analysis for each text, or None."""
    loaded = _Loaded(load)
    kind = (
        "required_studies string, technologies_required array<string>, experience_years_needed int,"
        " salary_offered int, token_cost int"
    )

    @F.arrow_udf(kind)
    def analyse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for answers in _answered(loaded, batches, None):
            yield pa.array(answers, _ANALYSIS)

    return analyse
