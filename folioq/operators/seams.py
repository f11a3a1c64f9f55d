"""Places for models. Each is a function of Arrow batches; the library has stand-ins, deployments bring their own."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Scorer(Protocol):
    """Scores (query, text) pairs, higher for better."""

    def __call__(self, query: pd.Series, text: pd.Series) -> pd.Series: ...


class Writer(Protocol):
    """Writes the answer to a prompt."""

    def __call__(self, prompt: pd.Series) -> pd.Series: ...


class Embedder(Protocol):
    """Makes a vector of each text."""

    def __call__(self, text: pd.Series) -> pd.Series: ...


def overlap_scorer(query: pd.Series, text: pd.Series) -> pd.Series:
    """Share of the query's words that the text holds."""

    def one(q: str, t: str) -> float:
        asked = set((q or "").lower().split())
        return len(asked & set((t or "").lower().split())) / len(asked) if asked else 0.0

    return pd.Series([one(q, t) for q, t in zip(query, text, strict=True)], dtype="float64")


#: Words of a text that a scorer sees.
SEEN = 320


def scored(pairs: DataFrame, scorer: Scorer, query: str = "query", text: str = "text", words: int = SEEN) -> DataFrame:
    """`pairs` with the scorer's `score`, batch by batch; it sees the first `words` words of a text, as such models do."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(score=scorer(frame[query], frame[text].map(lambda t: " ".join((t or "").split()[:words]))))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInPandas(run, f"{schema}, score double")


def embedded(texts: DataFrame, embedder: Embedder, text: str = "text") -> DataFrame:
    """`texts` with the embedder's `vec`, batch by batch. Blank texts have no vector and are dropped; equal ones can be embedded once
    by way of ingest.embed_once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(vec=embedder(frame[text]))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.where(f"trim({text}) != ''").mapInPandas(run, f"{schema}, vec array<double>")


def written(prompts: DataFrame, writer: Writer, prompt: str = "prompt") -> DataFrame:
    """`prompts` with the writer's `answer`, batch by batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(answer=writer(frame[prompt]))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return prompts.mapInPandas(run, f"{schema}, answer string")


def letter_embedder(text: pd.Series) -> pd.Series:
    """Shares of the letters a to z: a stand-in that depends on the text alone."""

    def one(t: str) -> list[float]:
        low = t.lower()
        return [low.count(chr(97 + k)) / len(t) for k in range(26)]  # lower() can lengthen a text

    return text.map(one)


def quoting_writer(prompt: pd.Series) -> pd.Series:
    """Answers with the prompt's last line: a stand-in."""
    return prompt.map(lambda p: (p or "").strip().rsplit("\n", 1)[-1])
