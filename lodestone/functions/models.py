"""Seams for models: functions on batches, wrapped as Arrow-backed Spark functions. Deterministic stand-ins serve tests."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Texts sent to an embedder at a time, and seconds to wait before each new try of a transient failure.
BATCH, DELAYS = 64, (0.5, 2.0)


class Transient(Exception):
    """A failure that may pass: only these are tried again."""


def tried(call: Callable, *args, delays=DELAYS, wait=time.sleep):
    for delay in [*delays, None]:
        try:
            return call(*args)
        except Transient:
            if delay is None:
                raise
            wait(delay)


def embedder(embed: Callable[[list[str]], list[list[float]]], batch: int = BATCH):
    """A column function text -> array<float>; a task makes the model once and keeps the order of texts. Null gives null."""

    @F.pandas_udf("array<float>")
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = pd.Series([None] * len(part), dtype=object)
            known = part.dropna()
            for a in range(0, len(known), batch):
                some = known.iloc[a : a + batch]
                for k, v in zip(some.index, tried(embed, some.tolist()), strict=True):
                    out.loc[k] = [float(x) for x in v]
            yield out

    return apply


def structured_llm(chat: Callable[[str, str], dict]):
    """A column function (system, user) -> struct<reply: json string, error: string>; a failed call is an error value, not a failed job."""

    @F.pandas_udf("reply string, error string")
    def apply(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for system, user in parts:
            rows = []
            for s, u in zip(system, user, strict=True):
                try:
                    reply = tried(chat, s, u)
                    rows.append((json.dumps(reply), None) if isinstance(reply, dict) else (None, "not an object"))
                except Exception as e:  # noqa: BLE001
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["reply", "error"])

    return apply


def transcriber(transcribe: Callable[[bytes, str | None], dict]):
    """A column function (content, language) -> struct<model, language, segments>; a file that cannot be transcribed has null segments and an error."""
    schema = "model string, language string, segments array<struct<text: string, start: double, end: double>>, error string"

    @F.pandas_udf(schema)
    def apply(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for content, language in parts:
            rows = []
            for c, lang in zip(content, language, strict=True):
                try:
                    out = tried(transcribe, c, lang)
                    rows.append((out["model"], out.get("language"), out["segments"], None))
                except Exception as e:  # noqa: BLE001
                    rows.append((None, lang, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["model", "language", "segments", "error"])

    return apply


def hash_embedding(texts: list[str], width: int = 64) -> list[list[float]]:
    """Unit vectors from the words' hashes: a model for tests."""
    out = []
    for t in texts:
        v = np.zeros(width)
        for w in t.lower().split():
            h = int(hashlib.sha1(w.encode()).hexdigest()[:12], 16)
            v[h % width] += 1 if h >> 20 & 1 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out
