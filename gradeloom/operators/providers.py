"""Outside help as injected callables: solvers of questions, readers of pages, and strategies.

No provider is built in.  A provider takes and returns plain dictionaries; failures of one
row are its row's, never the job's.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Provider = Callable[[dict], dict]


def asked(rows: DataFrame, key: str, request: list[str], provider: Provider, attempts: int = 2, wait: float = 0.0) -> DataFrame:
    """Each row put to a provider: key, ok, answer (JSON) and error."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf[[key, *request]].to_dict("records"):
                error = None
                for k in range(attempts):
                    try:
                        out.append((row[key], True, json.dumps(provider({c: row[c] for c in request}), ensure_ascii=False, sort_keys=True), None))
                        break
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                        if k + 1 < attempts and wait:
                            time.sleep(wait)
                else:
                    out.append((row[key], False, None, error))
            yield pd.DataFrame(out, columns=[key, "ok", "answer", "error"])

    return rows.select(key, *request).mapInPandas(run, f"{key} {kind}, ok boolean, answer string, error string")


def first_choice(row: dict) -> dict:
    """A stand-in for a solver: the first option, with little confidence."""
    return {"answer": "A", "confidence": 0.5}


class Strategies:
    """Transforms by kind of document, with one for all others."""

    def __init__(self, otherwise: Callable[[DataFrame], DataFrame]):
        self.otherwise, self.own = otherwise, {}

    def register(self, kind: str, run: Callable[[DataFrame], DataFrame]) -> None:
        self.own[kind] = run

    def run(self, kind: str, pages: DataFrame) -> DataFrame:
        return self.own.get(kind, self.otherwise)(pages)


def better(first: DataFrame, second: Callable[[], DataFrame], least: int) -> DataFrame:
    """The first result, unless it is too short and the second is no shorter."""
    n = first.limit(least).count()
    if n >= least:
        return first
    other = second()
    return other if other.limit(least).count() >= n else first
