"""Capability back ends: annotators run over partitions by mapInPandas, behind a capability and a privacy check."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

#: Rows that each capability gives.
SCHEMAS = {
    "embed": "id long, v array<float>",
    "tag": "id long, category string, value string, confidence double, tag_source string",
    "caption": "id long, model string, caption string",
    "detect": "id long, label string, score double, box array<double>",
}
PRIVACY = ("local", "trusted", "public")


@dataclass(frozen=True)
class Backend:
    """name, its capabilities (each a function of batches), and how private what it sees stays."""

    name: str
    run: dict[str, Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]]
    privacy: str = "local"


class Registry:
    def __init__(self):
        self._all: dict[str, Backend] = {}

    def add(self, backend: Backend) -> None:
        if backend.name in self._all:
            raise ValueError(f"{backend.name} is there already")
        if not set(backend.run) <= set(SCHEMAS) or backend.privacy not in PRIVACY:
            raise ValueError(f"{backend.name} names an unknown capability or privacy level")
        self._all[backend.name] = backend

    def dispatch(self, name: str, capability: str, refs: DataFrame, at_most: str = "local") -> DataFrame:
        """The capability's rows for refs; refused if the back end lacks it or is less private than asked."""
        backend = self._all[name]
        if capability not in backend.run:
            raise ValueError(f"{name} can't {capability}")
        if PRIVACY.index(backend.privacy) > PRIVACY.index(at_most):
            raise PermissionError(f"{name} is {backend.privacy}, at most {at_most} is allowed")
        return refs.mapInPandas(backend.run[capability], SCHEMAS[capability])


def out_of_memory(error: Exception) -> bool:
    text = str(error).lower()
    return isinstance(error, MemoryError) or (isinstance(error, RuntimeError) and ("out of memory" in text or ("mps" in text and "memory" in text)))


def halving(step: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A back end's function of batches out of step, a function of one: a batch that runs out of memory is tried again in halves, down to single rows.

    Rows keep their order. Other errors are raised, as is the one of a single row. The size that worked is kept for the batches that follow.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = None
        for batch in batches:
            todo = [batch] if most is None else [batch.iloc[i : i + most] for i in range(0, len(batch), most)]
            todo.reverse()
            while todo:
                part = todo.pop()
                try:
                    yield step(part)
                except (MemoryError, RuntimeError) as e:
                    if not out_of_memory(e) or len(part) <= 1:
                        raise
                    most = len(part) // 2
                    todo += [part.iloc[most:], part.iloc[:most]]

    return run


def all_kinds(step: Callable[[pd.DataFrame], dict[str, pd.DataFrame]], refs: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """kind, and a struct for each kind (null in others' rows): all that step makes of each batch of refs in one call, for VersionedStore.publish(by="kind").

    step gives rows for any of the kinds in schemas (name: DDL). One computation feeds several tables, which are committed together.
    """
    names = {k: [x.strip().split(" ")[0] for x in ddl.split(", ")] for k, ddl in schemas.items()}

    def run(batches):
        for batch in batches:
            for kind, rows in step(batch).items():
                if len(rows):
                    out = {"kind": [kind] * len(rows)} | {k: [None] * len(rows) for k in schemas}
                    out[kind] = rows[names[kind]].to_dict("records")
                    yield pd.DataFrame(out)

    columns = ", ".join(["kind string", *(f"{k} struct<{', '.join(f'{x.strip().split(chr(32), 1)[0]}: {x.strip().split(chr(32), 1)[1]}' for x in ddl.split(', '))}>" for k, ddl in schemas.items())])
    return refs.mapInPandas(run, columns)
