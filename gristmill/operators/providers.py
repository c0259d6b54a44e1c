"""Plug-ins by name: embedders, rerankers, generators and judges, the errors they raise, and retries."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import Any, TypeVar

from gristmill.functions import text as T
from gristmill.operators.answering import extractive
from gristmill.operators.retrieval import hashed_embedding, rerank

T_ = TypeVar("T_")


class ProviderError(Exception):
    """A provider could not do what it was asked."""


class RateLimited(ProviderError):
    """Asked too often; worth another attempt."""


class Transient(ProviderError):
    """Failed for now; worth another attempt."""


class Unauthorised(ProviderError):
    """Not allowed; another attempt would fail as well."""


class Unavailable(ProviderError):
    """Not installed, or lacks what it needs; found when a run is built."""


#: By kind and name: a function of the model's name that makes the plug-in. An embedder is (text column) -> vector column, a reranker
#: (candidates) -> candidates with score and place, a generator (context, questions) -> answers, a judge (claim, context) -> column.
REGISTRY: dict[str, dict[str, Callable[[str | None], Any]]] = {
    "embedder": {"fake": lambda model: lambda text: hashed_embedding(text)},
    "reranker": {"fake": lambda model: rerank},
    "generator": {"fake": lambda model: extractive},
    "judge": {"heuristic": lambda model: T.supported},
}


def register(kind: str, name: str, make: Callable[[str | None], Any]) -> None:
    if kind not in REGISTRY:
        raise ProviderError(f"no kind of provider {kind!r}; there are {', '.join(REGISTRY)}")
    REGISTRY[kind][name] = make


def make(kind: str, name: str, model: str | None = None) -> Any:
    """The plug-in of a kind and name; what it lacks is an error here, before any job starts."""
    if kind not in REGISTRY or name not in REGISTRY[kind]:
        raise Unavailable(f"no {kind} {name!r}; there are {', '.join(REGISTRY.get(kind, {}))}")
    try:
        return REGISTRY[kind][name](model)
    except ImportError as error:
        raise Unavailable(f"{kind} {name!r} needs a package that is missing: {error}") from error


def with_retries(call: Callable[[], T_], attempts: int = 4, base: float = 0.5, most: float = 8.0, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> T_:
    """The call's result; after rate limits and transient errors it is made again, up to so many times, after a random part of a doubling pause.

    For calls inside Arrow batches: a retry of the whole Spark task would make all its calls again.
    """
    rng = rng or random.Random()
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except (RateLimited, Transient):
            if attempt == attempts:
                raise
            sleep(rng.uniform(0.0, min(most, base * 2 ** (attempt - 1))))
    raise AssertionError("no attempts")

