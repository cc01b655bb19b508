"""Answering one question by corrective retrieval, with a cache; everything heavy is a DataFrame behind ``retrieve``."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

#: Seconds an answer stays, least grade, retries, characters a grader sees.
TTL_S, LEAST_GRADE, RETRIES, GRADED = 900, 0.6, 1, 2000


class Cache:
    """Values by key for a time; on the driver."""

    def __init__(self, ttl: float = TTL_S, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock, self.kept = ttl, clock, {}

    def get(self, key: str):
        until, value = self.kept.get(key, (0.0, None))
        return value if self.clock() < until else None

    def set(self, key: str, value) -> None:
        self.kept = {k: v for k, v in self.kept.items() if v[0] > self.clock()} | {key: (self.clock() + self.ttl, value)}


def answer(question: str, city: str, retrieve: Callable[[str, str], str], grade: Callable[[str, str], float] | None = None, rewrite: Callable[[str], str] | None = None, generate: Callable[[str, str], str] | None = None, cache: Cache | None = None) -> dict:
    """Retrieves, grades, rewrites and retrieves again while the grade is low, and generates.

    Without a grader the grade is 0.5, without a rewriter the question stays, without a generator the context is the
    answer: the whole is then deterministic.
    """
    key = hashlib.md5(f"{city}:{question}".encode()).hexdigest()
    if cache is not None and (known := cache.get(key)) is not None:
        return known | {"cached": True}
    again = rewrite or (lambda q: q)
    asked, context = question, retrieve(question, city)
    if not context:
        asked = again(asked)
        context = retrieve(asked, city)
    score, tries = (grade(asked, context[:GRADED]) if grade else 0.5), 0
    while score < LEAST_GRADE and tries < RETRIES:
        asked, tries = again(asked), tries + 1
        context = retrieve(asked, city)
        score = grade(asked, context[:GRADED]) if grade else 0.5
    out = {"answer": generate(asked, context) if generate else context, "context": context, "score": score, "retries": tries, "cached": False}
    if cache is not None:
        cache.set(key, out)
    return out
