"""Chat model providers. A provider turns a prompt column into a reply column.

Replies are null when every model of the chain fails; the callers decide what then stands
in. :func:`scripted_model` makes offline tests deterministic.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Model = Callable[[Column], Column]


class RateLimited(RuntimeError):
    """The endpoint asked to slow down (HTTP 429)."""


def post_json(url: str, body: dict, api_key: str = "", timeout: float = 120.0) -> dict:
    request = urllib.request.Request(
        url, json.dumps(body).encode(),
        {"Content-Type": "application/json", "Authorization": f"Bearer {api_key}"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as response:
            return json.load(response)
    except urllib.error.HTTPError as error:
        raise (RateLimited(str(error)) if error.code == 429 else error) from error


def with_retry(call: Callable[[], dict], attempts: int, wait: Callable[[int], float]):
    """Repeat a rate-limited call; any other error passes through at once."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except RateLimited:
            if attempt == attempts:
                raise
            time.sleep(wait(attempt))


def chat_model(base_url: str, model: str, api_key: str = "", fallbacks: Sequence[str] = (),
               system: str | None = None, temperature: float = 0.1, attempts: int = 3,
               wait_seconds: float = 5.0, post=None) -> Model:
    """An OpenAI-compatible chat endpoint with a chain of fallback models.

    Calls run in the tasks. The expression is marked non-deterministic so that Spark does
    not repeat a call it could merge.
    """
    send = post or post_json

    @F.pandas_udf(T.StringType())
    def reply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def ask(prompt):
            messages = ([{"role": "system", "content": system}] if system else []) + [
                {"role": "user", "content": prompt}]
            for name in (model, *fallbacks):
                try:
                    answer = with_retry(
                        lambda: send(f"{base_url}/chat/completions", {
                            "model": name, "temperature": temperature, "messages": messages}, api_key),
                        attempts, lambda attempt: wait_seconds * attempt)
                    return answer["choices"][0]["message"]["content"].strip()
                except Exception:
                    continue
            return None

        for prompts in batches:
            yield prompts.map(lambda p: None if p is None else ask(p))

    return reply.asNondeterministic()


def scripted_model(fn: Callable[[str], str | None]) -> Model:
    """A model played by a Python function."""

    @F.pandas_udf(T.StringType())
    def reply(prompts: pd.Series) -> pd.Series:
        def ask(prompt):
            try:
                return None if prompt is None else fn(prompt)
            except Exception:
                return None

        return prompts.map(ask)

    return reply
