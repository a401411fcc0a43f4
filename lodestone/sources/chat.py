"""Chat models behind an HTTP endpoint: a function from prompt to reply for planners and judges, a column of replies, and the texts of logged answers."""

from __future__ import annotations

import http.client
import json
import os
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.records import or_else

# The service's path, attempts, seconds for an answer, limits of a wait in seconds, by what part waits vary, temperature.
PATH, ATTEMPTS, TIMEOUT, LEAST_WAIT, MOST_WAIT, VARIES, TEMPERATURE = "/chat/completions", 6, 180.0, 1.0, 120.0, 0.25, 0.7
#: Calls that a task has under way.
SIDE_BY_SIDE = 8


def endpoint_url(base: str) -> str:
    base = base.rstrip("/")
    return base if base.endswith(PATH) else base + PATH


def wait_seconds(attempt: int, retry_after: str | None = None, draw: Callable[[], float] = random.random) -> float:
    """Seconds before the attempt after this one (from 0): what the service asks for, else a doubling wait that varies."""
    try:
        return max(0.0, float(retry_after or "none"))
    except ValueError:
        return max(LEAST_WAIT, min(2.0**attempt, MOST_WAIT) * (1 + VARIES * (2 * draw() - 1)))


def reply_text(answer: dict) -> str:
    """The assistant's text in an answer: a string, or blocks of text on a line each; without any, what reasoning models and older services give instead."""
    choice = (answer.get("choices") or [{}])[0]
    message = choice.get("message") or {}
    content = message.get("content")
    if isinstance(content, list):
        blocks = (b if isinstance(b, str) else b.get("text") or b.get("content") or "" if isinstance(b, dict) else "" for b in content)
        content = "\n".join(str(b) for b in blocks if b)
    return str(content or message.get("reasoning_content") or message.get("output_text") or choice.get("text") or "")


def assistant_text(body: Column) -> Column:
    """reply_text() of answers as JSON, such as a log or the output of a batch has them; empty where there is no answer, or no JSON."""
    whole = F.try_parse_json(body)
    at = lambda v, path, kind="string": F.try_variant_get(v, "$" + path, kind)
    content = at(whole, ".choices[0].message.content", "variant")
    block = lambda b: F.when(F.schema_of_variant(b) == "STRING", at(b, "")).when(F.schema_of_variant(b).startswith("OBJECT"), or_else(at(b, ".text"), at(b, ".content"))).otherwise("")
    blocks = F.filter(F.transform(at(content, "", "array<variant>"), block), lambda t: t != "")
    text = F.when(F.schema_of_variant(content).startswith("ARRAY"), F.array_join(blocks, "\n")).otherwise(at(content, ""))
    return or_else(text, *(at(whole, f".choices[0]{p}") for p in (".message.reasoning_content", ".message.output_text", ".text")))


@dataclass(frozen=True)
class ChatModel:
    """A model that tasks ask: `ChatModel(url, name)(prompt)` is its reply.

    Answers of status 429 (after the wait that it names) and 5xx, lost connections and answers that don't come in time are asked for again, `attempts`
    times in all; other faults raise at once. Its own attempts make Retrying needless.
    """

    url: str = "http://localhost:8000/v1"
    name: str | None = None
    key: str = field(default="EMPTY", repr=False)
    temperature: float = TEMPERATURE
    max_tokens: int | None = None
    attempts: int = ATTEMPTS
    timeout: float = TIMEOUT

    @classmethod
    def load(cls, spark: SparkSession | None = None, **more) -> ChatModel:
        """lodestone.chat.url, .name and .key of the session, else LODESTONE_CHAT_URL, _NAME and _KEY of the driver's environment."""
        given = {}
        for name in ("url", "name", "key"):
            value = (spark.conf.get(f"lodestone.chat.{name}", None) if spark else None) or os.environ.get(f"LODESTONE_CHAT_{name.upper()}")
            if value:
                given[name] = value
        return cls(**given | more)

    def request(self, prompt: str) -> urllib.request.Request:
        asked = {"model": self.name, "messages": [{"role": "user", "content": prompt}], "temperature": self.temperature}
        if self.max_tokens is not None:
            asked["max_tokens"] = max(1, self.max_tokens)
        return urllib.request.Request(endpoint_url(self.url), json.dumps(asked).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})

    def __call__(self, prompt: str) -> str:
        for attempt in range(self.attempts):
            named = None
            try:
                with urllib.request.urlopen(self.request(prompt), timeout=self.timeout) as answer:
                    return reply_text(json.loads(answer.read()))
            except (OSError, http.client.HTTPException) as e:
                if isinstance(e, urllib.error.HTTPError):
                    if e.code != 429 and e.code < 500:
                        raise
                    named = e.headers.get("Retry-After") if e.code == 429 else None
                if attempt + 1 == self.attempts:
                    raise
            time.sleep(wait_seconds(attempt, named))
        raise ValueError("no attempts")


def replies(prompts: DataFrame, model: Callable[[str], str], id_col: str = "prompt_id", prompt_col: str = "prompt", side_by_side: int = SIDE_BY_SIDE) -> DataFrame:
    """(id, reply, error): a model's reply to each prompt, or why there is none; a null prompt gets neither.

    A task has side_by_side calls under way, so the service sees that many times the number of running tasks. Each action
    asks again: write the result (see scratch.materialize) before it is read twice.
    """
    kind = prompts.schema[id_col].dataType.simpleString()

    def one(prompt: str | None) -> tuple[str | None, str | None]:
        if prompt is None:
            return None, None
        try:
            return model(prompt), None
        except Exception as e:  # noqa: BLE001 - whatever a model raises must not end the job
            return None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(side_by_side) as pool:
            for f in frames:
                got = list(pool.map(one, f[prompt_col]))
                yield pd.DataFrame({id_col: f[id_col], "reply": [r for r, _ in got], "error": [e for _, e in got]})

    return prompts.select(id_col, prompt_col).mapInPandas(run, f"`{id_col}` {kind}, reply string, error string")
