"""Model providers: who answers, with which prompt, and how often a refused request is tried again.

The responses of a corpus are a table, and a scan of it is the default source. `generate` fills such a table: requests are
spread over a set number of partitions, and each partition's worker asks its provider, one request at a time. A provider is
any object with name, model and complete(prompt, system) -> (content, usage); live ones import their library when they are
made, and the mock answers from the code alone.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgrid.schemas import RESPONSES
from factgrid.sources.mock import mock_analysis, mock_steps

#: Prompt types that each provider has; an unknown type means analysis.
PROMPT_TYPES = {
    "openai": ("analysis", "explanation", "review", "function_calls"),
    "gemini": ("analysis", "explanation", "function_calls"),
    "groq": ("analysis", "explanation"),
    "mock": ("analysis",),
}
_JSON = 'Answer with JSON only: {"functions": [{"name": "...", "calls": ["..."]}]}. Name only functions of this program, and only direct calls.'
PROMPTS = {
    "analysis": f"List each function of the following Python program and the functions that it calls. {_JSON}\n\n```python\n{{code}}\n```",
    "explanation": "Explain step by step what the following Python program does, which functions it has, and which call which.\n\n```python\n{code}\n```",
    "review": "Review the following Python program: structure, data flow, and calls between its functions.\n\n```python\n{code}\n```",
    "function_calls": f"Which functions of the following Python program call which? {_JSON}\n\n```python\n{{code}}\n```",
}
#: provider: environment variable of its key, default model, temperature, most tokens.
PROVIDERS = {
    "groq": ("GROQ_API_KEY", "llama-3.3-70b-versatile", 0.1, 2000),
    "gemini": ("GEMINI_API_KEY", "gemini-2.0-flash", 0.3, 2000),
    "openai": ("OPENAI_API_KEY", "gpt-3.5-turbo", 0.3, 2000),
}
_LIBRARIES = {"groq": "groq", "gemini": "google.generativeai", "openai": "openai"}
GEMINI_MODELS = ("gemini-2.0-flash", "gemini-1.5-flash", "gemini-1.5-pro")
TRIES = 3


def prompt_type(provider: str, kind: str) -> str:
    return kind if kind in PROMPT_TYPES.get(provider, ()) else "analysis"


def prompt(provider: str, kind: str, code: str) -> str:
    return PROMPTS[prompt_type(provider, kind)].replace("{code}", code)


def prompts(requests: DataFrame, provider: str, kind: Column) -> DataFrame:
    """requests (code) with prompt."""
    known = F.create_map(*[F.lit(x) for k in PROMPT_TYPES.get(provider, ()) for x in (k, PROMPTS[k])])
    return requests.withColumn("prompt", F.replace(F.coalesce(F.try_element_at(known, kind), F.lit(PROMPTS["analysis"])), F.lit("{code}"), F.col("code")))


def is_available(provider: str, key: str | None = None) -> bool:
    """There is a key and the provider's library; the mock is always there."""
    if provider == "mock":
        return True
    import importlib.util

    library = _LIBRARIES[provider].split(".")[0]
    return bool(key or os.environ.get(PROVIDERS[provider][0])) and importlib.util.find_spec(library) is not None


def choose(provider: str = "auto", key: str | None = None, available: Callable[[str, str | None], bool] = is_available) -> str:
    """The provider to use: the named one, which must have a key; with auto the first that is available, else the mock."""
    if provider == "mock":
        return "mock"
    if provider == "auto":
        return next((p for p in PROVIDERS if available(p, key)), "mock")
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider: {provider}")
    if not available(provider, key):
        raise RuntimeError(f"{provider} needs a key in {PROVIDERS[provider][0]} and its library")
    return provider


def retry_seconds(message: str, default: float = 30.0) -> float:
    """The wait that a refusal asks for, and a second more."""
    found = re.search(r"retry\w*[^0-9]*([0-9]+(?:\.[0-9]+)?)\s*s?", message, re.IGNORECASE)
    return (float(found[1]) if found else default) + 1


def with_retries(ask: Callable[[str], tuple[str, dict[str, int]]], models: tuple[str, ...], tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str, dict[str, int]]:
    """(model, content, usage): after a refusal for quota it waits as told and takes the next model, after an unknown model the next at once."""
    last: Exception | None = None
    for k in range(tries):
        model = models[k % len(models)]
        try:
            return (model, *ask(model))
        except Exception as e:  # libraries raise their own kinds; the text says which it is
            last = e
            if re.search(r"429|quota|rate", str(e), re.IGNORECASE):
                sleep(retry_seconds(str(e)))
            elif not re.search(r"404|not found", str(e), re.IGNORECASE):
                raise
    raise RuntimeError(f"no answer after {tries} tries: {last}")


def word_usage(prompt_text: str, content: str) -> dict[str, int]:
    a, b = len(prompt_text.split()), len(content.split())
    return {"prompt_tokens": a, "completion_tokens": b, "total_tokens": a + b}


@dataclass
class Mock:
    """Answers from the code alone."""

    name: str = "mock"
    model: str = "mock-model"

    def complete(self, text: str, code: str) -> tuple[str, dict[str, int]]:
        content = mock_analysis(code)
        return content, word_usage(code, content)


@dataclass
class Live:
    """A provider over its own library."""

    name: str
    key: str | None = None
    model: str = ""
    sleep: Callable[[float], None] = field(default=time.sleep)

    def complete(self, text: str, code: str) -> tuple[str, dict[str, int]]:
        variable, default, temperature, most = PROVIDERS[self.name]
        key, model = self.key or os.environ[variable], self.model or default
        if self.name == "gemini":
            import google.generativeai as genai

            genai.configure(api_key=key)

            def ask(m: str) -> tuple[str, dict[str, int]]:
                content = genai.GenerativeModel(m).generate_content(text).text
                return content, word_usage(text, content)

            self.model, content, usage = with_retries(ask, (model, *(m for m in GEMINI_MODELS if m != model)), sleep=self.sleep)
            return content, usage
        if self.name == "groq":
            from groq import Groq as Client
        else:
            from openai import OpenAI as Client
        system = "You analyse source code. " + ("Answer with JSON only." if self.name == "groq" else "Answer step by step.")
        answer = Client(api_key=key).chat.completions.create(model=model, temperature=temperature, max_tokens=most, messages=[{"role": "system", "content": system}, {"role": "user", "content": text}])
        u = answer.usage
        return answer.choices[0].message.content, {"prompt_tokens": u.prompt_tokens, "completion_tokens": u.completion_tokens, "total_tokens": u.total_tokens}


def step_lines(content: str, starts: tuple[str, ...], strip: bool) -> list[str]:
    """A response cut into steps where a line begins one; lines before the first are dropped."""
    steps: list[list[str]] = []
    for line in content.split("\n"):
        line = line.strip() if strip else line
        if line.startswith(starts):
            steps.append([line])
        elif steps:
            steps[-1].append(line)
    return ["\n".join(s) for s in steps]


def generate(sources: DataFrame, provider: str = "auto", kind: str = "analysis", run_id: str = "0", partitions: int = 4, make: Callable[[str], object] | None = None) -> DataFrame:
    """responses of a provider to sources (file_id, code); make builds the provider in a worker."""
    chosen = provider if make else choose(provider)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from factgrid.operators.claims import STEP_STARTS

        client = make(chosen) if make else Mock() if chosen == "mock" else Live(chosen)
        for batch in batches:
            rows = []
            for file_id, code in zip(batch["file_id"], batch["code"], strict=True):
                content, usage = client.complete(prompt(chosen, kind, code or ""), code or "")
                steps = mock_steps(content) if chosen == "mock" else [content] if chosen == "groq" else step_lines(content, STEP_STARTS, True)
                rows.append((file_id, run_id, content, steps, client.model, usage))
            yield pd.DataFrame(rows, columns=["file_id", "run_id", "content", "reasoning_steps", "model", "usage"])

    return sources.select("file_id", "code").repartition(partitions, "file_id").mapInPandas(ask, RESPONSES)
