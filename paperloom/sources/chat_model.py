"""Questions to a hosted chat model about texts. Each distinct text is asked once; the number of calls is limited."""

from __future__ import annotations

import json
import math
import os
import random
import re
import time
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import settings
from .http import Client, distinct_values, frame

# What is asked about power analyses.
POWER_FIELDS = ("type", "test", "sample", "alpha", "power", "es", "es_metric", "software")
POWER_QUERY = (
    "Does this text report a power analysis? If so, return the type (apriori, post-hoc or sensitivity), the statistical test, the sample size, the critical "
    "alpha, the power level, the effect size, the effect size metric and the software as JSON, with the keys " + ", ".join(POWER_FIELDS) + ". Give null for what "
    'is not stated. If there is no power analysis, return [{"type": "none"}]. If there are several, return a list. Answer only in valid JSON, from [ to ].'
)


def model(name: str | None = None) -> str:
    """Gets or sets the model."""
    if name is not None:
        if not isinstance(name, str):
            raise ValueError("set the model by name, see model_list()")
        settings.chat_model = name
    return settings.chat_model


def max_calls(n: int | None = None) -> int:
    """Gets or sets the most calls of one question; below 1 changes nothing."""
    if n is not None:
        if isinstance(n, bool) or not isinstance(n, int | float):
            raise ValueError("n must be a number")
        if n >= 1:
            settings.chat_max_calls = int(n)
    return settings.chat_max_calls


def use(value: bool | None = None) -> bool:
    """Gets or sets whether modules may ask; never without a key."""
    if value is not None:
        if value not in (True, False):
            raise ValueError("set use with True or False")
        settings.chat_use = bool(value)
    return settings.chat_use and bool(_key())


def _key() -> str:
    return os.environ.get("GROQ_API_KEY", "")


def _headers(key: str) -> dict[str, str]:
    return {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}


def model_list(client: Client | None = None, key: str | None = None) -> list[dict[str, Any]]:
    """The models that answer in text."""
    got = (client or Client()).get(f"{settings.chat_url}/models", _headers(key or _key()))
    found = got.json()["data"] if got.status == 200 else []
    return [{c: m.get(c) for c in ("id", "owned_by", "created", "context_window")} for m in found if m.get("active", True) and not re.search("whisper|vision", m["id"])]


def _call(client: Client, key: str, body: dict) -> dict[str, Any]:
    """One answer; waits and tries once more if there are too many requests."""
    data = json.dumps(body).encode()
    got = client.request("POST", f"{settings.chat_url}/chat/completions", _headers(key), data)
    if got.status == 429:
        time.sleep(math.ceil(float(got.headers.get("retry-after", 1))))
        got = client.request("POST", f"{settings.chat_url}/chat/completions", _headers(key), data)
    try:
        content = got.json()
        if not 200 <= got.status < 300:
            e = content.get("error", {})
            raise ValueError(f"{e.get('type')}/{e.get('code')}\n\n{e.get('message')}")
        usage = content.get("usage", {})
        return {"answer": content["choices"][0]["message"]["content"].strip(), "time": usage.get("total_time"), "tokens": usage.get("total_tokens"), "error": False}
    except Exception as e:  # an answer that can't be read is that text's error
        return {"error": True, "error_msg": str(e)}


def ask(
    table: DataFrame, query: str, text_col: str = "text", model_name: str | None = None, max_tokens: int = 1024, temperature: float = 0.5, top_p: float = 0.95,
    seed: int | None = None, client: Client | None = None, key: str | None = None, answers: DataFrame | None = None,
) -> DataFrame:
    """table with answer, time, tokens, error and error_msg. Time and tokens are in the first row of each text, 0 in its others.

    answers: those that a model gave before, unique by asked (the text), with answer, time, tokens, error and error_msg as far as there are;
    then no model is asked, and texts without an answer have nulls.
    """
    if answers is not None:
        kinds = {"answer": "string", "time": "double", "tokens": "bigint", "error": "boolean", "error_msg": "string"}
        return _answered(table, text_col, answers.select(F.col("asked").alias("_asked"), *((F.col(c) if c in answers.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items())))
    key = key or _key()
    if not key and client is None:
        raise ValueError("You need to include a key or set the variable GROQ_API_KEY")
    if not isinstance(temperature, int | float) or not 0 <= temperature <= 2:
        raise ValueError("temperature must be between 0.0 and 2.0")
    if not isinstance(top_p, int | float) or not 0 <= top_p <= 1:
        raise ValueError("top_p must be between 0.0 and 1.0")
    try:
        texts = distinct_values(table, text_col, max_calls())
    except ValueError:
        raise ValueError(f"This would make more calls than your maximum of {max_calls()}. Use max_calls() to change this.") from None
    if not texts:
        raise ValueError("No calls to make")
    body = {"model": model_name or model(), "temperature": temperature, "max_completion_tokens": max_tokens, "top_p": top_p, "seed": seed or random.randrange(10**6, 10**7), "stream": False, "stop": None}
    rows = []
    for t in texts:
        asked = {**body, "messages": [{"role": "system", "content": query}, {"role": "user", "content": t}]}
        rows.append({"_asked": t, **_call(client or Client(), key, asked)})
    return _answered(table, text_col, frame(table.sparkSession, rows, "_asked string, answer string, time double, tokens long, error boolean, error_msg string"))


def _answered(table: DataFrame, text_col: str, answers: DataFrame) -> DataFrame:
    """The answers joined back."""
    out = table.join(answers, F.col(text_col) == F.col("_asked"), "left").drop("_asked")
    first = F.row_number().over(Window.partitionBy(text_col).orderBy(*([c for c in table.columns if c != text_col] or [text_col]))) == 1
    return out.withColumn("_first", first).withColumns({c: F.when(F.col("_first") | F.col(c).isNull(), F.col(c)).otherwise(0) for c in ("time", "tokens")}).drop("_first")
