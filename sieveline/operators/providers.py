"""Planning by a model behind an interface: cache, retries and fallback, as a distributed map over requests."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cache_lookup
from .planning import STRATEGIES

#: prompt, attempt -> response
Provider = Callable[[str, int], str]
FALLBACK = ("hybrid", 0.5)
_OUTER = re.compile(r"\{.*\}", re.S)


def parsed(response: str | None) -> tuple[str, float] | None:
    """Strategy and confidence (cut to 0..1) of a response, or None if it has no valid plan."""
    found = _OUTER.search(response or "")
    try:
        plan = json.loads(found[0]) if found else {}
        strategy = str(plan.get("selected_strategy")).strip().lower()
        return (strategy, min(1.0, max(0.0, float(plan.get("confidence"))))) if strategy in STRATEGIES else None
    except (ValueError, TypeError, AttributeError):
        return None


def decide(requests: DataFrame, cache: DataFrame, provider: Provider, attempts: int = 3) -> DataFrame:
    """requests (query_id, model, prompt_version, prompt) with selected_strategy, planner_confidence, raw_response, parse_attempts,
    parse_success and fallback_used. A cached response is used if it parses; else the provider is asked up to `attempts`
    times, then FALLBACK is taken. The provider runs inside the tasks, so it must be picklable; an error of one request is
    an attempt that failed, not the end of the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for prompt, response in zip(b["prompt"], b["raw_response"]):
                plan, tries = parsed(response), 0
                while plan is None and tries < attempts:
                    tries += 1
                    try:
                        response = provider(prompt, tries)
                    except Exception:  # noqa: BLE001
                        response = None
                    plan = parsed(response)
                out.append((*(plan or FALLBACK), response, tries, plan is not None, plan is None))
            cols = ["selected_strategy", "planner_confidence", "raw_response", "parse_attempts", "parse_success", "fallback_used"]
            yield pd.concat([b[["query_id", "model", "prompt_version"]].reset_index(drop=True), pd.DataFrame(out, columns=cols)], axis=1)

    looked = cache_lookup(requests, cache).select("query_id", "model", "prompt_version", "prompt", "raw_response")
    return looked.mapInPandas(run, "query_id string, model string, prompt_version string, selected_strategy string, planner_confidence double, raw_response string, parse_attempts int, parse_success boolean, fallback_used boolean")


def cache_rows(decided: DataFrame) -> DataFrame:
    """What to append to the cache: parsed responses by key."""
    from ..sources.tables import cache_key

    return decided.where("parse_success").select(cache_key().alias("cache_key"), "raw_response", F.current_timestamp().alias("created_at"))
