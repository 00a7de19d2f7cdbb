"""Per-record judgements and look-ups by injected functions, partition by partition."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import judgement

#: fixed values: what stands for a judgement that failed
FAILED = {"decision": "uncertain", "criterion": "NA", "relevance": -1, "evidence": "", "reason": "failed"}


def judged(prompts: DataFrame, key: str, judge: Callable[[str], str], tries: int = 3, wait: float = 0.0) -> DataFrame:
    """key and the five fields of each prompt's judgement; what fails every try is uncertain with relevance -1."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers = []
            for prompt in b["prompt"]:
                answer = None
                for k in range(tries):
                    try:
                        answer = judge(prompt)
                        break
                    except Exception:
                        time.sleep(wait * (k + 1))
                answers.append(answer)
            yield pd.DataFrame({key: b[key], "response": answers})

    kind = prompts.schema[key].dataType.simpleString()
    out = prompts.select(key, "prompt").mapInPandas(run, f"{key} {kind}, response string").withColumn("j", judgement(F.col("response")))
    return out.select(key, *(F.coalesce(F.col(f"j.{n}"), F.lit(v)).alias(n) for n, v in FAILED.items()))


def looked_up(keys: DataFrame, key: str, resolve: Callable[[Sequence[str]], Sequence[str | None]], batch: int = 50, tries: int = 3) -> DataFrame:
    """key, value: keys are asked for in batches; a batch that fails every try is skipped."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), batch):
                part = b[key].iloc[s : s + batch].tolist()
                for _ in range(tries):
                    try:
                        yield pd.DataFrame({key: part, "value": list(resolve(part))})
                        break
                    except Exception:
                        continue

    return keys.select(key).mapInPandas(run, f"{key} {keys.schema[key].dataType.simpleString()}, value string")
