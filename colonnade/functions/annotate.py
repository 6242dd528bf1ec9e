"""Batch annotation of prompts with a user's model client."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions import render

STRICTER = "\n\nReturn only valid JSON."


def rule_client(prompts: list[str]) -> list[str]:
    """Default client: answers by the data type named at the end of the prompt."""
    forced = ("integer", "float", "date", "datetime")
    return [json.dumps({"classification": "property" if p.rsplit(" ", 1)[-1] in forced else "entity", "confidence": 1.0}) for p in prompts]


def _is_json(text: str | None) -> bool:
    try:
        json.loads(text or "")
        return True
    except ValueError:
        return False


def answers(prompts: DataFrame, client: Callable[[list[str]], list[str]]) -> DataFrame:
    """Adds ``answer`` to prompt rows. Answers that are no JSON are asked for once more with a stricter ending; a failing
    client gives rows without an answer, not a failed job."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = batch["prompt"].tolist()
            try:
                answers = list(client(asked))
                again = [i for i, a in enumerate(answers) if not _is_json(a)]
                if again:
                    for i, a in zip(again, client([asked[i] + STRICTER for i in again])):
                        answers[i] = a
            except Exception:  # noqa: BLE001
                answers = [None] * len(asked)
            yield batch.assign(answer=answers)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields) + ", answer string"
    return prompts.mapInPandas(run, schema)


def annotate(prompts: DataFrame, client: Callable[[list[str]], list[str]]) -> DataFrame:
    """Adds ``answer``, ``json`` and ``error`` to prompt rows."""
    return render.parse_answers(answers(prompts, client), "answer")


def stored_answers(prompts: DataFrame, path: str) -> DataFrame | None:
    """The table of answers (prompt_hash, answer) below ``path``, None while there is none."""
    spark = prompts.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema("prompt_hash string, answer string").parquet(path) if there else None


def annotate_once(prompts: DataFrame, client: Callable[[list[str]], list[str]], path: str) -> DataFrame:
    """``annotate`` with a table of answers by prompt hash below ``path``: only prompts without an answer there are asked, each different one once,
    and their answers are added when the job is over. Rows that got no answer are asked again by the next run."""
    keyed = prompts.withColumn("prompt_hash", F.sha2("prompt", 256))
    new = keyed.filter("prompt IS NOT NULL").select("prompt_hash", "prompt").dropDuplicates(["prompt_hash"])
    known = stored_answers(prompts, path)
    if known is not None:
        new = new.join(known, "prompt_hash", "left_anti")
    answers(new, client).filter("answer IS NOT NULL").select("prompt_hash", "answer").write.mode("append").parquet(path)
    found = stored_answers(prompts, path).dropDuplicates(["prompt_hash"])
    return render.parse_answers(keyed.join(found, "prompt_hash", "left").drop("prompt_hash"), "answer")
