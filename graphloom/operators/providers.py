"""Outside language models, injected as callables: extraction, intents, answers; with retries. Nothing here opens a connection."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import INTENT, KG_DOCUMENT

#: Seconds from which pauses are counted.
BASE_DELAY = 2.0
TRIES = 3


class RateLimited(Exception):
    """The service asks to come back later."""


class ServiceError(Exception):
    """The service failed."""


def patiently(call: Callable[[], Any], tries: int = TRIES, base: float = BASE_DELAY, sleep: Callable[[float], None] = time.sleep) -> Any:
    """What ``call`` returns, tried up to ``tries`` times.

    After RateLimited the pause doubles each time (base * 2, * 4, ...), after ServiceError it grows by base, after a reply that is no
    JSON (ValueError) the next try follows at once. The last failure is raised; other exceptions are raised as they come.
    """
    for n in range(1, tries + 1):
        try:
            return call()
        except RateLimited:
            if n == tries:
                raise
            sleep(base * 2**n)
        except ServiceError:
            if n == tries:
                raise
            sleep(base * n)
        except ValueError:
            if n == tries:
                raise
    raise ValueError("tries must be at least 1")


def _object(text: str) -> dict:
    got = json.loads(text)
    if not isinstance(got, dict):
        raise ValueError("no JSON object")
    return got


def _asked(df: DataFrame, cols: list[str], out: str, provider: Callable[..., str], check: Callable[[str], Any], tries: int) -> DataFrame:
    """df's key (the first of cols) with the provider's reply as text and, where it failed to the end, why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said, why = [], []
            for row in pdf[cols].itertuples(index=False):

                def once(row=row):
                    text = provider(*row[1:])
                    check(text)
                    return text

                try:
                    said.append(patiently(once, tries))
                    why.append(None)
                except (RateLimited, ServiceError, ValueError) as e:
                    said.append(None)
                    why.append(type(e).__name__)
            yield pdf[[cols[0]]].assign(**{out: said, "failure": why})

    kind = df.schema[cols[0]].dataType.simpleString()
    return df.select(*cols).mapInPandas(run, f"{cols[0]} {kind}, {out} string, failure string")


def extract(docs: DataFrame, provider: Callable[[str, str], str], tries: int = TRIES) -> DataFrame:
    """(doc_id, nodes, relationships, failure) from provider(doctype, text), which returns a JSON object; one row per document (doc_id, doctype, text)."""
    said = _asked(docs, ["doc_id", "doctype", "text"], "reply", provider, _object, tries)
    return said.withColumn("d", F.from_json("reply", KG_DOCUMENT)).select("doc_id", "d.nodes", "d.relationships", "failure")


def read_intents(questions: DataFrame, provider: Callable[[str], str], tries: int = TRIES) -> DataFrame:
    """(query_id, intent, failure) from provider(question), which returns a JSON object; missing fields are empty, UNKNOWN and false."""
    said = _asked(questions, ["query_id", "query"], "reply", provider, _object, tries).withColumn("i", F.from_json("reply", INTENT))
    none = F.expr("cast(array() as array<string>)")
    lists = [F.coalesce(F.col(f"i.{f}"), none).alias(f) for f in ("keywords", "mentioned_labels")]
    intent = F.struct(*lists, F.coalesce("i.asked_label", F.lit("UNKNOWN")).alias("asked_label"), F.coalesce("i.negated_keywords", none).alias("negated_keywords"), F.coalesce("i.is_comparison", F.lit(False)).alias("is_comparison"))
    return said.select("query_id", intent.alias("intent"), "failure")


def answer(prompts: DataFrame, provider: Callable[[str, str], str], tries: int = TRIES) -> DataFrame:
    """prompts with generated_answer from provider(question, context); null where it failed to the end."""
    said = _asked(prompts, ["query_id", "query", "context"], "generated_answer", provider, lambda text: None, tries)
    return prompts.drop("generated_answer").join(said.drop("failure"), "query_id", "left")
