"""Model calls behind an interface, and what repairs their outputs.

A ``Provider`` serves embeddings, chat and judgements; ``Offline`` is deterministic
and needs nothing, so every operator that calls a model can be run and checked.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.scalars import fallback_summary, needs_translation, tail, without_manual_flag, without_reasoning


class Provider(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...
    def chat(self, prompts: list[str]) -> list[str | None]: ...
    def keep(self, questions: list[str], captions: list[str]) -> list[bool | None]: ...


class Offline:
    """Hashed words as an embedding, an echo as chat, shared words as a judge."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                out[i, int.from_bytes(h[:4], "big") % self.dimensions] += 1 if h[4] & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    def chat(self, prompts: list[str]) -> list[str | None]:
        return [(p or "").strip().split("\n")[-1][:500] or None for p in prompts]

    def keep(self, questions: list[str], captions: list[str]) -> list[bool | None]:
        return [bool({*(q or "").lower().split()} & {*(c or "").lower().split()}) for q, c in zip(questions, captions)]


def embed_column(text: Column, provider: Callable[[], Provider] = Offline) -> Column:
    """One call a batch; the provider is made once a worker."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = provider()
        for s in parts:
            yield pd.Series(list(p.embed(s.fillna("").tolist())))

    return run(text)


def chat_column(prompt: Column, provider: Callable[[], Provider] = Offline) -> Column:
    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = provider()
        for s in parts:
            yield pd.Series(p.chat(s.fillna("").tolist()), dtype=object)

    return run(prompt)


def table_summary(table: Column, context: Column, provider: Callable[[], Provider] | None = None) -> Column:
    """A model's summary, or the first 800 characters of the table."""
    raw = F.substring(F.coalesce(table, F.lit("")), 1, 800)
    return raw if provider is None else F.coalesce(chat_column(F.concat_ws("\n", context, table), provider), raw)


def relevant(rows: DataFrame, verdicts: DataFrame, keys: list[str], least: int = 0, group: str | None = None) -> DataFrame:
    """Rows judged relevant; a missing verdict keeps the row (a failed judge keeps all).

    With ``least`` and ``group``, a group is topped up by rank from the rejected rows.
    """
    both = rows.join(verdicts, keys, "left").withColumn("keep", F.coalesce("keep", F.lit(True)))
    if not least:
        return both.where("keep").drop("keep")
    w = Window.partitionBy(group).orderBy(F.desc("keep"), "rank")
    return both.withColumn("n", F.row_number().over(w)).where(F.col("keep") | (F.col("n") <= least)).drop("keep", "n")


_FENCED = re.compile(r"\s*```(?:json)?\s*(.*?)\s*(?:```\s*)?", re.DOTALL)
#: A whole string, the beginning of one that was cut, a bracket or a comma.
_MARK = re.compile(r'"(?:\\.|[^"\\])*(?:"|\Z|\\\Z)|[\[\]{},]', re.DOTALL)
_CLOSER = {"[": "]", "{": "}"}


def _owed(owed: str, mark: str) -> str:
    """The closing brackets owed after a mark, innermost first."""
    return _CLOSER[mark] + owed if mark in _CLOSER else owed[1:] if mark in ("]", "}") else owed


def tolerant_json(text: str | None, default=None):
    """Strict JSON, without a fence around it; else what can be read of JSON that was cut short.

    The marks of the text say at each comma and after each closing bracket which brackets are
    owed there; the last place where the text and these brackets are whole counts."""
    text = text or ""
    fenced = _FENCED.fullmatch(text)
    body = fenced[1] if fenced else text.strip()
    marks = list(_MARK.finditer(body))
    owed = list(accumulate((m[0] for m in marks), _owed, initial=""))[1:]
    ends = [body, *(body[: m.start() if m[0] == "," else m.end()] + o for m, o in zip(reversed(marks), reversed(owed)) if m[0] in ",]}")]
    for candidate in ends:
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    return default


def tolerant_json_column(text: Column) -> Column:
    """Repaired JSON as text, for from_json; NULL where nothing can be read."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        found = (tolerant_json(x) for x in s)
        return pd.Series([None if v is None else json.dumps(v, separators=(",", ":"), ensure_ascii=False) for v in found], dtype=object)

    return run(text)


def chat_json(prompt: Column, schema: str, provider: Callable[[], Provider] = Offline) -> Column:
    """A model's answer as a struct of ``schema``; NULL where it can't be read."""
    return F.from_json(tolerant_json_column(chat_column(prompt, provider)), schema)


def translated(rows: DataFrame, provider: Callable[[], Provider] = Offline) -> DataFrame:
    """rows(description, ...): Chinese names get an English one behind them, marked as such.

    Every distinct name is translated once; a name without a translation, or with one that is not
    English, stays as it is."""
    names = rows.where(needs_translation(F.col("description"))).select("description").distinct()
    found = names.withColumn("english", F.trim(chat_column(F.concat(F.lit("Translate this machine part name into English:\n"), "description"), provider)))
    found = found.where((F.col("english") != "") & ~needs_translation(F.col("english")))
    said = F.concat("description", F.lit(" (machine translation: "), "english", F.lit(")"))
    return rows.join(found, "description", "left").withColumn("description", F.coalesce(said, "description")).drop("english").select(rows.columns)


def named_codes(snippets: DataFrame, provider: Callable[[], Provider] = Offline, most: int = 12_000) -> DataFrame:
    """manual_id, code, name: what the texts around a manual's callouts say that they are.

    snippets(manual_id, code, nth, snippet) as of ``callouts.evidence``.  A manual is asked about in prompts of about ``most`` characters,
    a code's snippets in one of them.  A code without evidence gets no name, whatever the model says, and neither does one that
    the model leaves blank; a name that several prompts give is that of the code's own prompt."""
    line = F.struct("nth", F.concat(F.col("code"), F.lit(": "), F.col("snippet")).alias("line"))
    lines = snippets.groupBy("manual_id", "code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("lines"))
    w = Window.partitionBy("manual_id").orderBy("code").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("part", F.floor(F.coalesce(F.sum(F.length("lines") + 1).over(w), F.lit(0)) / most))
    asked = lines.groupBy("manual_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", "lines"))), lambda x: x["lines"]), "\n").alias("prompt"))
    said = asked.select("manual_id", "part", F.explode(F.from_json(tolerant_json_column(chat_column(F.col("prompt"), provider)), "map<string,string>")).alias("code", "name"))
    return said.where(F.trim(F.coalesce("name", F.lit(""))) != "").join(lines.select("manual_id", "part", "code"), ["manual_id", "part", "code"], "left_semi").select("manual_id", "code", F.trim("name").alias("name"))


def incident_summary(history: Column, symptom: Column, cause: Column, actions: Column, parts: Column, provider: Callable[[], Provider] | None = None) -> Column:
    """A summary of a fix for the archive: the model's, from the end of the conversation, else its fields in a line."""
    plain = fallback_summary(symptom, cause, actions, parts)
    if provider is None:
        return plain
    return F.coalesce(F.nullif(without_reasoning(chat_column(F.concat_ws("\n", plain, tail(history, 6000)), provider)), F.lit("")), plain)


def answers(contexts: DataFrame, provider: Callable[[], Provider] = Offline) -> DataFrame:
    """query_id, answer: one call a question over its context; contexts(query_id, query, context).

    The question is asked without its marks; reasoning is taken out; no answer is NULL."""
    prompt = F.concat_ws("\n\n", "context", F.concat(F.lit("QUESTION: "), without_manual_flag(F.col("query"))))
    return contexts.select("query_id", without_reasoning(chat_column(prompt, provider)).alias("answer"))
