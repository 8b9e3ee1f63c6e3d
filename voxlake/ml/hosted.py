"""Hosted models: what is sent, how often, and what of the replies is taken.

The service itself is a function that is given (text or bytes to text); the rest is here: prompts, retries, repair of replies with labels
that do not exist, and defaults for what fails. Calls run in the tasks, one after another within each.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a call without a transcript has.
EMPTY_TRANSCRIPT = json.dumps({"metadata": {"duration": 0.0, "channels": 1}, "results": {"channels": [{"alternatives": [{"transcript": "", "confidence": 0.0, "paragraphs": {"paragraphs": []}}]}]}})
LEAST_BYTES = 4000


def attempted(service: Callable, request, tries: int, good: Callable[[str], bool] = bool) -> str | None:
    """The first good reply; after ``tries`` failures or bad replies the last bad one, None if all failed."""
    last = None
    for _ in range(tries):
        try:
            reply = service(request)
        except Exception:  # noqa: BLE001  a service may fail in any way
            continue
        if good(reply):
            return reply
        last = reply
    return last


def call_text(text: str = "text", order: str = "turn", speaker: str = "role") -> Column:
    """A call's sentences as a block of "speaker: text" lines, in order."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.concat_ws(": ", speaker, text).alias("t"))))
    return F.array_join(F.transform(lines, lambda x: x.t), "\n")


def prompts(calls: DataFrame, key: str, *, instructions: str, labels: Sequence[str], **columns: str) -> DataFrame:
    """key, prompt: the instructions, the labels that are allowed, then the call."""
    head = f"{instructions}\nLabels: {', '.join(labels)}\n\n"
    return calls.groupBy(key).agg(F.concat(F.lit(head), call_text(**columns)).alias("prompt"))


def labelled(prompts: DataFrame, key: str, service: Callable[[str], str], labels: Sequence[str], *, repairs: int = 2) -> DataFrame:
    """key, line, text, label, seconds of each reply's tab-separated lines.

    A reply with a label that is not allowed is sent back with the labels that are, at most ``repairs`` times; what is still wrong then, or has no three
    fields, has a null label. A call without a reply has one row of nulls.
    """
    allowed = {x.upper(): x for x in labels}

    def rows(reply: str | None) -> list[tuple[str, str | None, str | None]]:
        parts = [x.split("\t") for x in (reply or "").splitlines() if x.strip()]
        return [(p[0], allowed.get(p[1].strip().upper()) if len(p) == 3 else None, p[2].strip() if len(p) == 3 else None) for p in parts]

    def ask(prompt: str) -> list[tuple]:
        found = rows(attempted(service, prompt, 3))
        for _ in range(repairs):
            if found and all(label for _, label, _ in found):
                break
            again = attempted(service, f"Use only these labels: {', '.join(labels)}\nKeep texts and times. Your reply was:\n" + "\n".join("\t".join(x or "" for x in r) for r in found), 1)
            found = rows(again) or found
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prompt = batch.column(0), batch.column(1).to_pylist()
            at, out = [], []
            for k, p in enumerate(prompt):
                for n, r in enumerate(ask(p or "") or [(None, None, None)]):
                    at.append(k)
                    out.append((n, *r))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *(pa.array([r[j] for r in out], kind) for j, kind in enumerate((pa.int32(), pa.string(), pa.string(), pa.string())))], names=[key, "line", "text", "label", "time"])

    return prompts.select(key, "prompt").mapInArrow(run, f"`{key}` {prompts.schema[key].dataType.simpleString()}, line int, text string, label string, time string")


def transcribed(files: DataFrame, key: str, content: str, service: Callable[[bytes], str], *, tries: int = 3, least: int = LEAST_BYTES) -> DataFrame:
    """key, json, status: the service's transcript of each file.

    A call is tried up to ``tries`` times, and all over once more if its transcript has under ``least`` bytes ("short", if it still has). One that never comes, or is no JSON object,
    is the empty transcript ("default").
    """

    def one(audio: bytes | None) -> tuple[str, str]:
        long = lambda t: t is not None and len(t.encode()) >= least
        reply = attempted(service, audio or b"", tries)
        if not long(reply):
            reply = attempted(service, audio or b"", tries) or reply
        try:
            if not isinstance(json.loads(reply or ""), dict):
                raise ValueError("no object")
        except ValueError:
            return EMPTY_TRANSCRIPT, "default"
        return reply, "whole" if long(reply) else "short"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [one(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([s for _, s in out], pa.string())], names=[key, "json", "status"])

    return files.select(key, content).mapInArrow(run, f"`{key}` {files.schema[key].dataType.simpleString()}, json string, status string")
