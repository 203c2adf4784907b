"""Language-model assistance as a provider: optional, off by default, and never an error."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship


class Provider(Protocol):
    """Answers a task's batch of rows, as many dictionaries; may raise, which counts as no answer."""

    def answer(self, task: str, rows: list[dict]) -> list[dict]: ...


class NullProvider:
    """Knows nothing: the deterministic configuration."""

    def answer(self, task: str, rows: list[dict]) -> list[dict]:
        return [{} for _ in rows]


#: Tasks, and the columns that their answers have.
TASKS = {
    "classify_pages": "label string, deviz_cod string",
    "resolve_partial": "deviz_cod string",
    "section_names": "ref_name string",
    "fuzzy_items": "of_seq long, score double",
    "categories": "category string",
    "component_format": "format string",
    "extract_items": "items string",
}


class Ledger:
    """Answers by the hash of what was asked, as files in a folder that all tasks share: a question is asked once.

    A task claims a question before it asks. Another that meets the claim, such as a doubled task, waits for the answer;
    a claim that was left for longer than `patience` seconds, as by a killed task, is taken over.
    """

    def __init__(self, folder: str, patience: float = 120.0):
        self.folder, self.patience = folder.rstrip("/"), patience

    @staticmethod
    def key(task: str, rows: list[dict]) -> str:
        return hashlib.sha256(json.dumps([task, rows], sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()

    def _place(self, name: str):
        from pyarrow import fs

        uri = f"{self.folder}/{name}"
        return (fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")) if uri.startswith(("file:", "/")) else fs.FileSystem.from_uri(uri)

    def get(self, key: str) -> list[dict] | None:
        fs, path = self._place(key + ".json")
        if not fs.get_file_info(path).is_file:
            return None
        with fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def put(self, key: str, answers: list[dict]) -> None:
        fs, path = self._place(key + ".json")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        own = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as f:
            f.write(json.dumps(answers, ensure_ascii=False, default=str).encode())
        fs.move(own, path)

    def claim(self, key: str) -> bool:
        """Whether this task may ask; exact on file systems that the workers see as local, else as exact as a look before the write."""
        fs, path = self._place(key + ".claim")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        if fs.type_name == "local":
            try:
                os.close(os.open(path, os.O_CREAT | os.O_EXCL))
                return True
            except FileExistsError:
                pass
        elif not fs.get_file_info(path).is_file:
            fs.open_output_stream(path).close()
            return True
        left = fs.get_file_info(path).mtime_ns
        if left is not None and time.time() - left / 1e9 > self.patience:
            fs.delete_file(path)
            return self.claim(key)
        return False

    def release(self, key: str) -> None:
        fs, path = self._place(key + ".claim")
        fs.delete_file(path)


def asked(who: Provider, task: str, rows: list[dict], ledger: Ledger | None) -> list[dict]:
    """The provider's answers to a batch, none where it fails; from the ledger where it was asked before. Failures are not kept."""
    key = ledger.key(task, rows) if ledger else ""
    while ledger:
        known = ledger.get(key)
        if known is not None:
            return known
        if ledger.claim(key):
            break
        time.sleep(0.05)
    try:
        got = [dict(x) for x in who.answer(task, rows)]
    except Exception:  # noqa: BLE001 - a provider's failure is no answer
        if ledger:
            ledger.release(key)
        return []
    if ledger:
        ledger.put(key, got)
    return got


def ask(rows: DataFrame, task: str, provider: Provider | None = None, batch: int = 50, ledger: Ledger | None = None, calls: int = 8) -> DataFrame:
    """rows with the provider's answers to a task, null where it has none. Batches of 50 rows a call; failures answer nothing.

    A task has `calls` calls under way at a time. With a ledger, what a lost, retried or doubled task has been told is not
    asked again; give the rows of a batch a stable order, as from a staged table, for then batches are equal too.
    """
    ship(rows.sparkSession)
    answers = TASKS[task]
    names = [c.split(" ")[0] for c in answers.split(", ")]
    source, who = rows, provider or NullProvider()
    ledger = ledger or getattr(who, "ledger", None)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields) + ", " + ", ".join(f"answer_{c}" for c in answers.split(", "))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(calls) as pool:
            for p in parts:
                batches = [p.iloc[a : a + batch] for a in range(0, len(p), batch)]
                for q, got in zip(batches, pool.map(lambda q: asked(who, task, q.to_dict("records"), ledger), batches)):
                    got = [*got, *[{}] * (len(q) - len(got))][: len(q)]
                    yield q.assign(**{f"answer_{n}": [g.get(n) for g in got] for n in names})

    return source.mapInPandas(run, schema)


class JsonClient:
    """A provider over a chat function (model, messages, temperature) -> reply text: rows go out as JSON, the JSON object in the reply comes back.

    The reply's `rows` are the answers, in the order of the batch; what is no JSON is no answer.
    """

    def __init__(self, chat, model: str = "", instructions: dict[str, str] | None = None):
        self.chat, self.model, self.instructions = chat, model, instructions or {}

    def answer(self, task: str, rows: list[dict]) -> list[dict]:
        system = f"{self.instructions.get(task, task)}\nAnswer with one JSON object {{\"rows\": [...]}} with an object of the fields {TASKS[task]} for each row, in order."
        reply = self.chat(self.model, [{"role": "system", "content": system}, {"role": "user", "content": json.dumps(rows, ensure_ascii=False, default=str)}], 0.0)
        return reply_object(reply).get("rows", [])


def reply_object(reply: str) -> dict:
    """The JSON object in a free-text reply: the whole of it, a fenced block, or the outermost braces; empty otherwise."""
    fenced, braced = re.search(r"(?s)```(?:json)?\s*(.*?)```", reply or ""), re.search(r"(?s)\{.*\}", reply or "")
    for text in (reply, fenced and fenced[1], braced and braced[0]):
        try:
            found = json.loads(text or "")
        except json.JSONDecodeError:
            continue
        if isinstance(found, dict):
            return found
    return {}


def section_names(names: DataFrame, provider: Provider | None = None) -> DataFrame:
    """offer_name and ref_name of section names (offer_name) that no rule mapped, as far as the provider knows them."""
    return ask(names.select("offer_name").distinct(), "section_names", provider).filter("answer_ref_name is not null").select("offer_name", F.col("answer_ref_name").alias("ref_name"))


def categories(items: DataFrame, provider: Provider | None = None) -> DataFrame:
    """items with the category that the provider gives their description, null without."""
    d = ask(items.select("denumire").distinct(), "categories", provider).select("denumire", F.col("answer_category").alias("category"))
    return items.join(d, "denumire", "left")


def formats(docs: DataFrame, provider: Provider | None = None) -> DataFrame:
    """docs (doc_id, text, format) whose format no pattern showed take the provider's."""
    q = docs.filter("format = 'UNKNOWN'")
    told = ask(q.select("doc_id", "text"), "component_format", provider).select("doc_id", F.col("answer_format").alias("__f"))
    return docs.join(told, "doc_id", "left").withColumn("format", F.coalesce("__f", "format")).drop("__f")


def extracted(texts: DataFrame, provider: Provider | None = None, most: int = 12_000) -> DataFrame:
    """doc_id, chunk and the fields of each item that the provider reads from texts, chunk by chunk."""
    told = ask(chunks(texts, most), "extract_items", provider).filter("answer_items is not null")
    item = "array<struct<cod:string,denumire:string,um:string,cantitate:double,is_component:boolean>>"
    return told.select("doc_id", "chunk", F.inline(F.from_json("answer_items", item)))


def drop_found(components: DataFrame, items: DataFrame) -> DataFrame:
    """Components of rules but for those (doc_id, code, quantity) that the provider's items have."""
    key = ["doc_id", "cod", "cantitate"]
    return components.join(items.select(*key).distinct(), key, "left_anti")


def resolve_partial(pages: DataFrame, provider: Provider | None = None) -> DataFrame:
    """Partial section keys resolved by the provider over distinct (object, category) pairs, and by the first-word rule where it has no answer."""
    from .pages import PARTIAL, partial_fallback

    q = pages.filter(F.col("deviz_cod").startswith(PARTIAL)).select("deviz_cod").distinct()
    a = ask(q, "resolve_partial", provider).filter("answer_deviz_cod is not null")
    out = pages.join(a, "deviz_cod", "left").withColumn("extraction_method", F.when(F.col("answer_deviz_cod").isNotNull(), "partial_resolved").otherwise(F.col("extraction_method"))).withColumn("deviz_cod", F.coalesce("answer_deviz_cod", "deviz_cod")).drop("answer_deviz_cod")
    return partial_fallback(out)


def chunks(texts: DataFrame, most: int = 12_000) -> DataFrame:
    """doc_id, chunk and text: texts cut at line ends into chunks of at most so many characters (a longer line is a chunk)."""
    w = F.expr(
        f"aggregate(split(text, '\\n'), cast(array() as array<string>), (a, x) -> CASE WHEN size(a) > 0 AND length(element_at(a, -1)) + length(x) + 1 <= {most} "
        "THEN concat(slice(a, 1, size(a) - 1), array(concat(element_at(a, -1), '\\n', x))) ELSE concat(a, array(x)) END)"
    )
    return texts.select("doc_id", F.posexplode(w).alias("chunk", "text"))
