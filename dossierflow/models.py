"""The seam to text models: a protocol, a deterministic stand-in, and what is made of replies.

A model is anything with `complete(prompt, system) -> str | None`. It is
called inside tasks, one instance per task, so calls spread over the cluster;
retries and the order of services are the client's business. Replies are
parsed with column expressions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierflow.functions import text as X
from dossierflow.functions.arrowmap import map_rows


class TextModel(Protocol):
    name: str

    def complete(self, prompt: str, system: str = "") -> str | None: ...


class EchoModel:
    """Answers column prompts with the first words of the section, as JSON or plain text; the same for the same prompt."""

    name = "echo"

    def complete(self, prompt: str, system: str = "") -> str | None:
        body = prompt.split("\n---\n", 1)[-1].strip()
        words = " ".join(body.split()[:6])
        if not words:
            return None
        digest = int(hashlib.sha1(prompt.encode()).hexdigest()[:4], 16)
        if digest % 17 == 0:
            return "no JSON here"
        return '{"value": "' + words.replace("\\", "").replace('"', "'") + '"}'


class FallbackModel:
    """Tries models in order; the first that answers wins and is named in the reply."""

    name = "fallback"

    def __init__(self, *models: TextModel):
        self.models = models

    def complete_named(self, prompt: str, system: str = "") -> tuple[str | None, str | None, bool]:
        for k, m in enumerate(self.models):
            try:
                reply = m.complete(prompt, system)
            except Exception:  # noqa: BLE001 - a service that fails is passed over
                reply = None
            if reply is not None:
                return reply, m.name, k > 0
        return None, None, False


REPLIES = "row_id long, prompt string, reply string, service_used string, fallback boolean, attempts int"


def is_chain(reply: str) -> bool:
    """Whether a reply without JSON reads as entity chains: every part between semicolons holds a pipe."""
    parts = [x for x in reply.split(";") if x.strip()]
    return bool(parts) and not reply.lstrip().startswith(("{", "[")) and all("|" in x for x in parts)


def run_prompts(prompts: DataFrame, model: Callable[[], FallbackModel], system: str = "", json_retries: int = 3) -> DataFrame:
    """Replies to (row_id, prompt); a reply with neither a JSON object nor chains is asked for again up to json_retries times."""

    def rows(m: FallbackModel, rid: int, prompt: str | None) -> Iterator[tuple]:
        reply, service, fell = None, None, False
        for attempt in range(1, json_retries + 2):
            suffix = "" if attempt == 1 else f"\nReturn JSON only. ({attempt})"
            reply, service, fell = m.complete_named((prompt or "") + suffix, system)
            if reply is None or "{" in reply or is_chain(reply):
                break
        yield rid, prompt, reply, service, fell, attempt

    return map_rows(prompts.select(F.col("row_id").cast("long"), "prompt"), rows, REPLIES, model)


def column_prompt(instruction: str, section: Column, text: Column) -> Column:
    return F.concat(F.lit(instruction + "\nSection: "), F.coalesce(section, F.lit("Untitled")), F.lit("\n---\n"), F.coalesce(text, F.lit("")))


def prompt_head(edited: Column, generated: Column) -> Column:
    """The text above the divider of an edited preview, else the generated one."""
    head = X.ustrip(F.split(F.coalesce(edited, F.lit("")), "\n---\n")[0])
    return F.when(head == "", generated).otherwise(head)


def column_jobs(sections: DataFrame, columns: dict[str, str], per_column: bool) -> DataFrame:
    """Prompts (row_id, column_name, prompt) of sections (row_id, heading, text): one for each column, or one for all of them (column_name null)."""
    if not per_column:
        ask = "Fill the columns and answer with one JSON object whose keys are their names.\n" + "\n".join(f"{c}: {i}" for c, i in columns.items())
        return sections.select("row_id", F.lit(None).cast("string").alias("column_name"), column_prompt(ask, F.col("heading"), F.col("text")).alias("prompt"))
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), column_prompt(i, F.col("heading"), F.col("text")).alias("prompt")) for c, i in columns.items()]))
    return sections.select("row_id", one.alias("j")).select("row_id", "j.column_name", "j.prompt")


def column_cells(replies: DataFrame, columns: list[str]) -> DataFrame:
    """(row_id, column_name, value) of replies (row_id, column_name, reply): one reply a column, or one object for all columns."""
    each = replies.where("column_name is not null").select("row_id", "column_name", cell_value(F.col("reply")).alias("value"))
    names = F.explode(F.array(*map(F.lit, columns))).alias("column_name")
    whole = replies.where("column_name is null").select("row_id", names, "reply")
    branches = F.lit(None).cast("string")
    for c in columns:
        branches = F.when(F.col("column_name") == c, cell_value(F.col("reply"), c)).otherwise(branches)
    return each.unionByName(whole.select("row_id", "column_name", branches.alias("value")))


def freeform(jobs: DataFrame, instruction: str, model: Callable[[], FallbackModel], directive: str = "", service: str = "", model_name: str = "", fmt: str = "text") -> DataFrame:
    """Replies to one instruction over sections (row_id, title, text), as they come; a call that fails says so.

    The requested service and model stay beside those that answered.
    """
    ask = f"{instruction}\n{directive}" if directive else instruction
    prompt = F.concat(F.lit(f"{ask}\n\n---\nSECTION: "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    replies = run_prompts(jobs.select("row_id", prompt.alias("prompt")), model, json_retries=0).select("row_id", "reply", "service_used", "fallback")
    out = jobs.select("row_id", "title").join(replies, "row_id")
    return out.select(
        "row_id", "title", F.lit(instruction).alias("instruction"), F.coalesce("reply", F.lit("[ERROR] no reply")).alias("response"), F.lit(service).alias("service"), F.lit(model_name).alias("model"), F.lit(fmt).alias("format"),
        F.coalesce("service_used", F.lit(service)).alias("service_used"), F.when(F.col("fallback"), "yes").otherwise("").alias("fallback"),
    )


def analyse_corpus(blocks: DataFrame, prompt: str, model: Callable[[], FallbackModel], system: str = "", name: str = "cross-document analysis") -> DataFrame:
    """One analysis over the blocks (doc_uuid, at, block, sections_used) of a prompt corpus: name, scope, prompt, result_text, service_used.

    The corpus is bounded by its budget of characters, so it is one row. No
    row comes out where there is no corpus or no answer.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "block"))), lambda b: b["block"])
    g = blocks.agg(F.array_join(parts, "\n").alias("corpus"), F.sum("sections_used").alias("n"), F.sort_array(F.collect_set("doc_uuid")).alias("documents"))
    g = g.where((X.ustrip(F.col("corpus")) != "") & (F.size("documents") > 0))
    full = F.concat(F.lit(f"{prompt}\n\n=== CORPUS ("), F.col("n").cast("string"), F.lit(" sections from "), F.size("documents").cast("string"), F.lit(" document(s)) ===\n"), F.col("corpus"))
    asked = g.select(F.lit(1).cast("long").alias("row_id"), full.alias("prompt"), F.to_json(F.struct("documents", F.col("n").alias("total_sections"))).alias("scope"))
    replies = run_prompts(asked.select("row_id", "prompt"), model, system, json_retries=0).where("reply is not null")
    return asked.select("row_id", "scope").join(replies.select("row_id", "reply", "service_used"), "row_id").select(F.lit(name).alias("name"), "scope", F.lit(prompt).alias("prompt"), F.col("reply").alias("result_text"), "service_used")


def cell_value(reply: Column, key: str = "value") -> Column:
    """The value under `key` of a reply's JSON object, chains as they are, failure marks otherwise."""
    body = X.json_object_in(reply)
    value = F.get_json_object(body, f"$['{key}']")
    return F.when(reply.isNull(), "[ERROR] no reply").when(X.looks_like_chain(reply), X.unfenced(reply)).when(body.isNotNull() & value.isNotNull(), value).otherwise(F.concat(F.lit("[unparsed] "), X.ustrip(reply)))


def toc_from_reply(reply: Column) -> Column:
    """Entries (title, page) of a reply that holds a JSON list; pages outside 1 to 9999 are dropped."""
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\[.*\]", 0)
    parsed = F.from_json(body, "array<struct<title:string,heading:string,name:string,page:string,page_number:string>>")
    page = lambda e: F.coalesce(e["page"], e["page_number"]).try_cast("int")
    return F.filter(F.transform(F.coalesce(parsed, F.array().cast("array<struct<title:string,heading:string,name:string,page:string,page_number:string>>")), lambda e: F.struct(X.ustrip(F.coalesce(e["title"], e["heading"], e["name"], F.lit(""))).alias("title"), F.when(page(e).between(1, 9999), page(e)).alias("page"))), lambda e: e["title"] != "")


def refined_headings(all_headings: DataFrame, chosen: DataFrame) -> DataFrame:
    """Headings a model chose, with the numbered ones it left out put back, in document order.

    `all_headings` has (doc_uuid, key, heading, first_pos), `chosen` (doc_uuid, key).
    """
    picked = chosen.select("doc_uuid", "key").distinct().withColumn("picked", F.lit(True))
    j = all_headings.join(picked, ["doc_uuid", "key"], "left")
    return j.where(F.col("picked") | X.is_numbered_heading(F.col("heading"))).select("doc_uuid", "key", "heading", "first_pos")


def hashed_vectors(texts: DataFrame, text: str, size: int = 32) -> DataFrame:
    """Vectors of distinct texts from a deterministic stand-in: signed counts of hashed words, unit length.

    Every distinct text is embedded once; join the result back on the text.
    """

    def rows(t: str) -> Iterator[tuple]:
        v = [0.0] * size
        for w in t.lower().split():
            h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            v[h % size] += 1.0 if h & 0x80000000 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        yield t, [x / n for x in v] if n else None

    return map_rows(texts.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct(), rows, "text string, vector array<double>")


def embed_with_ladder(texts: list[str], embed: Callable[[list[str]], list[list[float]]], batch: int = 10) -> dict[str, list[float]]:
    """Vectors by text: all at once, else in batches, else one by one; what still fails is left out."""
    todo = [t for t in dict.fromkeys(texts) if t and t.strip()]
    out: dict[str, list[float]] = {}

    def attempt(part: list[str]) -> bool:
        try:
            got = embed(part)
        except Exception:  # noqa: BLE001 - the next rung takes over
            return False
        if len(got) != len(part):
            return False
        out.update(zip(part, got))
        return True

    if todo and not attempt(todo):
        for i in range(0, len(todo), batch):
            part = todo[i : i + batch]
            if not attempt(part):
                for t in part:
                    attempt([t])
    return out


def halving(texts: list[str], embed: Callable[[list[str]], list[list[float]]]) -> list[list[float]]:
    """Vectors in order; a failing batch is halved until single texts fail."""
    try:
        got = embed(texts)
        if len(got) == len(texts):
            return got
    except Exception:
        if len(texts) == 1:
            raise
    if len(texts) == 1:
        raise ValueError("no vector for the text")
    mid = len(texts) // 2
    return halving(texts[:mid], embed) + halving(texts[mid:], embed)
