"""Planning and judging by a model behind a function from prompt to reply, with replies checked and broken batches split."""

from __future__ import annotations

import datetime
import json
import re
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.records import or_else

#: Takes a prompt and returns the model's reply. It runs on executors; one that raises counts as an empty reply.
Model = Callable[[str], str]

#: Default prompts. Names in braces are replaced: question, most, context (prior evidence), papers, today_date and today_year; so may those of a prompt of one's own be.
PLAN_PROMPT = "Write search queries for this question as JSON, {{\"queries\": [...]}}, {most} at most.\n\n{question}{context}".replace("{{", "{").replace("}}", "}")
STRICT = "Return valid JSON and nothing else.\n\n"
JUDGE_PROMPT = "Cite the ids of all sentences that help to answer the question, best first, as JSON, {\"relevant_ids\": [...]}.\n\nQuestion: {question}\n\nPapers:\n{papers}"


def filled(template: str, **values: str) -> str:
    """The template with each {name} replaced by its value, all at once: braces in values stay."""
    return re.sub(r"\{(\w+)\}", lambda m: values.get(m[1], m[0]), template)


def listed(reply: str | None, key: str) -> list[str] | None:
    """The list under key in a reply that is a JSON object: fenced, wrapped in prose or plain; None if there is no such list."""
    bare = re.sub(r"^```(?:json)?|```$", "", (reply or "").strip()).strip()
    for text in (bare, *re.findall(r"\{.*\}", bare, re.DOTALL)[:1]):
        try:
            found = json.loads(text)
        except ValueError:
            continue
        found = found.get(key) if isinstance(found, dict) else None
        if isinstance(found, list):
            return [str(x) for x in found]
    return None


def cited_ids(reply: str | None) -> list[str] | None:
    return listed(reply, "relevant_ids")


class Retrying:
    """A model that is asked again when it raises, after waits that double; the last error is raised."""

    def __init__(self, model: Model, attempts: int = 6, wait: float = 1.0, most: float = 60.0):
        self.model, self.attempts, self.wait, self.most = model, attempts, wait, most

    def __call__(self, prompt: str) -> str:
        for k in range(self.attempts):
            try:
                return self.model(prompt)
            except Exception:  # noqa: BLE001 - whatever a model raises may pass
                if k + 1 == self.attempts:
                    raise
                time.sleep(min(self.wait * 2**k, self.most))
        raise ValueError("no attempts")


def _reply(model: Model, prompt: str, failures: Accumulator | None = None) -> str:
    try:
        return model(prompt)
    except Exception:  # noqa: BLE001 - whatever a model raises must not end the job
        if failures is not None:
            failures.add(1)
        return ""


def _dated(template: str, today: datetime.date | None = None) -> str:
    today = today or datetime.datetime.now(datetime.UTC).date()
    return filled(template, today_date=today.isoformat(), today_year=str(today.year))


def plan(model: Model, question: str, most: int, template: str = PLAN_PROMPT, prior: Sequence[str] = (), failures: Accumulator | None = None) -> list[str]:
    """The model's queries, trimmed, each once. A reply without any is asked for again strictly; the question itself is the last resort.

    prior is evidence that is there already; the prompt lists it.
    """
    context = "\n\nEvidence already gathered:\n" + "\n".join(f"- {x}" for x in prior) if prior else ""
    prompt = filled(_dated(template), question=question, most=str(most), context=context)
    queries = listed(_reply(model, prompt, failures), "queries") or listed(_reply(model, STRICT + prompt, failures), "queries") or [question]
    return [q for q in dict.fromkeys(q.strip() for q in queries) if q][:most]


def model_queries(questions: DataFrame, model: Model, most: int, template: str = PLAN_PROMPT, failures: Accumulator | None = None) -> DataFrame:
    """(question_id, query_idx, text) of questions (question_id, text[, prior: array<string>]): see plan()."""
    kind = questions.schema["question_id"].dataType.simpleString()
    prior = F.col("prior") if "prior" in questions.columns else F.array().cast("array<string>").alias("prior")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, q) for i, text, known in zip(f.question_id, f.text, f.prior) for k, q in enumerate(plan(model, text or "", most, template, [] if known is None else [*known], failures))]
            yield pd.DataFrame(rows, columns=["question_id", "query_idx", "text"])

    return questions.select("question_id", "text", prior).mapInPandas(run, f"question_id {kind}, query_idx int, text string")


def ask(model: Model, papers: list[dict], question: str = "", template: str = "{papers}", depth: int = 0, failures: Accumulator | None = None) -> list[str]:
    """The ids that the model cites. A reply without a list splits a batch in two, twice at most, and is empty then."""
    found = cited_ids(_reply(model, filled(_dated(template), question=question, papers=json.dumps(papers, ensure_ascii=False)), failures))
    if found is not None:
        return found
    if len(papers) < 2 or depth >= 2:
        return []
    middle = len(papers) // 2
    return ask(model, papers[:middle], question, template, depth + 1, failures) + ask(model, papers[middle:], question, template, depth + 1, failures)


def judge_batches(items: DataFrame, model: Model, template: str = "{papers}", failures: Accumulator | None = None) -> DataFrame:
    """(question_id, batch, pos, sid) in the judge's order, of items (question_id, batch, cand_pos, paper[, question]) with papers as JSON; one call a batch, batches side by side."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cand_pos")
        question = str(group.question.iloc[0]) if "question" in group else ""
        ids = ask(model, [json.loads(p) for p in group.paper], question, template, 0, failures)
        return pd.DataFrame({"question_id": group.question_id.iloc[0], "batch": int(group.batch.iloc[0]), "pos": range(len(ids)), "sid": ids}).astype({"pos": "int64", "sid": "object"})

    kind = items.schema["question_id"].dataType.simpleString()
    return items.groupBy("question_id", "batch").applyInPandas(run, f"question_id {kind}, batch long, pos long, sid string")


def payloads(papers: DataFrame, sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, paper): a paper as JSON for a judge, with its sentences (key, sent_idx, sid, sentence) in order; what is missing reads N/A."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "sid", "sentence"))), lambda s: F.struct(s["sid"].alias("id"), s["sentence"].alias("text")))
    listed = sentences.groupBy(key).agg(items.alias("items"))
    given = lambda c: (or_else(F.col(c), F.lit("N/A")) if c in papers.columns else F.lit("N/A")).alias(c)
    none = F.array().cast("array<struct<id:string,text:string>>")
    body = F.struct(F.col("paper_id").alias("id"), *map(given, ["title", "authors", "affiliations", "journal", "year"]), F.coalesce("items", none).alias("abstract"))
    return papers.join(listed, key, "left").select(key, F.to_json(body).alias("paper"))


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """The template with each {name} replaced by its value."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template
