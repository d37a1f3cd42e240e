"""Language-model judges of retrieved contexts, as plug-ins: a model is any function of (system, user) to text."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODELS = {"openai": "gpt-4o-mini", "ollama": "llama3.2"}
SYSTEM = "You judge retrieval. Answer with JSON only."
PRECISION = 'Question: {question}\nAnswer: {truth}\nContext: {context}\nDoes the context help to give the answer? {{"useful": 0 or 1}}'
RECALL = 'Answer: {truth}\nContexts:\n{contexts}\nWhich share of the answer\'s statements do the contexts support? {{"share": number from 0 to 1}}'


class HttpModel:
    """A chat service: OpenAI's form of request and answer, which others take too."""

    def __init__(self, url: str, model: str, api_key: str | None = None, timeout: float = 120):
        self.url, self.model, self.api_key, self.timeout = url, model, api_key, timeout

    def __call__(self, system: str, user: str) -> str:
        body = {"model": self.model, "temperature": 0, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        with urlopen(Request(self.url, json.dumps(body).encode(), headers), timeout=self.timeout) as answer:
            return json.load(answer)["choices"][0]["message"]["content"]


def _answers(url: str) -> bool:
    try:
        with urlopen(url, timeout=2) as r:
            return r.status == 200
    except OSError:
        return False


def choose_model(provider: str = "auto", model: str | None = None, api_key: str | None = None, probe: Callable[[str], bool] = _answers) -> HttpModel | None:
    """The model to judge with: ``auto`` is OpenAI where there is a key, else a local Ollama that answers, else None; an unknown provider raises ValueError."""
    key = api_key or os.environ.get("OPENAI_API_KEY")
    if provider == "auto":
        provider = "openai" if key else "ollama" if probe("http://localhost:11434/api/tags") else ""
    if provider == "openai":
        return HttpModel("https://api.openai.com/v1/chat/completions", model or MODELS["openai"], key)
    if provider == "ollama":
        return HttpModel("http://localhost:11434/v1/chat/completions", model or MODELS["ollama"])
    if provider:
        raise ValueError(f"unknown provider: {provider}")
    return None


def _number(answer: str, name: str) -> float:
    return min(1.0, max(0.0, float(json.loads(answer[answer.index("{") : answer.rindex("}") + 1])[name])))


def precision_of(useful: list[float]) -> float:
    """Mean precision at the ranks of useful contexts; 0 without one."""
    hits, total = 0.0, 0.0
    for k, u in enumerate(useful):
        hits += u
        total += u * hits / (k + 1)
    return total / hits if hits else 0.0


def judge(dataset: DataFrame, model: Callable[[str, str], str] | None, sample_size: int = 20) -> DataFrame:
    """(qid, context_precision, context_recall, error) of the first ``sample_size`` questions by id (0: all) of (qid, question, ground_truth, contexts).

    Without a model, or where an answer can't be read, the scores are null and error says why.
    """
    rows = dataset.orderBy("qid").limit(sample_size) if sample_size else dataset

    def one(question: str, truth: str, contexts: list[str]) -> tuple[float | None, float | None, str | None]:
        if model is None:
            return None, None, "no language model"
        try:
            useful = [_number(model(SYSTEM, PRECISION.format(question=question, truth=truth, context=c)), "useful") for c in contexts]
            return precision_of(useful), _number(model(SYSTEM, RECALL.format(truth=truth, contexts="\n---\n".join(contexts))), "share"), None
        except Exception as e:
            return None, None, f"{type(e).__name__}: {e}"[:300]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            scores = [one(q, t, list(c)) for q, t, c in zip(f["question"], f["ground_truth"], f["contexts"], strict=True)]
            yield pd.DataFrame({"qid": f["qid"], **{name: [s[k] for s in scores] for k, name in enumerate(("context_precision", "context_recall", "error"))}})

    return rows.select("qid", "question", "ground_truth", "contexts").mapInPandas(run, "qid string, context_precision double, context_recall double, error string")


def summary(judged: DataFrame) -> DataFrame:
    """Means over the questions that were judged, and how many were not."""
    return judged.agg(*(F.round(F.avg(c), 6).alias(c) for c in ("context_precision", "context_recall")), F.count("error").alias("n_errors"), F.count("*").alias("n"))
