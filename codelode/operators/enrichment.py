"""Enrichment by models: embeddings, file summaries and intents of chunks, through providers.

A provider is any object with the methods of ``Offline``; it is created in the tasks. ``Offline`` needs no service and is
deterministic; ``Http`` speaks the common JSON protocol of embedding and chat services.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelode.functions.columns import INTENTS

BATCH, CHUNK_CHARS, FILE_CHARS = 8, 500, 3000
_HINTS = {
    "testing": "test spec mock assert fixture", "authentication": "login password token session credential", "authorization": "permission role policy grant access", "data_access": "query select insert table repository",
    "data_model": "schema model entity field struct", "api_endpoint": "route request response endpoint handler", "ui_component": "render view button component style", "configuration": "config setting option env",
    "error_handling": "error exception retry catch fail", "logging": "log info debug trace print", "integration": "client import require http queue", "business_logic": "order invoice price rule process",
}


class Offline:
    """Feature hashing for vectors, word hints for intents."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for i, t in enumerate(texts):
            for w in re.findall(r"[A-Za-z]+|\d+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dimensions] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()

    def classify(self, chunks: list[str]) -> list[tuple[str, str]]:
        out = []
        for c in chunks:
            words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", c).lower()))
            best = max(_HINTS, key=lambda k: len(words & set(_HINTS[k].split())))
            out.append((best if words & set(_HINTS[best].split()) else "utility", ""))
        return out

    def analyze(self, text: str, path: str) -> tuple[str, str]:
        first = next((x.strip(" #/*\"'") for x in text.split("\n") if x.strip(" #/*\"'")), "")
        return first[:120], "test suite" if "test" in path.lower() else "unknown"


class ContextTooLong(Exception):
    """The service says the input exceeds its context."""


class Http:
    """A service with /embeddings and /chat/completions; ``post`` can be replaced in tests."""

    def __init__(self, url: str, model: str, dimensions: int, key: str = "", context_length: int = 8192, post: Callable[[str, dict, dict], dict] | None = None):
        self.url, self.model, self.dimensions, self.key, self.context_length = url.rstrip("/"), model, dimensions, key, context_length
        self._post = post or self._send

    def _headers(self) -> dict:
        return {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})

    def _send(self, url: str, body: dict, headers: dict) -> dict:
        from urllib.error import HTTPError, URLError
        from urllib.request import Request, urlopen

        try:
            with urlopen(Request(url, json.dumps(body).encode(), headers), timeout=60) as r:
                return json.loads(r.read())
        except HTTPError as e:
            text = e.read().decode("utf-8", "replace")
            if e.code == 400 and "exceeds the context length" in text:
                raise ContextTooLong(text) from e
            raise RuntimeError(f"{url} ({self.model}): {e.code} {text[:200]}") from e
        except (URLError, TimeoutError) as e:
            raise RuntimeError(f"{url} ({self.model}): {e}") from e

    def embed(self, texts: list[str]) -> list[list[float]]:
        """Vectors in the order of the texts; texts are halved while the service finds them too long."""
        texts = [t[: 4 * self.context_length] for t in texts]
        while True:
            try:
                data = self._post(f"{self.url}/embeddings", {"model": self.model, "input": texts}, self._headers())["data"]
                break
            except ContextTooLong:
                if max(map(len, texts)) < 2:
                    raise
                texts = [t[: max(1, len(t) // 2)] for t in texts]
        out = [d["embedding"] for d in sorted(data, key=lambda d: d.get("index", 0))]
        for v in out:
            if len(v) != self.dimensions:
                raise ValueError(f"expected {self.dimensions} numbers, got {len(v)}")
        return out

    def _chat(self, prompt: str) -> str:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": 0}
        return self._post(f"{self.url}/chat/completions", body, self._headers())["choices"][0]["message"]["content"]

    def classify(self, chunks: list[str]) -> list[tuple[str, str]]:
        listing = "\n\n".join(f"[{i + 1}]\n{c}" for i, c in enumerate(chunks))
        answer = parse_json(self._chat(f"For each code section give intent (one of {', '.join(INTENTS)}) and a short description as a JSON list of objects.\n\n{listing}"))
        return repair(answer, len(chunks))

    def analyze(self, text: str, path: str) -> tuple[str, str]:
        answer = parse_json(self._chat(f"Summarise this file in one sentence and name its role, as a JSON object with summary and role.\n\n{path}\n{text}"))
        return (str(answer.get("summary", "")), str(answer.get("role", "unknown"))) if isinstance(answer, dict) else ("", "unknown")


def parse_json(text: str):
    """JSON from an answer, fences around it removed; None if there is none."""
    bare = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text or "")
    try:
        return json.loads(bare)
    except ValueError:
        return None


def unfenced(text: Column) -> Column:
    """The same removal of fences for a column, before ``from_json``."""
    return F.regexp_replace(text, r"^\s*```(?:json)?\s*|\s*```\s*$", "")


def repair(answer, n: int) -> list[tuple[str, str]]:
    """An answer made to fit: unknown intents become utility, missing ones are filled up."""
    items = answer if isinstance(answer, list) else []
    out = []
    for x in items[:n]:
        intent = x.get("intent") if isinstance(x, dict) else None
        out.append((intent if intent in INTENTS else "utility", str(x.get("description", "")) if isinstance(x, dict) else ""))
    return out + [("utility", "")] * (n - len(out))


def file_text(path: Column, summary: Column) -> Column:
    return F.concat_ws("\n", path, F.coalesce(summary, F.lit("")))


def chunk_input(path: Column, content: Column) -> Column:
    return F.concat(F.lit("# "), path, F.lit("\n"), content)


def symbol_text(kind: Column, name: Column, docstring: Column) -> Column:
    return F.concat(kind, F.lit(" "), name, F.lit(": "), F.coalesce(docstring, F.lit("")))


def _with(df: DataFrame, **columns: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(k, v) for k, v in columns.items()]])


def embed(df: DataFrame, text: str, provider: Callable[[], object] = Offline, batch: int = 64, context_length: int = 8192) -> DataFrame:
    """``df`` with an ``embedding`` of the text, in batches per task; null text gives null."""
    schema = _with(df, embedding=T.ArrayType(T.FloatType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for pdf in batches:
            out: list = [None] * len(pdf)
            at = [i for i, t in enumerate(pdf[text]) if isinstance(t, str)]
            for k in range(0, len(at), batch):
                part = at[k : k + batch]
                for i, v in zip(part, model.embed([pdf[text].iloc[i][: 4 * context_length] for i in part])):
                    out[i] = v
            yield pdf.assign(embedding=out)

    return df.mapInPandas(run, schema)


def embed_query(text: str, provider: Callable[[], object] = Offline) -> list[float]:
    """The vector of one question, by the same provider as the index's; a blank question has none."""
    if not text or not text.strip():
        raise ValueError("the question is empty")
    return provider().embed([text])[0]


def classify_one(content: str, provider: Callable[[], object] = Offline) -> tuple[str, str]:
    """(intent, description) of one chunk, as ``classify`` gives them; a failing call gives utility."""
    try:
        got = provider().classify([(content or "")[:CHUNK_CHARS]])
    except Exception:  # noqa: BLE001 - as in classify
        got = []
    intent, detail = got[0] if got else ("utility", "")
    return intent if intent in INTENTS else "utility", detail


def analyze_one(content: str, path: str, provider: Callable[[], object] = Offline) -> tuple[str, str]:
    """(summary, role) of one file, as ``analyze_files`` gives them."""
    try:
        return provider().analyze((content or "")[:FILE_CHARS], path or "")
    except Exception:  # noqa: BLE001
        return "", "unknown"


def classify(df: DataFrame, content: str = "content", provider: Callable[[], object] = Offline) -> DataFrame:
    """``df`` with intent and intent_detail, eight chunks a call and 500 characters a chunk; a failing call gives utility."""
    schema = _with(df, intent=T.StringType(), intent_detail=T.StringType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for pdf in batches:
            out = []
            texts = [(t or "")[:CHUNK_CHARS] for t in pdf[content]]
            for k in range(0, len(texts), BATCH):
                part = texts[k : k + BATCH]
                try:
                    got = model.classify(part)
                except Exception:  # noqa: BLE001 - a service that fails must not stop the run
                    got = []
                out += [(i if i in INTENTS else "utility", d) for i, d in got[: len(part)]] + [("utility", "")] * (len(part) - len(got))
            yield pdf.assign(intent=[i for i, _ in out], intent_detail=[d for _, d in out])

    return df.mapInPandas(run, schema)


def analyze_files(df: DataFrame, provider: Callable[[], object] = Offline) -> DataFrame:
    """``df`` (path, content, ...) with summary, role and ``warning``; a failing call gives an empty summary and role unknown."""
    schema = _with(df, summary=T.StringType(), role=T.StringType(), warning=T.StringType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append((*model.analyze((text or "")[:FILE_CHARS], path or ""), None))
                except Exception as e:  # noqa: BLE001
                    rows.append(("", "unknown", str(e)[:200]))
            yield pdf.assign(summary=[r[0] for r in rows], role=[r[1] for r in rows], warning=[r[2] for r in rows])

    return df.mapInPandas(run, schema)


def unclassified(df: DataFrame) -> DataFrame:
    """What stands in where classification is switched off."""
    return df.withColumns({"summary": F.lit(""), "role": F.lit("unknown"), "intent": F.lit("utility"), "intent_detail": F.lit("")})
