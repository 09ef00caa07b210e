"""A metadata service as a source: requests in batches, cached, throttled and retried.

The transport is given by the caller (in tests a table of answers), so no
network is needed to plan or to test.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import SERVICE_PAPER

#: Ids of one request, seconds between requests and attempts at one.
BATCH, PAUSE, ATTEMPTS = 100, 1.05, 4

#: (status, headers, body) of a request for a list of ids.
Transport = Callable[[list[str]], tuple[int, dict[str, str], str]]


def wait_before(attempt: int, headers: dict[str, str]) -> float:
    """Seconds before another attempt: what the service asks for, else 1, 2, 4 and so on up to 16."""
    asked = headers.get("retry-after", "")
    return float(asked) if asked.replace(".", "", 1).isdigit() else float(min(2**attempt, 16))


def request(transport: Transport, ids: list[str], sleep: Callable[[float], None] = time.sleep) -> list[dict | None]:
    """The service's answer for ids, in their order; tried again after 429 and server errors."""
    for attempt in range(ATTEMPTS):
        status, headers, body = transport(ids)
        if status == 200:
            return json.loads(body)
        if status != 429 and status < 500:
            break
        if attempt + 1 < ATTEMPTS:
            sleep(wait_before(attempt, headers))
    raise OSError(f"the service answered {status}")


def plain_paper(paper: dict | None) -> dict | None:
    """Null lists become empty, external ids texts; ids that are neither text nor number go."""
    if paper is None:
        return None
    ids = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in (paper.get("externalIds") or {}).items() if isinstance(v, (str, int, float, bool))}
    return paper | {"externalIds": ids, "fieldsOfStudy": paper.get("fieldsOfStudy") or [], "authors": paper.get("authors") or []}


def fetch(requests: DataFrame, transport: Transport, pause: float = PAUSE) -> DataFrame:
    """``pos, service``: the service's papers for rows (pos, external_id); a batch is a request, a partition asks one at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for part in parts:
            for lo in range(0, len(part), BATCH):
                some = part.iloc[lo : lo + BATCH]
                time.sleep(max(0.0, last + pause - time.time()))
                last = time.time()
                found = request(transport, some["external_id"].tolist())
                yield pd.DataFrame({"pos": some["pos"], "body": [json.dumps(plain_paper(p)) if p else None for p in found]})

    raw = requests.where("external_id is not null").select("pos", "external_id").mapInPandas(run, "pos long, body string")
    return raw.select("pos", F.from_json("body", SERVICE_PAPER).alias("service"))


#: One page of a search: (query, token of the page or None) to (status, headers, body of {"data": [...], "token": ...}).
Pages = Callable[[str, str | None], tuple[int, dict[str, str], str]]


def pages(transport: Pages, query: str, limit: int, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Papers of a bulk search, page by page as long as the service gives a token, ``limit`` at most."""
    token, left = None, limit
    while left > 0:
        found = request(lambda _: transport(query, token), [], sleep)
        for paper in found.get("data", [])[:left]:
            left -= 1
            yield paper
        token = found.get("token")
        if not token or not found.get("data"):
            return


def bulk_search(spark: SparkSession, transport: Pages, queries: list[str], limit: int, pause: float = PAUSE) -> DataFrame:
    """``query, pos, service``: the first ``limit`` papers of each search; a search is asked page by page in one task."""
    wanted = spark.createDataFrame([(q,) for q in queries], "query string")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def paced(query: str, token: str | None) -> tuple[int, dict[str, str], str]:
            time.sleep(pause if token else 0.0)
            return transport(query, token)

        for part in parts:
            for q in part["query"]:
                rows = [(q, k, json.dumps(plain_paper(p))) for k, p in enumerate(pages(paced, q, limit))]
                yield pd.DataFrame(rows, columns=["query", "pos", "body"])

    raw = wanted.repartition(max(1, len(queries)), "query").mapInPandas(run, "query string, pos long, body string")
    return raw.select("query", "pos", F.from_json("body", SERVICE_PAPER).alias("service"))


#: Texts of one request to an embedding service.
EMBEDDED = 32

#: (texts) to vectors, in their order.
Embed = Callable[[list[str]], list[list[float]]]


def embeddings(rows: DataFrame, embed: Embed, dim: int) -> DataFrame:
    """``id, vec`` of rows (id, text), EMBEDDED texts a request; an answer of another number or length of vectors is an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), EMBEDDED):
                some = part.iloc[lo : lo + EMBEDDED]
                found = embed(some["text"].fillna("").tolist())
                if len(found) != len(some) or any(len(v) != dim for v in found):
                    raise ValueError(f"the service gave {len(found)} vectors of lengths {sorted({len(v) for v in found})} for {len(some)} texts of dimension {dim}")
                yield pd.DataFrame({"id": some["id"], "vec": found})

    return rows.select("id", "text").mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, vec array<float>")
