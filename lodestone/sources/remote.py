"""A search service, or a folder of its answers, as a Spark data source: one partition a sub-query, read side by side on executors.

    spark.dataSource.register(SearchSource)
    spark.read.format("paper_search").option("endpoint", "https://...").option("queries", json.dumps([...])).load()
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lodestone.sources.corpus import RAW_RECORD

# Answers that are worth another attempt, attempts, seconds, records of a page.
RETRIED, ATTEMPTS, TIMEOUT, PAGE = {429, 500, 502, 503, 504}, 4, 30, 100


class SearchSource(DataSource):
    """Rows (query_idx, query, rank, record): the records of each sub-query's first page as JSON, in the service's order.

    Options: endpoint (an address, or a folder with an answer in `<query_idx>.json` each), queries (a JSON list), page_size, attempts, timeout and
    wait (seconds before the second attempt; they double), failures (`skip`: a sub-query that fails gives no rows; `raise`).
    """

    @classmethod
    def name(cls) -> str:
        return "paper_search"

    def schema(self) -> StructType:
        return StructType([StructField("query_idx", IntegerType()), StructField("query", StringType()), StructField("rank", IntegerType()), StructField("record", StringType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SearchReader(dict(self.options))


class SubQuery(InputPartition):
    def __init__(self, index: int, query: str):
        super().__init__(index)
        self.index, self.query = index, query


class SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = {k.lower(): v for k, v in options.items()}
        self.endpoint, self.queries = given["endpoint"], json.loads(given["queries"])
        self.page, self.attempts = int(given.get("page_size", PAGE)), int(given.get("attempts", ATTEMPTS))
        self.timeout, self.wait = float(given.get("timeout", TIMEOUT)), float(given.get("wait", 1))
        self.skip = given.get("failures", "skip") == "skip"

    def partitions(self) -> list[InputPartition]:
        return [SubQuery(k, q) for k, q in enumerate(self.queries)]

    def _answer(self, part: SubQuery) -> bytes:
        if not self.endpoint.startswith(("http://", "https://")):
            return (Path(self.endpoint) / f"{part.index}.json").read_bytes()
        asked = urllib.parse.urlencode({"query": part.query, "format": "json", "pageSize": self.page, "resultType": "core"})
        with urllib.request.urlopen(f"{self.endpoint}?{asked}", timeout=self.timeout) as answer:
            return answer.read()

    def _records(self, part: SubQuery) -> list[dict]:
        for k in range(self.attempts):
            try:
                found = json.loads(self._answer(part)).get("resultList", {}).get("result", [])
                return [r for r in found if isinstance(r, dict)][: self.page]
            except OSError as e:
                # answers that pass, and connections; no answer in time is final
                passes = e.code in RETRIED if isinstance(e, urllib.error.HTTPError) else not isinstance(e, TimeoutError | FileNotFoundError) and not isinstance(getattr(e, "reason", None), TimeoutError)
                if not passes or k + 1 == self.attempts:
                    raise
                time.sleep(self.wait * 2**k)
        return []

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            records = self._records(partition)
        except Exception:  # noqa: BLE001 - a sub-query that fails leaves the others alone
            if not self.skip:
                raise
            records = []
        for rank, record in enumerate(records, 1):
            yield partition.index, partition.query, rank, json.dumps(record, ensure_ascii=False)


def remote_records(spark: SparkSession, endpoint: str, queries: list[str], **options: str) -> DataFrame:
    """(query_idx, query, rank, RAW_RECORD fields) of what a service finds; records_to_papers() takes them on."""
    spark.dataSource.register(SearchSource)
    rows = spark.read.format("paper_search").option("endpoint", endpoint).option("queries", json.dumps(queries)).options(**options).load()
    # what may be one value or a list in the answers is kept as its JSON
    return rows.withColumn("record", F.from_json("record", RAW_RECORD)).select("query_idx", "query", "rank", "record.*")
