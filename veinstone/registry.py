"""A catalog of functions that queries and agents may call."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Entry:
    name: str
    description: str
    category: str = "general"
    search_hint: str = ""
    should_defer: bool = True
    always_load: bool = False


class Registry:
    """Callables by name, with what a catalog search needs; tests replace entries by registering again."""

    def __init__(self) -> None:
        self.functions: dict[str, tuple[Callable, Entry]] = {}

    def register(self, function: Callable, entry: Entry) -> Callable:
        self.functions[entry.name] = (function, entry)
        return function

    def __getitem__(self, name: str) -> Callable:
        return self.functions[name][0]

    def names(self, deferred: bool) -> list[str]:
        return sorted(name for name, (_, entry) in self.functions.items() if (entry.should_defer and not entry.always_load) == deferred)

    def catalog(self, spark: SparkSession) -> DataFrame:
        rows = [asdict(entry) for _, entry in self.functions.values()]
        return spark.createDataFrame(rows, "name string, description string, category string, search_hint string, should_defer boolean, always_load boolean")

    def call(self, name: str, *args, **kwargs) -> dict:
        """The result in an envelope: status success, or error with its text."""
        try:
            return {"status": "success", "result": self[name](*args, **kwargs), "error": None}
        except Exception as error:  # noqa: BLE001  what failed goes into the envelope
            return {"status": "error", "result": None, "error": f"{type(error).__name__}: {error}"}

    def register_scalars(self, spark: SparkSession) -> list[str]:
        """Makes the registered vectorised functions callable from SQL: entries of category ``scalar``, whose hint is the result type."""
        names = [name for name, (_, entry) in self.functions.items() if entry.category == "scalar"]
        for name in names:
            function, entry = self.functions[name]
            spark.udf.register(name, F.pandas_udf(function, entry.search_hint))
        return sorted(names)


#: Table functions by name: their parameters, columns and bodies. A body reads temporary views: postings (id, term, tf, size), as search.postings
#: gives them, with a row without a term for each document; relations (src, type, dst, doc_id, and edge_id where links of the same ends, type and
#: document are to be told apart); and catalog (name, description, category, search_hint).
TABLE_FUNCTIONS = {
    "search_text": (
        "asked STRING, most INT", "id BIGINT, score DOUBLE, rank INT",
        """
WITH t AS (SELECT DISTINCT explode(regexp_extract_all(lower(asked), '[0-9a-z\\u00DF-\\u00F6\\u00F8-\\u024F]+', 0)) AS term),
n AS (SELECT count(*) AS n, avg(size) AS mean FROM postings WHERE term IS NULL),
d AS (SELECT p.term, count(*) AS df FROM postings p JOIN t ON t.term = p.term GROUP BY p.term),
s AS (SELECT p.id, round(sum(ln(1 + (n.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.size / n.mean))), 6) AS score FROM postings p JOIN d ON d.term = p.term CROSS JOIN n GROUP BY p.id)
SELECT id, score, rank FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= most""",
    ),
    "graph_relations": (
        "entity STRING", "node STRING, type STRING, other STRING, direction STRING",
        "SELECT src, type, dst, 'out' FROM relations WHERE src = entity UNION ALL SELECT dst, type, src, 'in' FROM relations WHERE dst = entity AND src <> dst",
    ),
    "impact_path": (
        "entity STRING", "hops INT, path STRING",
        """
WITH one AS (SELECT dst AS a, edge_id AS x FROM relations WHERE src = entity),
two AS (SELECT a, x, dst AS b, edge_id AS y FROM one JOIN relations ON src = a WHERE edge_id <> x),
three AS (SELECT a, b, dst AS c FROM two JOIN relations ON src = b WHERE edge_id <> x AND edge_id <> y)
SELECT 1, concat_ws(' -> ', entity, a) FROM one UNION ALL SELECT 2, concat_ws(' -> ', entity, a, b) FROM two UNION ALL SELECT 3, concat_ws(' -> ', entity, a, b, c) FROM three""",
    ),
    "search_tools": (
        "word STRING, most INT", "name STRING, score INT",
        """
SELECT name, score FROM (
  SELECT name, score, row_number() OVER (ORDER BY score DESC, name) AS nth FROM (
    SELECT name, CASE WHEN array_contains(split(lower(name), '_'), lower(word)) THEN 10 WHEN contains(lower(name), lower(word)) THEN 5 ELSE 0 END
      + CASE WHEN array_contains(split(lower(search_hint), '\\\\W+'), lower(word)) THEN 4 ELSE 0 END + CASE WHEN contains(lower(category), lower(word)) THEN 3 ELSE 0 END
      + CASE WHEN array_contains(split(lower(description), '\\\\W+'), lower(word)) THEN 2 ELSE 0 END AS score FROM catalog)
  WHERE score > 0) WHERE nth <= most""",
    ),
}


def register_tables(spark: SparkSession, views: dict[str, DataFrame]) -> list[str]:
    """Makes the table functions whose views are given callable from SQL: SELECT * FROM search_text('words', 5). Catalyst inlines their bodies."""
    for name, view in views.items():
        if name == "relations" and "edge_id" not in view.columns:
            view = view.withColumn("edge_id", F.xxhash64("src", "type", "dst", "doc_id"))
        view.createOrReplaceTempView(name)
    needs = {"search_text": "postings", "graph_relations": "relations", "impact_path": "relations", "search_tools": "catalog"}
    names = [name for name, view in needs.items() if view in views]
    for name in names:
        parameters, columns, body = TABLE_FUNCTIONS[name]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
    return names
