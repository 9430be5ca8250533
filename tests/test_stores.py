"""Stores under versions, deletions that are taken up again, and functions in SQL over cycles."""

import pytest

from veinstone import registry
from veinstone.operators import search
from veinstone.operators.stores import Deletions, KeyedStore, replaced, without_orphans

CHUNKS = "doc_id long, n int, text string"


def rows_of(store):
    return sorted(map(tuple, store.read().collect()), key=str)


@pytest.fixture()
def chunks(spark, tmp_path):
    return KeyedStore(spark, f"file://{tmp_path}/chunks", ["doc_id", "n"], CHUNKS)


def test_last_write_counts(spark, chunks):
    assert rows_of(chunks) == []
    chunks.upsert(spark.createDataFrame([(1, 0, "a", 5), (1, 0, "b", 9), (1, 0, "c", 2), (2, 0, "x", 1), (None, 1, "none", 1)], CHUNKS + ", seq int"), "seq")
    assert rows_of(chunks) == [(1, 0, "b"), (2, 0, "x"), (None, 1, "none")]
    chunks.upsert(spark.createDataFrame([(2, 0, None), (2, 1, "y")], CHUNKS))
    assert rows_of(chunks) == [(1, 0, "b"), (2, 0, None), (2, 1, "y"), (None, 1, "none")]
    before = chunks.versions.latest()
    assert chunks.delete(spark.createDataFrame([(2,), (None,), (77,)], "doc_id long"), ["doc_id"]) == 3
    assert rows_of(chunks) == [(1, 0, "b")] and chunks.read(before).count() == 4
    chunks.upsert(spark.createDataFrame([(2, 0, "back")], CHUNKS))
    chunks.compacted()
    assert rows_of(chunks) == [(1, 0, "b"), (2, 0, "back")] and len(chunks.versions.state()["parts"]) == 1
    chunks.upsert(spark.createDataFrame([(2, 0, "again")], CHUNKS))
    assert rows_of(chunks) == [(1, 0, "b"), (2, 0, "again")]
    chunks.swap(spark.createDataFrame([(9, 9, "new")], CHUNKS))
    assert rows_of(chunks) == [(9, 9, "new")]
    chunks.versions.swept(keep=1)
    assert rows_of(chunks) == [(9, 9, "new")]


def test_two_writers_lose_nothing(spark, tmp_path, chunks):
    other = KeyedStore(spark, f"file://{tmp_path}/chunks", ["doc_id", "n"], CHUNKS)
    chunks.upsert(spark.createDataFrame([(1, 0, "a")], CHUNKS))
    commit, met = chunks.versions.commit, []

    def late(change):
        def with_another(state):
            if not met:
                met.append(other.upsert(spark.createDataFrame([(2, 0, "theirs")], CHUNKS)))
            return change(state)

        return commit(with_another)

    chunks.versions.commit = late
    chunks.upsert(spark.createDataFrame([(1, 0, "mine"), (3, 0, "mine")], CHUNKS))
    assert rows_of(chunks) == [(1, 0, "mine"), (2, 0, "theirs"), (3, 0, "mine")]


def test_deletion_fails_half_way_and_is_resumed(spark, tmp_path, chunks):
    edges = KeyedStore(spark, f"file://{tmp_path}/edges", ["src", "dst", "doc_id"], "src string, dst string, doc_id long")
    nodes = KeyedStore(spark, f"file://{tmp_path}/nodes", ["node"], "node string")
    known = KeyedStore(spark, f"file://{tmp_path}/known", ["doc_id"], "doc_id long, name string")
    chunks.upsert(spark.createDataFrame([(d, n, "t") for d in (1, 2, 3) for n in range(3)], CHUNKS))
    edges.upsert(spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "d", 3)], "src string, dst string, doc_id long"))
    nodes.upsert(spark.createDataFrame([(x,) for x in "abcd"], "node string"))
    known.upsert(spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "doc_id long, name string"))
    deletions = Deletions(spark, f"file://{tmp_path}/journal", {"edges": edges, "chunks": chunks}, known)
    works = edges.delete
    edges.delete = lambda *_: 1 / 0
    said = {r.store: (r.rows, r.error) for r in deletions.delete(spark.createDataFrame([(1,)], "doc_id long")).collect()}
    assert said["chunks"] == (3, None) and said["edges"][0] is None and "ZeroDivisionError" in said["edges"][1] and said["metadata"][0] is None
    assert known.read().count() == 3 and edges.read().count() == 3 and chunks.read().count() == 6 and len(deletions.open()) == 1
    edges.delete = works
    again = Deletions(spark, f"file://{tmp_path}/journal", {"edges": edges, "chunks": chunks}, known)  # another process
    assert {r.store: (r.rows, r.error) for r in again.resumed().collect()} == {"edges": (1, None), "metadata": (1, None)}
    assert again.open() == [] and again.resumed().collect() == [] and known.read().count() == 2
    assert without_orphans(nodes, edges, "node") == 1 and {r.node for r in nodes.read().collect()} == {"b", "c", "d"}
    replaced(spark.createDataFrame([(2,)], "doc_id long"), again, {"chunks": spark.createDataFrame([(2, 0, "new")], CHUNKS), "metadata": spark.createDataFrame([(2, "second")], "doc_id long, name string")})
    assert [r.text for r in chunks.read().where("doc_id = 2").collect()] == ["new"] and known.read().where("doc_id = 2").first()["name"] == "second"


def test_trails_use_no_edge_twice(spark):
    links = spark.createDataFrame([("a", "r", "b", 1), ("b", "r", "a", 1), ("a", "r", "a", 1), ("b", "r", "c", 1)], "src string, type string, dst string, doc_id long")
    registry.register_tables(spark, {"relations": links})
    found = sorted(r.path for r in spark.sql("SELECT path FROM impact_path('a')").collect())
    assert found == ["a -> a", "a -> a -> b", "a -> a -> b -> a", "a -> a -> b -> c", "a -> b", "a -> b -> a", "a -> b -> a -> a", "a -> b -> c"]


def test_search_function_counts_all_documents(spark):
    docs = spark.createDataFrame([(1, "red ring"), (2, "blue"), (3, None), (4, "red red gear of some kind")], "doc_id long, text string")
    registry.register_tables(spark, {"postings": search.postings(docs, spark.createDataFrame([("red",), ("ring",)], "term string"))})
    found = [tuple(r) for r in spark.sql("SELECT id, score FROM search_text('red ring', 5)").collect()]
    asked = spark.createDataFrame([(1, "red ring")], "query_id long, query string")
    assert sorted(found) == sorted((r.id, r.score) for r in search.bm25(docs, asked, 5, least_share=0.0).collect())


def test_select_keeps_the_asked_order_and_takes_all(spark):
    names = [f"Tool_{c}" for c in "abcdefgh"]
    catalog = spark.createDataFrame([(n, "", "", "") for n in names], "name string, description string, category string, search_hint string")
    asked = list(reversed(names))
    assert [r.name for r in search.catalog_search(catalog, "select:" + ",".join(n.lower() for n in asked) + ",none").collect()] == asked
