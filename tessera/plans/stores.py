"""Stored structures over the standard tables: inverted, vector and name index, a table with deltas."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import query
from ..functions import text
from ..operators.inverted import InvertedIndex
from ..operators.names import NameIndex
from ..operators.vectors import VectorIndex
from ..sources.keyed import KeyedTable
from ..sources.shared import new_folder
from .common import table
from .search import BM25


@query("indexed_search", f"WITH {BM25} SELECT query_id, doc, score, rank FROM bm25")
def indexed_search(spark, sf_dir):
    """The lexical lane from a stored index that took the documents in two parts."""
    docs = table(spark, sf_dir, "documents")
    index = InvertedIndex(spark, new_folder(spark, "inverted"))
    index.add(docs.where("doc_id % 4 > 0"))
    index.add(docs.where("doc_id % 4 = 0"))
    return index.search(table(spark, sf_dir, "benchmark").selectExpr("item_id AS query_id", "text AS query"))


@query("indexed_neighbours")
def indexed_neighbours(spark, sf_dir):
    """The vector lane from a stored index; recall is measured in the tests."""
    e = table(spark, sf_dir, "embeddings")
    index = VectorIndex(spark, new_folder(spark, "vectors"))
    index.rebuild(e)
    return index.search(e.where("vec_id % 20 = 0"), 10)


_FOLDED = "trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9_]+', ' ', 'g'))"


@query("name_lookup", f"""WITH p AS (SELECT client_id AS place_id, name FROM clients UNION ALL SELECT 1000000000 + vendor_id, name FROM vendors),
w AS (SELECT DISTINCT place_id, unnest(string_split({_FOLDED.format(x='name')}, ' ')) AS token FROM p WHERE name IS NOT NULL),
q AS (SELECT client_id AS query_id, list_distinct(list_filter(string_split({_FOLDED.format(x="concat(substr(name, 1, 2), substr(name, 4))")}, ' '), lambda t: t <> '')) AS asked FROM clients WHERE name IS NOT NULL),
a AS (SELECT query_id, len(asked) AS n_asked, unnest(asked) AS asked FROM q),
m AS (SELECT query_id, n_asked, asked, place_id, max(CASE WHEN asked = token THEN 1.0 ELSE 0.5 END) AS worth FROM a JOIN w ON substr(asked, 1, 1) = substr(token, 1, 1) AND token <> '' AND levenshtein(asked, token) <= CASE WHEN length(asked) < 3 THEN 0 WHEN length(asked) < 6 THEN 1 ELSE 2 END GROUP BY ALL),
b AS (SELECT query_id, place_id, round(avg(worth), 6) AS relevance FROM m GROUP BY query_id, place_id, n_asked HAVING count(*) = n_asked)
SELECT query_id, place_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, place_id) AS rank FROM b QUALIFY rank <= 20""")
def name_lookup(spark, sf_dir):
    """Misspelt names of all clients (the third character lacks) among those of clients and vendors; every asked word counts."""
    clients = table(spark, sf_dir, "clients")
    index = NameIndex(spark, new_folder(spark, "names"))
    index.rebuild(clients.selectExpr("client_id AS place_id", "name").unionByName(table(spark, sf_dir, "vendors").selectExpr("1000000000 + vendor_id AS place_id", "name")))
    asked = clients.where("name IS NOT NULL").selectExpr("client_id AS query_id", "concat(substr(name, 1, 2), substr(name, 4)) AS q")
    return index.lookup(asked)


@query("name_completions", f"""WITH w AS (SELECT DISTINCT vendor_id AS place_id, unnest(string_split({_FOLDED.format(x='name')}, ' ')) AS token FROM vendors WHERE name IS NOT NULL),
q AS (SELECT client_id AS query_id, {_FOLDED.format(x='substr(name, 1, 3)')} AS asked FROM clients WHERE name IS NOT NULL),
a AS (SELECT * FROM q WHERE asked <> '' AND NOT contains(asked, ' ')),
b AS (SELECT query_id, place_id, max(CASE WHEN asked = token THEN 1.0 WHEN starts_with(token, asked) THEN 0.8 ELSE 0.5 END) AS relevance FROM a JOIN w ON starts_with(token, asked) OR (substr(asked, 1, 1) = substr(token, 1, 1) AND levenshtein(asked, token) <= CASE WHEN length(asked) < 3 THEN 0 ELSE 1 END) GROUP BY 1, 2)
SELECT query_id, place_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, place_id) AS rank FROM b QUALIFY rank <= 10""")
def name_completions(spark, sf_dir):
    """Vendors with a word that begins as a client's name does, after three characters typed."""
    index = NameIndex(spark, new_folder(spark, "names"))
    index.rebuild(table(spark, sf_dir, "vendors").selectExpr("vendor_id AS place_id", "name"))
    typed = table(spark, sf_dir, "clients").where("name IS NOT NULL").selectExpr("client_id AS query_id", "substr(name, 1, 3) AS q").where(~F.contains(text.norm_name(F.col("q")), F.lit(" ")))
    return index.lookup(typed, 10, half_typed=True)


_STATE = ["client_id", "source", "segment", "city", "balance"]


@query("client_state", """WITH last AS (SELECT * FROM client_changes QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY seq DESC, change_id DESC) = 1)
SELECT client_id, source, segment, city, balance FROM last WHERE op <> 'D' UNION ALL SELECT client_id, source, segment, city, balance FROM clients WHERE client_id NOT IN (SELECT client_id FROM last)""")
def client_state(spark, sf_dir):
    """Clients and five runs of changes, each written as a delta and merged on reading."""
    changes = table(spark, sf_dir, "client_changes")
    store = KeyedTable(spark, new_folder(spark, "clients"), "client_id", most_deltas=4)
    store.rebuild(table(spark, sf_dir, "clients").select(*_STATE))
    for run in range(5):
        mine = changes.where(F.expr(f"least(seq div 25, 4) = {run}"))
        last = mine.withColumn("__n", F.row_number().over(Window.partitionBy("client_id").orderBy(F.desc("seq"), F.desc("change_id")))).where("__n = 1")
        store.upsert(last.where("op <> 'D'").select(*_STATE), last.where("op = 'D'").select("client_id"))
    return store.read()
