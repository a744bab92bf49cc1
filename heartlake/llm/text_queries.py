"""Problems 7 to 9: token ids, evaluation texts in documents, and residue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..session import table
from .bpe import encoded
from .leaks import contained, leaked
from .residue import judged

catalog = Catalog()


@catalog.query("p7_ids")
def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of each document's text."""
    return encoded(table(spark, root, "documents"), "doc_id", "text")


#: Items are plain words; documents lose entities, invisible characters, tags and comments, in both readings.
_INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFF9}-\x{FFFB}]"
_RUNS = rf"""
WITH clean AS (
  SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(replace(text, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ' '), '&amp;', '&'), '{_INVISIBLE}', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
forms AS (SELECT doc_id, t FROM clean UNION SELECT doc_id, regexp_replace(regexp_replace(t, '<!--.*?-->', ' ', 'gs'), '</?[A-Za-z][^<>]*>', ' ', 'g') FROM clean WHERE contains(t, '<')),
d AS (SELECT doc_id, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') AS w FROM forms),
dw AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 11), ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM eval_items WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + 11), ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
n AS (SELECT item_id, count(*) AS passages FROM iw GROUP BY item_id),
hits AS (SELECT doc_id, item_id, count(*) AS shared FROM dw JOIN iw USING (run) GROUP BY ALL)
"""


@catalog.query("p8_found", _RUNS + "SELECT doc_id, item_id FROM hits")
def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents and the evaluation items they hold a passage of."""
    return leaked(table(spark, root, "documents"), table(spark, root, "eval_items")).select("doc_id", "item_id")


@catalog.query(
    "p8_items",
    _RUNS
    + """SELECT e.item_id, origin_split, topic, count(h.doc_id) AS documents, count(*) FILTER (h.shared = n.passages) AS whole, coalesce(round(max(h.shared / n.passages), 6), 0) AS most
FROM eval_items e LEFT JOIN hits h USING (item_id) LEFT JOIN n USING (item_id) GROUP BY ALL""",
)
def p8_items(spark: SparkSession, root: str) -> DataFrame:
    """Every item with the documents that hold it wholly or in part."""
    items = table(spark, root, "eval_items").select("item_id", "origin_split", "topic")
    per = leaked(table(spark, root, "documents"), table(spark, root, "eval_items")).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("shared") == F.col("passages")).alias("whole"), F.round(F.max(F.col("shared") / F.col("passages")), 6).alias("most")
    )
    none = {"documents": 0, "whole": 0, "most": 0.0}
    return items.join(per, "item_id", "left").fillna(none)


@catalog.query("p8_edited")
def p8_edited(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold most of an item's shingles, but no unbroken passage of it."""
    found = contained(table(spark, root, "documents"), table(spark, root, "eval_items"))
    return found.where("shared = 0").select("doc_id", "item_id", "containment")


@catalog.query("p9_found")
def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold residue instead of report content."""
    return judged(table(spark, root, "documents")).select("doc_id")


@catalog.query("p9_clean")
def p9_clean(spark: SparkSession, root: str) -> DataFrame:
    """Documents and characters that stay and go, per kind of document."""
    documents = table(spark, root, "documents")
    out = documents.select("doc_id", "doc_kind", "n_chars").join(judged(documents).select("doc_id", "kind"), "doc_id", "left")
    gone = F.col("kind").isNotNull()
    return out.groupBy("doc_kind").agg(F.count_if(~gone).alias("kept"), F.count_if(F.col("kind") == "field").alias("with_field"), F.count_if(F.col("kind") == "residue").alias("residue"), F.coalesce(F.sum(F.when(~gone, F.col("n_chars"))), F.lit(0)).alias("kept_chars"))
