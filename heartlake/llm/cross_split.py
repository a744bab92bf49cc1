"""The same recording in the training split and in an evaluation split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.listings import same_file, split_name
from ..operators.joins import salted_join
from ..session import cut
from .near_vectors import SignHashes, near_pairs
from .passages import covered_length, fenced, matched_passages, step


def listings(manifest: DataFrame) -> DataFrame:
    """``id, dataset, split, record, file, steps`` of the listings with a known split.

    ``record`` and ``file`` are fenced texts and ``steps`` those of the file's
    path; null where the field is null or blank.
    """
    record = F.nullif(F.trim("record_id"), F.lit(""))
    rows = manifest.select(
        F.col("manifest_id").alias("id"),
        "dataset",
        split_name(F.col("split")).alias("split"),
        fenced("record", record).alias("record"),
        same_file(F.col("signal_path")).alias("path"),
    ).where(F.col("split").isNotNull())
    return rows.select("id", "dataset", "split", "record", fenced("file", F.concat(F.lit("/"), F.col("path"))).alias("file"), F.split("path", "/").alias("steps"))


def _fields(rows: DataFrame) -> DataFrame:
    """One row per field: ``id, text``."""
    return rows.select("id", F.explode(F.array("record", "file")).alias("text")).where(F.col("text").isNotNull())


def _anchors() -> Column:
    """A listing's record, the folders of its file and what its path ends in."""
    folders = F.transform(F.slice("steps", 1, F.greatest(F.size("steps") - 1, F.lit(0))), lambda s: step(s, False))
    return F.filter(F.concat(F.array("record"), F.coalesce(folders, F.array().cast("array<string>")), F.array(step(F.element_at("steps", -1), True))), lambda x: x.isNotNull())


def _texts(rows: DataFrame) -> DataFrame:
    """A listing's record and file in one ``text``, with the ``anchors`` its passages may have."""
    return rows.select(F.concat(F.coalesce("record", F.lit("")), F.coalesce("file", F.lit(""))).alias("text"), _anchors().alias("anchors")).where("text <> ''")


def _passages(rows: DataFrame) -> DataFrame:
    """The passages of listings: ``id, anchor, text, a, b``, with the characters ``[a, b)`` of record and path they hold.

    They are the record, the whole path, each folder and what the path ends in.
    """
    size = F.coalesce(F.length("record") - len("record") - 2, F.lit(0))
    count = F.size("steps")

    def passage(anchor: Column, text: Column, a: Column, b: Column) -> Column:
        return F.struct(anchor.alias("anchor"), text.alias("text"), a.alias("a"), b.alias("b"))

    def folder(i: Column) -> Column:
        a = size + F.when(i == 0, 0).otherwise(1 + F.length(F.array_join(F.slice("steps", 1, i), "/")))
        name = F.element_at("steps", i + 1)
        return passage(step(name, False), step(name, False), a, a + F.length(name) + 2)

    path = F.array_join("steps", "/")
    last = F.element_at("steps", -1)
    end = size + F.length(path) + 1
    folders = F.when(count > 1, F.transform(F.sequence(F.lit(0), F.greatest(count - 2, F.lit(0))), folder))
    whole = F.array(passage(F.col("record"), F.col("record"), F.lit(0), size), passage(step(last, True), F.col("file"), size, end), passage(step(last, True), step(last, True), end - F.length(last) - 1, end))
    found = F.concat(whole, F.coalesce(folders, F.slice(whole, 1, 0)))
    return rows.select("id", F.explode(found).alias("p")).select("id", "p.*").where(F.col("text").isNotNull())


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    train = F.col("split") == "train"
    return rows.where(train), rows.where(~train)


def record_pairs(cache: DataFrame, rule: SignHashes = SignHashes()) -> DataFrame:
    """``record_a, record_b`` (fenced, smaller first): different records with usable windows at the wanted cosine.

    Exact copies of a vector are one class; records of one class and of near
    classes are pairs.  Classes keep their records as rows, never as lists.
    """
    named = cache.where(F.trim("record_id") != "").select("vec_id", fenced("record", F.trim("record_id")).alias("record"), "features")
    near, owners = near_pairs(named, "vec_id", "record", "features", rule)
    owners = cut(owners)
    # a vector that several records own is a link of its own
    shared = owners.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(F.col("id").alias("id_a"), F.col("id").alias("id_b"))
    links = cut(near.select("id_a", "id_b").unionByName(shared))
    left = salted_join(links, owners.select(F.col("id").alias("id_a"), F.col("owner").alias("ra")), ["id_a"])
    both = salted_join(left, owners.select(F.col("id").alias("id_b"), F.col("owner").alias("rb")), ["id_b"])
    return cut(both.where(F.col("ra") != F.col("rb")).select(F.least("ra", "rb").alias("record_a"), F.greatest("ra", "rb").alias("record_b")).distinct())


def overlaps(manifest: DataFrame, cache: DataFrame, rule: SignHashes = SignHashes()) -> DataFrame:
    """``train_id, eval_id, reason`` of listings of one recording across splits.

    ``reason`` is record, file or window; a pair may have several.  Listings
    without a known split, and null or blank fields, tie nothing.
    """
    rows = cut(listings(manifest))
    train, held = _sides(rows)
    t, e = _fields(train), _fields(held)
    matched = cut(matched_passages(_passages(held), _texts(train), anchor="anchor", anchors="anchors"))
    exact = salted_join(
        t.join(matched, "text", "left_semi").select("text", F.col("id").alias("train_id")),
        e.join(matched, "text", "left_semi").select("text", F.col("id").alias("eval_id")),
        ["text"],
    ).select("train_id", "eval_id", F.when(F.col("text").startswith("record"), F.lit("record")).otherwise(F.lit("file")).alias("reason"))
    pairs = record_pairs(cache, rule)
    both = pairs.select(F.col("record_a").alias("rt"), F.col("record_b").alias("re")).unionByName(pairs.select(F.col("record_b").alias("rt"), F.col("record_a").alias("re")))
    by_window = salted_join(
        salted_join(both, train.select(F.col("record").alias("rt"), F.col("id").alias("train_id")), ["rt"]).select("re", "train_id"),
        held.select(F.col("record").alias("re"), F.col("id").alias("eval_id")),
        ["re"],
    ).select("train_id", "eval_id", F.lit("window").alias("reason"))
    return exact.unionByName(by_window).distinct()


def coverage(manifest: DataFrame) -> DataFrame:
    """``id, dataset, split, covered, n_chars`` of each evaluation listing.

    ``n_chars`` are the characters of its record and its path; ``covered`` those
    that stand in training listings, as whole fields or as steps of a path,
    matched intervals merged.
    """
    train, held = _sides(cut(listings(manifest)))
    passages = _passages(held)
    matched = matched_passages(passages, _texts(train), anchor="anchor", anchors="anchors")
    # a folder of very many listings is one matched passage, which AQE or the salts of the join spread
    spans = salted_join(passages.select("text", "id", "a", "b"), matched, ["text"]).groupBy("id").agg(covered_length(F.collect_list(F.struct("a", "b"))).alias("covered"))
    size = F.coalesce(F.length("record") - len("record") - 2, F.lit(0)) + F.coalesce(F.length(F.array_join("steps", "/")) + 1, F.lit(0))
    return held.join(spans, "id", "left").select("id", "dataset", "split", F.coalesce("covered", F.lit(0)).alias("covered"), size.alias("n_chars"))
