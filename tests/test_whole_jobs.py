from heartlake.catalog.core import catalog
from heartlake.functions.listings import split_name
from heartlake.plans.overlap import without_overlaps
from tests.oracle import differences


def index_of(spark, root, rows):
    spark.createDataFrame(rows, "index_id bigint, dataset string, raw_labels string").write.parquet(f"{root}/signal_index.parquet")
    return str(root)


def test_packed_labels_in_every_notation(spark, tmp_path):
    rows = [(1, "a", "IRB.2;RBBx;IRB.2;LBBx"), (2, "a", "{'AFX1': 100.0, 'long PR': 0.0}"), (3, "b", '["NSRX", "sinus rhythm"]'), (4, "b", "AFLT2，LBBx"), (5, "b", "NSRX|AFX1"), (6, "b", "'1dBAV'/other"), (7, "b", "none"), (8, "b", None), (9, "b", "unmapped")]
    root = index_of(spark, tmp_path, rows)
    flags = ("normal", "af_afl", "av_block_1", "lbbb", "rbbb")
    got = {r.index_id: "".join(str(r[x]) for x in flags) for r in catalog.queries["packed_labels"](spark, root).collect()}
    assert got == {1: "00011", 2: "01100", 3: "10000", 4: "01010", 5: "11000", 6: "00100", 9: "00000"}
    counts = {r.dataset: tuple(r[x] for x in flags) for r in catalog.queries["packed_label_counts"](spark, root).collect()}
    assert counts == {"a": (0, 1, 1, 1, 1), "b": (2, 2, 1, 1, 0)}


def test_overlaps_go_in_every_spelling(spark):
    rows = [(f"r{i % 2}", s) for i, s in enumerate(["test", "test", "Test", "Test", " TEST\t", "testing", "train", "train", None, None, "val", "other"])]
    left = without_overlaps(spark.createDataFrame(rows, "record_id string, split string"), spark.createDataFrame([("r0",)], "target_record_id string"))
    assert left.columns == ["record_id", "split"]
    assert sorted((r.record_id, str(r.split)) for r in left.collect()) == sorted((x, str(s)) for x, s in rows if x == "r1" or s in ("train", None, "val"))
    assert left.where((split_name(left.split) == "test") & (left.record_id == "r0")).count() == 0


def test_clean_listing_agrees_with_sql(spark, small):
    assert "clean_listing" in catalog.sql and differences(catalog, spark, small, {"clean_listing"}) == {}
