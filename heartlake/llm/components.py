"""Connected components by hash-to-min, and splits that keep a component together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.listings import number_in, split_name
from ..operators.joins import salted_join
from ..session import cut


def hash_to_min(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` of an undirected graph; ``component`` is its smallest node.

    Each node holds a cluster, at first its neighbours and itself.  In a round
    it sends its cluster to the smallest node it knows, and that node to all
    others.  Clusters are rows ``(node, member)``, never lists, so a component
    that holds a third of all nodes is no task's problem; joins on hot nodes
    are salted.  Rounds end when nothing changes; each is cut from its past in
    the shared checkpoint folder.  Edges with a null end are left out.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("node"), F.col(b).alias("member"))
    turned = e.select(F.col("member").alias("node"), F.col("node").alias("member"))
    both = e.unionByName(turned)
    cluster = cut(both.unionByName(both.select("node", F.col("node").alias("member"))).distinct())
    state = None
    while True:  # a round that changes anything brings a smaller member to some node, so this ends
        least = cluster.groupBy("node").agg(F.min("member").alias("least"))
        known = salted_join(cluster, least, ["node"])
        sent = known.select(F.explode(F.array(F.struct(F.col("least").alias("node"), F.col("member").alias("member")), F.struct(F.col("member").alias("node"), F.col("least").alias("member")))).alias("x"))
        cluster = cut(sent.select("x.*").distinct())
        now = cluster.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "member"))).first()
        if now == state:
            break
        state = now
    return cluster.groupBy("node").agg(F.min("member").alias("component"))


def related_rows(manifest: DataFrame) -> DataFrame:
    """``id, split, component`` of every listing; ``component`` is the smallest id of its group.

    Listings that share a subject or a study number, also through others, have
    one component.  Identifiers that name nobody tie nothing; a listing without
    any is a component of its own.  Ids must be unique and not null.

    Listings of one subject are one node from the start, named by the smallest
    id, so the graph holds only the links that studies make between nodes: a
    subject or study of any size is one aggregate, combined before its shuffle.
    """
    rows = manifest.select(
        F.col("manifest_id").alias("id"),
        split_name(F.col("split")).alias("split"),
        number_in(F.col("subject_id")).alias("subject"),
        number_in(F.col("study_id")).alias("study"),
    )
    known = rows.where(F.col("subject").isNotNull())
    named = salted_join(known, known.groupBy("subject").agg(F.min("id").alias("node")), ["subject"]).select("id", "split", "study", "node")
    nodes = cut(named.unionByName(rows.where(F.col("subject").isNull()).select("id", "split", "study", F.col("id").alias("node"))))
    linking = nodes.where(F.col("study").isNotNull()).groupBy("study").agg(F.min("node").alias("least"), F.max("node").alias("most")).where(F.col("least") < F.col("most"))
    links = salted_join(nodes.select("study", "node").distinct(), linking.select("study", "least"), ["study"]).where(F.col("node") != F.col("least")).select("node", "least").distinct()
    found = hash_to_min(links, "node", "least")
    return cut(nodes.join(found, "node", "left").select("id", "split", F.coalesce("component", "node").alias("component")))


def torn_groups(rows: DataFrame) -> DataFrame:
    """``id, group_id`` of all rows of components that stand in two or more splits; null splits aren't counted."""
    groups = rows.groupBy("component").agg(F.min("split").alias("one"), F.max("split").alias("other")).where(F.col("one") < F.col("other")).select("component")
    return salted_join(rows.select("id", "component"), groups, ["component"]).select("id", F.col("component").alias("group_id"))


def rendezvous(key: Column, shares: dict[str, float], seed: int = 42) -> Column:
    """The split of a key by weighted rendezvous hashing.

    Every split scores ``-share / ln(u)`` with a ``u`` in (0, 1) of the first 48
    bits of a digest of split and key; the highest score, to nine decimals, wins.
    Adding or reweighting a split moves only the keys that it wins or loses.
    """
    best = None
    for name, share in shares.items():
        bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{name}:"), key.cast("string"))), 1, 12), 16, 10).cast("double")
        u = (bits + 0.5) / F.lit(float(1 << 48))
        x = F.struct(F.round(F.lit(-float(share)) / F.ln(u), 9).alias("score"), F.lit(name).alias("name"))
        best = x if best is None else F.greatest(best, x)
    return best["name"]


def assigned(rows: DataFrame, shares: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """``id, component, present, assigned``: each component in one split, 80/10/10 unless told otherwise."""
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    return rows.select("id", "component", F.col("split").alias("present"), rendezvous(F.col("component"), shares, seed).alias("assigned"))


def split_report(rows: DataFrame) -> DataFrame:
    """Listings and components of each assigned split, their share, and its largest component.

    Hashing balances components, not listings: with few or uneven components a
    split's ``share`` of the listings is off, and a component that alone is too
    large for its split shows as ``largest``.
    """
    all_rows = Window.partitionBy()
    # components, of any number, are counted before they are compared
    each = assigned(rows).groupBy("assigned", "component").agg(F.count(F.lit(1)).alias("n"))
    per = each.groupBy("assigned").agg(F.sum("n").alias("listings"), F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"))
    return per.withColumn("share", F.round(F.col("listings") / F.sum("listings").over(all_rows), 6))
