"""Reachability and root attribution over the stored link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.urlparts import UrlParts, drop_parts, stage, stage_parts
from ..functions.urls import extract_host, normalize_target
from ..session import cut_lineage


def crawl_frontier(edges: DataFrame, seeds: DataFrame, max_depth: int = 5) -> DataFrame:
    """URLs within ``max_depth`` links of a seed, with the least depth, as (url, depth). Seeds have 1.

    One join per level. A level is cut to its new URLs before the next starts, and written to the
    shared checkpoint folder, so the plan stays flat and a lost executor repeats one level at most.
    """
    # every level reads all links again: they are computed once
    links = cut_lineage(edges.select("child", "parent").where("child is not null and parent is not null"))
    seen = cut_lineage(seeds.select("url").distinct().withColumn("depth", F.lit(1)))
    for depth in range(2, max_depth + 1):
        edge = seen.where(F.col("depth") == depth - 1)
        reached = (
            links.join(edge.select(F.col("url").alias("parent")), "parent")
            .select(F.col("child").alias("url"))
            .distinct()
        )
        fresh = reached.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth))
        fresh = cut_lineage(fresh)
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
    return seen


def seed_ancestors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """For each child below a seed, the nearest seed above it, as (url, root).

    Every child has one parent, so the graph is a set of chains. Each round joins the open chains
    with themselves and doubles the hops covered. Chains end at a seed or at a URL without parent;
    chains in a cycle never end, and the rounds stop as soon as one of them closes no further chain.
    """
    seed_urls = seeds.select(F.col("url").alias("_seed")).distinct()
    # a seed keeps no parent: chains must end there
    links = edges.select(F.col("child").alias("url"), F.col("parent").alias("up")).join(
        seed_urls, F.col("url") == F.col("_seed"), "left_anti"
    )
    marked = links.join(seed_urls, F.col("up") == F.col("_seed"), "left").select(
        "url", "up", F.col("_seed").isNotNull().alias("done")
    )
    state = cut_lineage(marked)
    while True:
        open_rows = state.where(~F.col("done"))
        step = state.select(F.col("url").alias("up"), F.col("up").alias("_up2"), F.col("done").alias("_done2"))
        jumped = open_rows.join(step, "up", "left").select(
            "url",
            F.col("_up2").alias("up"),
            # no further link: the chain ends without a seed
            F.coalesce(F.col("_done2"), F.lit(True)).alias("done"),
        )
        jumped = cut_lineage(jumped)
        state = state.where("done").unionByName(jumped)
        ended, still_open = jumped.agg(F.count_if("done"), F.count_if(~F.col("done"))).first()
        if not ended or not still_open:
            break
    return state.where("done and up is not null").select("url", F.col("up").alias("root"))


def root_target(urls: DataFrame, edges: DataFrame, seeds: DataFrame, url: str = "url") -> DataFrame:
    """Attribute each distinct URL to a seed, as (url, root_target, via).

    In order: the URL itself if it is a seed; the nearest seed up the parent chain; the first seed
    with the same host, in its own spelling; scheme and host of the URL; the URL itself.
    """
    wanted = urls.select(F.col(url).alias("url")).distinct()
    own = seeds.select("url", F.col("url").alias("_own")).distinct()
    chain = seed_ancestors(edges, seeds).withColumnRenamed("root", "_chain")
    normal = seeds.select("pos", F.col("url").alias("_by_host"), extract_host(normalize_target("url")).alias("_host"))
    by_host = (
        normal.where(F.col("_host").isNotNull())
        .withColumn("_rank", F.row_number().over(Window.partitionBy("_host").orderBy("pos")))
        .where("_rank = 1")
        .drop("_rank", "pos")
    )
    staged = stage_parts(
        wanted.join(own, "url", "left").join(chain, "url", "left"), normalize_target("url"), "_t_"
    )
    parts = UrlParts.staged("_t_")
    has_host = parts.valid & (parts.hostname != "")
    staged = stage(
        staged,
        {
            "_host": F.when(has_host, parts.hostname),
            "_site": F.when(has_host, F.concat(parts.scheme, F.lit("//"), parts.host_port)),
        },
    )
    joined = drop_parts(staged, "_t_").join(by_host, "_host", "left")
    return joined.select(
        "url",
        F.coalesce("_own", "_chain", "_by_host", "_site", "url").alias("root_target"),
        F.when(F.col("_own").isNotNull(), "seed")
        .when(F.col("_chain").isNotNull(), "chain")
        .when(F.col("_by_host").isNotNull(), "host")
        .when(F.col("_site").isNotNull(), "site")
        .otherwise("self")
        .alias("via"),
    )
