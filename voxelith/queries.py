"""Named queries of the operators over the star schema and embeddings, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelith.functions import metrics as M
from voxelith.functions.scoring import crypticity, druggability
from voxelith.operators import clusters as C
from voxelith.operators import ensembles as E
from voxelith.operators import evaluation as V
from voxelith.operators import grid as G
from voxelith.operators import spatial as S
from voxelith.operators.kernels import spring_forces
from voxelith.sinks import files as K
from voxelith.sources import structures as R
from voxelith.sources import tables as T
from voxelith.staging import fresh_path, staged

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
N_FRAMES = 7


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def keep(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Line items as pockets: the supplier is the structure, the part's group the cluster, the line number the frame.
def pockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("structure_id"), (F.col("l_partkey") % 20).alias("cluster_id"), (F.col("l_linenumber") - 1).alias("frame_idx"), F.lit(0).alias("source_ord"), F.col("l_orderkey").alias("pocket_idx"),
        ((F.col("l_orderkey") % 97) / 8.0).alias("cx"), ((F.col("l_partkey") % 89) / 8.0).alias("cy"), ((F.col("l_orderkey") % 83) / 8.0).alias("cz"),
        (F.col("l_quantity") * 12).alias("volume"), (F.col("l_discount") * 8).alias("enclosure"), (F.col("l_tax") * 10).alias("hydrophobic_fraction"), (F.col("l_orderkey") % 7).cast("int").alias("aromatic_count"),
    )


_P = """p as (select l_suppkey structure_id, l_partkey % 20 cluster_id, l_linenumber - 1 frame_idx, l_orderkey pocket_idx,
  (l_orderkey % 97) / 8.0 cx, (l_partkey % 89) / 8.0 cy, (l_orderkey % 83) / 8.0 cz,
  l_quantity * 12 volume, l_discount * 8 enclosure, l_tax * 10 hydrophobic_fraction, (l_orderkey % 7)::int aromatic_count from lineitem)"""
_COMPOSITE = """round((0.35 * exp(-(volume - 300) * (volume - 300) / (2 * 200.0::double * 200.0::double)) + 0.30 * greatest(0.0, least(1.0, enclosure)) + 0.25 * hydrophobic_fraction + 0.10 * least(aromatic_count / 5, 1.0))::decimal(18, 9), 4)::double"""
_S = f"""{_P}, s as (select *, {_COMPOSITE} score from p)"""
_STATS = f"""{_S}, g as (select structure_id, cluster_id, avg(cx) cx, avg(cy) cy, avg(cz) cz, round(avg(volume)::decimal(18, 9), 1)::double volume, round(min(volume), 1) volume_min, round(max(volume), 1) volume_max,
  round(coalesce(max(case when frame_idx = 0 then volume end), 0), 1) apo_volume, max(score) max_druggability, list_sort(list(distinct frame_idx)) appears_in_conformers, count(distinct frame_idx) nf, count(*) n_members from s group by all)"""
_FULL = f"""{_STATS}, r as (select structure_id, cluster_id, arg_min(score, o) druggability from (select s.structure_id, s.cluster_id, score, row_number() over (partition by s.structure_id, s.cluster_id order by
    round((s.cx - g.cx) * (s.cx - g.cx) + (s.cy - g.cy) * (s.cy - g.cy) + (s.cz - g.cz) * (s.cz - g.cz), 9), frame_idx, pocket_idx) o from s join g using (structure_id, cluster_id)) group by all),
  c as (select g.*, druggability, round((nf / {N_FRAMES})::decimal(18, 9), 3)::double persistence, nf / {N_FRAMES} < 0.9 cryptic,
    case when volume_max <= 0 then 0.0 else round((greatest(0.0, least(1.0, (volume_max - apo_volume) / volume_max)) * max_druggability)::decimal(18, 9), 4)::double end crypticity from g join r using (structure_id, cluster_id))"""


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.aggregate(pockets(spark, sf_dir), ["structure_id", "cluster_id"], N_FRAMES, ("frame_idx", "pocket_idx"))


@query(f"with {_P} select structure_id, pocket_idx, frame_idx, round(exp(-(volume - 300) * (volume - 300) / 80000.0::double)::decimal(18, 9), 4)::double volume_score, round(greatest(0.0, least(1.0, enclosure))::decimal(18, 9), 4)::double enclosure_score, round(least(aromatic_count / 5, 1.0)::decimal(18, 9), 4)::double aromatic_score, {_COMPOSITE} composite from p")
def score_pockets(spark, sf_dir):
    d = pockets(spark, sf_dir).withColumn("s", druggability())
    return d.select("structure_id", "pocket_idx", "frame_idx", "s.volume_score", "s.enclosure_score", "s.aromatic_score", "s.composite")


@query(f"with {_STATS} select structure_id, cluster_id, round(cx, 6) cx, round(cy, 6) cy, round(cz, 6) cz, volume, volume_min, volume_max, n_members from g")
def cluster_stats(spark, sf_dir):
    d = C.cluster_stats(C.scored(pockets(spark, sf_dir)), ["structure_id", "cluster_id"], N_FRAMES)
    return d.select("structure_id", "cluster_id", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "cz")), "volume", "volume_min", "volume_max", "n_members")


@query(f"with {_FULL} select structure_id, cluster_id, druggability from r")
def representative_member(spark, sf_dir):
    p = C.scored(pockets(spark, sf_dir))
    keys = ["structure_id", "cluster_id"]
    centroids = p.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in ("cx", "cy", "cz")))
    return C.representative(p, centroids, keys, ("frame_idx", "pocket_idx"))


@query(f"with {_STATS} select structure_id, cluster_id, apo_volume, max_druggability from g")
def apo_volume(spark, sf_dir):
    return C.cluster_stats(C.scored(pockets(spark, sf_dir)), ["structure_id", "cluster_id"], N_FRAMES).select("structure_id", "cluster_id", "apo_volume", "max_druggability")


@query(f"with {_STATS} select structure_id, cluster_id, round((nf / {N_FRAMES})::decimal(18, 9), 3)::double persistence, nf / {N_FRAMES} < 0.9 cryptic from g")
def persistence(spark, sf_dir):
    return C.cluster_stats(C.scored(pockets(spark, sf_dir)), ["structure_id", "cluster_id"], N_FRAMES).select("structure_id", "cluster_id", "persistence", "cryptic")


@query(f"with {_STATS} select structure_id, cluster_id, array_to_string(appears_in_conformers, ',') frames from g")
def frame_list(spark, sf_dir):
    d = C.cluster_stats(C.scored(pockets(spark, sf_dir)), ["structure_id", "cluster_id"], N_FRAMES)
    return d.select("structure_id", "cluster_id", F.array_join(F.transform("appears_in_conformers", lambda x: x.cast("string")), ",").alias("frames"))


@query("""with m as (select o_custkey % 50 cluster_id, l_linenumber frame_idx, 'R' || (l_partkey % 30) as label from orders join lineitem on o_orderkey = l_orderkey),
  n as (select cluster_id, count(distinct frame_idx) n from m group by 1), c as (select cluster_id, label, count(*) c from m group by 1, 2)
  select cluster_id, string_agg(label, ',' order by label) labels from c join n using (cluster_id) where c >= 6.0 * n group by 1""")
def consensus_labels(spark, sf_dir):
    o, li = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    m = o.join(li, o.o_orderkey == li.l_orderkey).select((F.col("o_custkey") % 50).alias("cluster_id"), F.col("l_linenumber").alias("frame_idx"), F.array(F.concat(F.lit("R"), (F.col("l_partkey") % 30).cast("string"))).alias("lining"))
    return C.consensus_labels(m, ["cluster_id"], "frame_idx", "lining", 6.0).select("cluster_id", F.array_join("lining_residues", ",").alias("labels"))


@query(f"with {_FULL} select structure_id, cluster_id, crypticity from c")
def crypticity_scores(spark, sf_dir):
    stats = C.cluster_stats(C.scored(pockets(spark, sf_dir)), ["structure_id", "cluster_id"], N_FRAMES)
    return stats.select("structure_id", "cluster_id", crypticity().alias("crypticity"))


_KEY = {"crypticity": "crypticity", "druggability": "max_druggability", "balanced": "max_druggability * (0.5::double + 0.5::double * persistence)", "persistence": "persistence * druggability"}


def _rank_query(strategy: str) -> None:
    sql = f"with {_FULL} select structure_id, cluster_id, row_number() over (partition by structure_id order by {_KEY[strategy]} desc, max_druggability desc, cluster_id) rank from c"

    def run(spark, sf_dir):
        return C.ranked(clusters(spark, sf_dir), strategy).select("structure_id", "cluster_id", "rank")

    run.__name__ = f"rank_{strategy}"
    query(sql)(run)


for _s in _KEY:
    _rank_query(_s)


@query(f"""with {_FULL}, k as (select *, row_number() over (partition by structure_id order by crypticity desc, max_druggability desc, cluster_id) rank from c),
  f as (select *, row_number() over (partition by structure_id order by rank) n from k where druggability >= 0.3 and persistence >= 0.1 and crypticity >= 0.05)
  select structure_id, cluster_id, rank, volume, volume_min, volume_max, apo_volume, druggability, max_druggability, persistence, cryptic, crypticity from f where n <= 10""")
def topk_filtered(spark, sf_dir):
    kept = C.reported(C.ranked(clusters(spark, sf_dir)), 0.3, 0.1, 0.05, 10)
    return kept.select("structure_id", "cluster_id", "rank", "volume", "volume_min", "volume_max", "apo_volume", "druggability", "max_druggability", "persistence", "cryptic", "crypticity")


# Orders and their customers as found and known residue sets.
def site_sets(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    found = li.groupBy((F.col("l_orderkey") % 500).alias("target"), F.col("l_linenumber").alias("rank")).agg(F.collect_set((F.col("l_partkey") % 40).cast("int")).alias("found"))
    known = li.where("l_linenumber = 1").groupBy((F.col("l_orderkey") % 500).alias("target")).agg(F.collect_set((F.col("l_suppkey") * 7 % 40).cast("int")).alias("known"))
    return found.join(known, "target")


_SITES = """f as (select l_orderkey % 500 target, l_linenumber rank, list(distinct (l_partkey % 40)::int) found from lineitem group by 1, 2),
  k as (select l_orderkey % 500 target, list(distinct (l_suppkey * 7 % 40)::int) known from lineitem where l_linenumber = 1 group by 1),
  o as (select target, rank, len(list_intersect(found, known)) i, len(found) nf, len(known) nk from f join k using (target)),
  m as (select target, rank, round(i / nk, 6) recall, round(i / (nf + nk - i), 6) jaccard, ((target * 13 + rank * 29) % 120) / 10.0::double as dist from o)"""


def site_metrics(spark, sf_dir):
    s = site_sets(spark, sf_dir)
    return s.select("target", "rank", F.round(M.recall(F.col("found"), F.col("known")), 6).alias("recall"), F.round(M.jaccard(F.col("found"), F.col("known")), 6).alias("jaccard"), (((F.col("target") * 13 + F.col("rank") * 29) % 120) / 10.0).alias("dist"))


@query(f"with {_SITES} select target, rank, recall, jaccard from m")
def jaccard_recall(spark, sf_dir):
    return site_metrics(spark, sf_dir).select("target", "rank", "recall", "jaccard")


@query(f"with {_SITES} select target, rank, jaccard >= 0.25 or dist <= 4.0 as hit from m")
def headline_hit(spark, sf_dir):
    return site_metrics(spark, sf_dir).select("target", "rank", M.headline_hit(F.col("jaccard"), F.col("dist")).alias("hit"))


@query(f"with {_SITES} select target, rank, jaccard >= 0.25 and dist <= 6.0 as hit from m")
def strict_hit(spark, sf_dir):
    return site_metrics(spark, sf_dir).select("target", "rank", M.strict_hit(F.col("jaccard"), F.col("dist")).alias("hit"))


@query(f"with {_SITES} select target, rank, recall >= 0.3 or dist <= 4.0 as legacy, jaccard >= 0.25 as by_jaccard, recall >= 0.3 as by_recall from m")
def legacy_hit(spark, sf_dir):
    return site_metrics(spark, sf_dir).select("target", "rank", M.legacy_hit(F.col("recall"), F.col("dist")).alias("legacy"), M.overlap_hit(F.col("jaccard"), 0.25).alias("by_jaccard"), M.overlap_hit(F.col("recall"), 0.3).alias("by_recall"))


@query(f"with {_SITES}, b as (select target, arg_min(jaccard, (-jaccard, rank)) best, arg_min(rank, (-jaccard, rank)) r from m where rank <= 5 group by 1) select target, best, case when best > 0 then r end best_rank from b")
def best_in_topn(spark, sf_dir):
    return V.best_in_top(site_metrics(spark, sf_dir), ["target"], "jaccard", 5)


@query(f"with {_SITES} select target, " + ", ".join(f"coalesce(bool_or(case when rank <= {k} then jaccard >= 0.25 or dist <= 4.0 end), false) top{k}" for k in V.CURVE) + " from m group by 1")
def topk_curve(spark, sf_dir):
    return V.hit_curve(site_metrics(spark, sf_dir), ["target"], M.headline_hit(F.col("jaccard"), F.col("dist")))


@query(f"with {_SITES}, t as (select target, " + ", ".join(f"coalesce(bool_or(case when rank <= {k} then jaccard >= 0.25 or dist <= 4.0 end), false) t{k}" for k in V.CURVE) + " from m group by 1) select target, " + " || ' ' || ".join(f"'{k}=' || t{k}" for k in V.CURVE) + " as hits, t5 as top5 from t")
def hit_maps(spark, sf_dir):
    found = V.hit_map(topk_curve(spark, sf_dir), ["target"])
    text = F.array_join(F.transform(F.array_sort(F.map_entries("topk_hit")), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), " ")
    return found.select("target", text.alias("hits"), F.element_at("topk_hit", 5).alias("top5"))


@query(f"with {_SITES}, t as (select target, " + ", ".join(f"max(case when rank <= {k} then (jaccard >= 0.25 or dist <= 4.0)::int else 0 end) t{k}" for k in V.CURVE) + " from m group by 1) " + " union all ".join(f"select {k} k, round(avg(t{k}), 6) rate from t" for k in V.CURVE))
def topk_summary(spark, sf_dir):
    return V.curve_summary(topk_curve(spark, sf_dir)).select("k", F.round("rate", 6).alias("rate"))


@query(f"with {_SITES} select count(*) n, " + ", ".join(f"count_if(jaccard >= {t})::bigint ge_{round(t * 100)}" for t in (0.20, 0.25, 0.30)) + " from m")
def threshold_sweep(spark, sf_dir):
    return V.threshold_sweep(site_metrics(spark, sf_dir), "jaccard")


@query("select coalesce(c, 'ALL') category, coalesce(m, 'ALL') mechanism, hits, n from (select o_orderpriority c, o_orderstatus m, count_if(o_totalprice >= 150000)::bigint hits, count(*) n from orders group by rollup (o_orderpriority, o_orderstatus))")
def rollup_mechanisms(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumnsRenamed({"o_orderpriority": "category", "o_orderstatus": "mechanism"})
    return V.rollup_hits(o, "category", F.col("o_totalprice") >= 150000, "mechanism")


@query("select o_orderkey target_id, o_orderpriority category from orders where o_orderpriority = '1-URGENT' and o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING') order by o_orderkey limit 25")
def target_subset(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("target_id"), F.col("o_orderpriority").alias("category"), "o_custkey")
    ids = o.join(read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("target_id")
    return V.chosen_targets(o, "target_id", category="1-URGENT", ids=ids, limit=25).select("target_id", "category")


@query("select o_orderpriority fold, count(c_custkey) found, count(*) - count(c_custkey) skipped from orders left join (select c_custkey from customer where c_acctbal > 0) c on o_custkey = c_custkey group by 1")
def fold_join(spark, sf_dir):
    folds = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("fold"), F.col("o_custkey").alias("id"))
    return V.fold_counts(folds, read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), "c_name"))


@query("""select o_orderkey target_id, '{"target_id":' || o_orderkey || ',"status":"' || o_orderstatus || '","rank":' || case when o_custkey % 7 = 0 then 'null' else (o_custkey % 20)::varchar end || '}' as result from orders""")
def results_json(spark, sf_dir):
    rank = F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey") % 20)
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("target_id"), F.col("o_orderstatus").alias("status"), rank.alias("rank"))
    return K.results_json(o, "target_id")


@query("select coalesce(c, 'ALL') category, hits, n from (select o_orderpriority c, count_if(o_totalprice >= 150000)::bigint hits, count(*) n from orders group by rollup (o_orderpriority))")
def rollup_categories(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), "o_totalprice")
    return V.rollup_hits(o, "category", F.col("o_totalprice") >= 150000)


_TOOLS = ("click", "view", "purchase")


@query("""with w as (select user_id, max(case when event_type = 'click' then (value >= 40)::int end) click, max(case when event_type = 'view' then (value >= 40)::int end) "view", max(case when event_type = 'purchase' then (value >= 40)::int end) purchase from events group by 1),
  c as (select * from w where click is not null and "view" is not null and purchase is not null),
  s as (select count(*) n, coalesce(sum(click), 0)::bigint hits_click, coalesce(sum("view"), 0)::bigint hits_view, coalesce(sum(purchase), 0)::bigint hits_purchase, count_if(click = 1 and "view" + purchase = 0)::bigint only_click, count_if("view" = 1 and click + purchase = 0)::bigint only_view, count_if(purchase = 1 and click + "view" = 0)::bigint only_purchase,
  count_if(click + "view" + purchase = 0)::bigint "none", count_if(click + "view" + purchase > 0)::bigint "any" from c) select *, greatest(hits_click, hits_view, hits_purchase) best_single from s""")
def complementarity(spark, sf_dir):
    return V.complementarity(read(spark, sf_dir, "events"), "user_id", "event_type", F.col("value") >= 40, _TOOLS)


@query("select o_custkey, o_orderkey, round(avg(case when o_totalprice >= 150000 then 1.0::double else 0.0::double end) over (partition by o_custkey order by o_orderkey rows unbounded preceding), 6) rate from orders")
def running_rate(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return V.running_rate(o, ["o_orderkey"], F.col("o_totalprice") >= 150000, ["o_custkey"]).select("o_custkey", "o_orderkey", F.round("rate", 6).alias("rate"))


@query("select o_orderkey, round(avg(case when o_totalprice >= 150000 then 1.0::double else 0.0::double end) over (order by o_orderkey rows unbounded preceding), 6) rate from orders")
def running_rate_of_all(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return V.running_rate(o, ["o_orderkey"], F.col("o_totalprice") >= 150000).select("o_orderkey", F.round("rate", 6).alias("rate"))


# Embeddings as points: the first three components, scaled; the label is the frame.
def points(spark, sf_dir, scale: float = 40.0) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")

    def hundredths(v):  # what rounds to zero keeps its sign, as in SQL
        r = F.round(v, 2)
        return F.when(r == 0, F.signum(v) * 0.0).otherwise(r)

    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("frame_idx"), *(hundredths(F.col("embedding")[k].cast("double") * scale).alias(c) for k, c in enumerate("xyz")))


_PT = "pt as (select vec_id id, label frame_idx, round(embedding[1]::double * 40, 2) x, round(embedding[2]::double * 40, 2) y, round(embedding[3]::double * 40, 2) z from embeddings)"


def _other(p: DataFrame) -> DataFrame:
    return p.select(F.col("id").alias("id2"), "frame_idx", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"))


@query(f"with {_PT} select a.id, b.id id2, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), 4) dist2 from pt a join pt b on a.frame_idx = b.frame_idx and a.id < b.id and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 8.003 * 8.003")
def range_join_pairs(spark, sf_dir):
    p = points(spark, sf_dir)
    return S.range_join(p, _other(p), 8.003, right_xyz=("x2", "y2", "z2"), on=["frame_idx"]).where("id < id2").select("id", "id2", F.round("dist2", 4).alias("dist2"))


@query(f"with {_PT} select a.id, count(*) contacts from pt a join pt b on a.id <> b.id and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 5.003 * 5.003 group by 1")
def contact_pairs(spark, sf_dir):
    p = points(spark, sf_dir)
    return S.range_join(p, _other(p).drop("frame_idx"), 5.003, right_xyz=("x2", "y2", "z2")).where("id <> id2").groupBy("id").agg(F.count("*").alias("contacts"))


@query(f"with {_PT} select id from pt a where frame_idx <> 0 and exists (select 1 from pt b where b.frame_idx = 0 and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 4.503 * 4.503)")
def ligand_semi_join(spark, sf_dir):
    p = points(spark, sf_dir)
    return S.range_join(p.where("frame_idx <> 0"), p.where("frame_idx = 0"), 4.503, how="left_semi").select("id")


@query(f"with {_PT}, c as (select frame_idx rank, avg(x) rx, avg(y) ry, avg(z) rz from pt group by 1), d as (select id, rank, round((x - rx) * (x - rx) + (y - ry) * (y - ry) + (z - rz) * (z - rz), 9) d2 from pt, c), b as (select id, d2, rank, row_number() over (partition by id order by d2, rank) n from d) select id, round(sqrt(d2), 6) distance, rank nearest from b where n = 1")
def nearest_centroid(spark, sf_dir):
    p = points(spark, sf_dir)
    c = p.groupBy(F.col("frame_idx").alias("rank")).agg(F.avg("x").alias("rx"), F.avg("y").alias("ry"), F.avg("z").alias("rz"))
    near = S.nearest(p, c, ["id"], "rank", right_xyz=("rx", "ry", "rz"))
    return near.select("id", F.round("distance", 6).alias("distance"), "nearest")


@query(f"""with {_PT}, d as (select a.id, b.id rank, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), 9) d2 from pt a join pt b on a.frame_idx = b.frame_idx and a.id % 2 = 0 and b.id % 2 = 1),
  b as (select *, row_number() over (partition by id order by d2, rank) n from d) select id, round(sqrt(d2), 6) distance, rank nearest from b where n = 1""")
def nearest_in_frame(spark, sf_dir):
    p = points(spark, sf_dir)
    right = _other(p.where("id % 2 = 1"))
    near = S.nearest(p.where("id % 2 = 0"), right, ["id"], "id2", ["frame_idx"], right_xyz=("x2", "y2", "z2"))
    return near.select("id", F.round("distance", 6).alias("distance"), "nearest")


@query(f"with {_PT}, k as (select distinct p_partkey % 10 frame_idx, p_size % 3 chain_id, p_partkey % 40 res_seq from part where p_size > 30) select frame_idx, round(avg(x), 6) cx, round(avg(y), 6) cy, round(avg(z), 6) cz, count(*) n_atoms from pt where id % 5 < 2 and (frame_idx, id % 3, id % 40) in (select (frame_idx, chain_id, res_seq) from k) group by 1")
def known_centroid(spark, sf_dir):
    atoms = points(spark, sf_dir).withColumns({"chain_id": F.col("id") % 3, "res_seq": F.col("id") % 40, "name": F.when(F.col("id") % 5 < 2, "CA").otherwise("CB")})
    known = read(spark, sf_dir, "part").where("p_size > 30").select((F.col("p_partkey") % 10).alias("frame_idx"), (F.col("p_size") % 3).alias("chain_id"), (F.col("p_partkey") % 40).alias("res_seq"))
    found = S.known_centroid(atoms, known, ["frame_idx"])
    return found.select("frame_idx", *(F.round(f"c{c}", 6).alias(f"c{c}") for c in "xyz"), "n_atoms")


@query(f"with {_PT} select frame_idx, round(avg(x), 6) cx, round(avg(y), 6) cy, round(avg(z), 6) cz from pt group by 1")
def centroid(spark, sf_dir):
    return points(spark, sf_dir).groupBy("frame_idx").agg(*(F.round(F.avg(c), 6).alias(f"c{c}") for c in "xyz"))


@query(f"with {_PT}, a as (select frame_idx, id aid, x ax, y ay, z az, y / 10 dx, z / 10 dy, x / 10 dz from pt where z >= 6), w as (select p.id, exp(-((x - ax) * (x - ax) + (y - ay) * (y - ay) + (z - az) * (z - az)) / 50.0) w, dx, dy, dz from pt p join a using (frame_idx)) select id, round(sum(w * dx) / (sum(w) + 1e-8), 5) dx, round(sum(w * dy) / (sum(w) + 1e-8), 5) dy, round(sum(w * dz) / (sum(w) + 1e-8), 5) dz from w group by 1")
def gaussian_propagate(spark, sf_dir):
    p = points(spark, sf_dir)
    a = p.where("z >= 6").select("frame_idx", *(F.col(c).alias(f"a{c}") for c in "xyz"), (F.col("y") / 10).alias("dx"), (F.col("z") / 10).alias("dy"), (F.col("x") / 10).alias("dz"))
    return S.gaussian_propagate(p, a, ["id"], 5.0, ["frame_idx"]).select("id", *(F.round(f"d{c}", 5).alias(f"d{c}") for c in "xyz"))


_TF = """tf as (select n_nationkey op_id, case when n_regionkey % 2 = 1 then -1.0::double else 1.0::double end r11, 0.0::double r12, 0.0::double r13, 0.0::double r21, case when n_regionkey % 2 = 1 then -1.0::double else 1 + n_nationkey * 0.0001::double end r22, 0.0::double r23,
  0.0::double r31, 0.0::double r32, 1.0::double r33, n_nationkey * 0.02::double tx, (n_nationkey % 3) * 0.06::double ty, 0.0::double tz from nation),
  ti as (select *, abs(r11 - 1) <= 1.01e-3::double and abs(r22 - 1) <= 1.01e-3::double and abs(tx) <= 0.1::double and abs(ty) <= 0.1::double is_identity from tf)"""


def operators_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as operators: turns about z for odd regions, else near identities that drift from it."""
    n = read(spark, sf_dir, "nation")
    turn = F.when(F.col("n_regionkey") % 2 == 1, -1.0)
    cells = {"r11": turn.otherwise(1.0), "r22": turn.otherwise(1 + F.col("n_nationkey") * 0.0001), "r33": F.lit(1.0), "tx": F.col("n_nationkey") * 0.02, "ty": (F.col("n_nationkey") % 3) * 0.06, "tz": F.lit(0.0)}
    names = [*(f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)), "tx", "ty", "tz"]
    return n.select(F.col("n_nationkey").alias("op_id"), *(cells.get(c, F.lit(0.0)).alias(c) for c in names))


@query(f"with {_PT}, {_TF} select id, op_id, round(r11 * x + tx, 7) + 0.0 x, round(r22 * y + ty, 7) + 0.0 y, round(z, 4) z from pt, ti where not is_identity")
def apply_transforms(spark, sf_dir):
    moved = S.apply_transforms(points(spark, sf_dir), operators_table(spark, sf_dir).where(~S.identity_transform()))
    return moved.select("id", "op_id", (F.round("x", 7) + 0.0).alias("x"), (F.round("y", 7) + 0.0).alias("y"), F.round("z", 4).alias("z"))


@query(f"with {_TF} select op_id, is_identity from ti")
def identity_filter(spark, sf_dir):
    return operators_table(spark, sf_dir).select("op_id", S.identity_transform().alias("is_identity"))


@query("select p.p_partkey, coalesce(f.q, p.p_size::double) p_size, f.q is not null matched from part p left join (select l_partkey, arg_min(l_quantity, (l_orderkey, l_linenumber)) q from lineitem where l_discount > 0.08 group by 1) f on p_partkey = l_partkey")
def remap_left_join(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"))
    li = read(spark, sf_dir, "lineitem").where("l_discount > 0.08").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").alias("p_size"), "l_orderkey", "l_linenumber")
    return S.remap_first(p, li, ["p_partkey"], ["l_orderkey", "l_linenumber"], ["p_size"])


@query("select c_custkey, coalesce(f.s, 'none:' || c_custkey) status from customer left join (select o_custkey, arg_max(o_orderstatus, o_orderkey) s from orders group by 1) f on c_custkey = o_custkey")
def label_resolve(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey")
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"), "o_orderkey")
    return S.resolve_last(c, o, ["c_custkey"], ["o_orderkey"], "status", F.concat(F.lit("none:"), F.col("c_custkey").cast("string")))


# Grids of the points of each frame.
_FR = ["frame_idx"]
_GRID = f"""{_PT}, ext as (select frame_idx, min(x) - 5 lox, min(y) - 5 loy, min(z) - 5 loz, max(x) hx, max(y) hy, max(z) hz from pt group by 1),
  g as (select frame_idx, lox, loy, loz, (ceil(hx + 5 - lox) + 1)::int nx, (ceil(hy + 5 - loy) + 1)::int ny, (ceil(hz + 5 - loz) + 1)::int nz from ext),
  v as (select distinct frame_idx, greatest(0, least(nx - 1, round_even(x - lox, 0)::int)) i, greatest(0, least(ny - 1, round_even(y - loy, 0)::int)) j, greatest(0, least(nz - 1, round_even(z - loz, 0)::int)) k from pt join g using (frame_idx))"""
_IN = "i >= 0 and i < nx and j >= 0 and j < ny and k >= 0 and k < nz"


def _cube(n: int, keep: str) -> str:
    return f"(select a di, b dj, c dk, a * a + b * b + c * c d2 from range(-{n}, {n} + 1) t1(a), range(-{n}, {n} + 1) t2(b), range(-{n}, {n} + 1) t3(c) where {keep})"


_MASK = f"{_GRID}, m as (select distinct frame_idx, i, j, k from (select v.frame_idx, i + di i, j + dj j, k + dk k from v, {_cube(1, 'a * a + b * b + c * c <= 2')}) q join g using (frame_idx) where {_IN})"
_FIELD = f"""{_MASK}, o7 as (select a o from range(-7, 8) t(a)), f1 as (select frame_idx, i + o i, j, k, min(o * o) d2 from m, o7 group by 1, 2, 3, 4), f2 as (select frame_idx, i, j + o j, k, min(d2 + o * o) d2 from f1, o7 group by 1, 2, 3, 4),
  f as (select frame_idx, i, j, k, d2::int d2 from (select frame_idx, i, j, k + o k, min(d2 + o * o) d2 from f2, o7 group by 1, 2, 3, 4) q join g using (frame_idx) where d2 > 0 and d2 <= 59 and {_IN})"""


def _voxels(spark, sf_dir):
    p = points(spark, sf_dir)
    g = G.extents(p, _FR)
    return G.voxelize(p, g, _FR), g


@query(f"with {_GRID} select frame_idx, round(lox, 4) lox, round(loy, 4) loy, round(loz, 4) loz, nx, ny, nz from g")
def grid_extents(spark, sf_dir):
    g = G.extents(points(spark, sf_dir), _FR)
    return g.select("frame_idx", *(F.round(f"lo{c}", 4).alias(f"lo{c}") for c in "xyz"), "nx", "ny", "nz")


@query(f"with {_GRID} select frame_idx, i, j, k from v")
def voxelize(spark, sf_dir):
    return _voxels(spark, sf_dir)[0]


@query(f"with {_MASK} select frame_idx, count(*) n, sum(i)::bigint si, sum(j)::bigint sj, sum(k)::bigint sk from m group by 1")
def protein_mask(spark, sf_dir):
    v, g = _voxels(spark, sf_dir)
    return G.protein_mask(v, g, _FR).groupBy("frame_idx").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{c}") for c in "ijk"))


@query(f"with {_FIELD} select frame_idx, d2, count(*) n, sum(i + 2 * j + 3 * k)::bigint s from f group by 1, 2")
def distance_field(spark, sf_dir):
    v, g = _voxels(spark, sf_dir)
    return G.distance_field(G.protein_mask(v, g, _FR), g, _FR).groupBy("frame_idx", "d2").agg(F.count("*").alias("n"), F.sum(F.col("i") + 2 * F.col("j") + 3 * F.col("k")).alias("s"))


def _alpha(spark, sf_dir):
    v, g = _voxels(spark, sf_dir)
    mask = G.protein_mask(v, g, _FR)
    return G.alpha_points(G.distance_field(mask, g, _FR), _FR), mask, g


_ALPHA = f"""{_FIELD}, nb as (select f.frame_idx, f.i + di i, f.j + dj j, f.k + dk k, max(f.d2) best from f, {_cube(1, '1 = 1')} o group by 1, 2, 3, 4),
  al as (select f.* from f join nb using (frame_idx, i, j, k) where d2 = best and d2 >= 3 and d2 <= 36)"""


@query(f"with {_ALPHA} select frame_idx, i, j, k, d2 from al")
def alpha_points(spark, sf_dir):
    return _alpha(spark, sf_dir)[0]


_DIL = f"{_ALPHA}, di as (select distinct frame_idx, i, j, k from (select al.frame_idx, i + di i, j + dj j, k + dk k from al, {_cube(4, 'abs(a) + abs(b) + abs(c) <= 4')} o) q join g using (frame_idx) where {_IN})"


@query(f"with {_DIL} select frame_idx, count(*) n, sum(i + 2 * j + 3 * k)::bigint s from di group by 1")
def dilate(spark, sf_dir):
    a, _, g = _alpha(spark, sf_dir)
    return G.dilate(a, g, _FR).groupBy("frame_idx").agg(F.count("*").alias("n"), F.sum(F.col("i") + 2 * F.col("j") + 3 * F.col("k")).alias("s"))


@query(f"with {_ALPHA}, c as (select al.frame_idx, al.i, al.j, al.k, count(m.i) c from al left join m on m.frame_idx = al.frame_idx and m.i between al.i - 4 and al.i + 4 and m.j between al.j - 4 and al.j + 4 and m.k between al.k - 4 and al.k + 4 group by 1, 2, 3, 4) select frame_idx, i, j, k, round(c / 729.0::double, 6) density from c")
def local_density(spark, sf_dir):
    a, mask, _ = _alpha(spark, sf_dir)
    return G.local_density(mask, a.drop("d2"), _FR).withColumn("density", F.round("density", 6))


_PARTS = f"""recursive {_DIL}, vx as (select frame_idx, i, j, k, row_number() over (partition by frame_idx order by i, j, k) id from di),
  e1 as (select a.frame_idx, a.id a, b.id b from vx a join vx b on b.frame_idx = a.frame_idx and b.i = a.i + 1 and b.j = a.j and b.k = a.k union all select a.frame_idx, a.id, b.id from vx a join vx b on b.frame_idx = a.frame_idx and b.i = a.i and b.j = a.j + 1 and b.k = a.k
    union all select a.frame_idx, a.id, b.id from vx a join vx b on b.frame_idx = a.frame_idx and b.i = a.i and b.j = a.j and b.k = a.k + 1), ed as (select * from e1 union all select frame_idx, b, a from e1),
  cc(frame_idx, id, label) using key (frame_idx, id) as (select frame_idx, id, id from vx union
    select c.frame_idx, c.id, min(n.label) from recurring.cc c join ed on ed.frame_idx = c.frame_idx and ed.a = c.id join cc n on n.frame_idx = ed.frame_idx and n.id = ed.b where n.label < c.label group by 1, 2),
  pt2 as (select frame_idx, id, dense_rank() over (partition by frame_idx order by label) component from cc)"""


@query(f"with {_PARTS} select frame_idx, component::int as component, count(*)::double as volume from pt2 join vx using (frame_idx, id) anti join m using (frame_idx, i, j, k) group by 1, 2")
def components(spark, sf_dir):
    a, mask, g = _alpha(spark, sf_dir)
    parts = G.components(G.dilate(a, g, _FR), _FR, block=16)
    return G.cavities(parts, mask, _FR)


@query(f"with {_PARTS} select frame_idx, i, j, k, component::int as component from pt2 join vx using (frame_idx, id)")
def labelled_voxels(spark, sf_dir):
    a, _, g = _alpha(spark, sf_dir)
    return G.components(G.dilate(a, g, _FR), _FR, block=8)


def _atoms(spark, sf_dir) -> DataFrame:
    p = points(spark, sf_dir)
    group = (F.col("id") % 97).cast("int")
    return p.select(F.lit("cloud").alias("structure_id"), "frame_idx", F.col("id").alias("serial"), "x", "y", "z", group.alias("res_idx"), F.concat(F.lit("ALA"), group.cast("string"), F.lit(":A")).alias("res_label"), (group % 2 == 0).alias("hydrophobic"), (group % 5 == 0).alias("aromatic"), F.lit(True).alias("is_anchor"))


def _describe_sql(cavity: str, whole: str, key: str) -> str:
    """Describe sets of voxels: cavity and whole are tables of frame_idx, the key, i, j, k; m is the mask, g the grids, pt the points."""
    return f"""dn as (select q.*, count(m.i) / 729.0::double w from (select distinct frame_idx, i, j, k from {whole}) q left join m on m.frame_idx = q.frame_idx and m.i between q.i - 4 and q.i + 4 and m.j between q.j - 4 and q.j + 4 and m.k between q.k - 4 and q.k + 4 group by all),
  enc as (select frame_idx, {key}, least(avg(w) / 0.4::double, 1.0) enclosure from {whole} join dn using (frame_idx, i, j, k) group by 1, 2),
  cen as (select frame_idx, {key}, count(*)::double volume, case when sum(w) > 1e-6 then sum(i * w) / sum(w) else avg(i) end ci, case when sum(w) > 1e-6 then sum(j * w) / sum(w) else avg(j) end cj, case when sum(w) > 1e-6 then sum(k * w) / sum(w) else avg(k) end ck from {cavity} join dn using (frame_idx, i, j, k) group by 1, 2),
  lin as (select distinct c.frame_idx, c.{key}, (p.id % 97)::int res from {cavity} c join g on g.frame_idx = c.frame_idx join pt p on p.frame_idx = c.frame_idx and (p.x - (c.i + lox)) * (p.x - (c.i + lox)) + (p.y - (c.j + loy)) * (p.y - (c.j + loy)) + (p.z - (c.k + loz)) * (p.z - (c.k + loz)) <= 25),
  rs as (select frame_idx, {key}, avg((res % 2 = 0)::int) hyd, count_if(res % 5 = 0)::int aro, string_agg('ALA' || res || ':A', ' ' order by res) lining from lin group by 1, 2),
  out as (select frame_idx, {key}, round(ci + lox, 6) cx, round(cj + loy, 6) cy, round(ck + loz, 6) cz, volume, round(enclosure, 6) enclosure, round(coalesce(hyd, 0), 6) hydrophobic_fraction, coalesce(aro, 0)::int aromatic_count, coalesce(lining, '') as lining from cen join enc using (frame_idx, {key}) join g using (frame_idx) left join rs using (frame_idx, {key}))"""


def _described(found: DataFrame, key: str) -> DataFrame:
    return found.select("frame_idx", key, *(F.round(c, 6).alias(c) for c in ("cx", "cy", "cz")), "volume", *(F.round(c, 6).alias(c) for c in ("enclosure", "hydrophobic_fraction")), "aromatic_count", F.array_join("lining_residues", " ").alias("lining"))


@query(f"""with {_PARTS}, wh as (select frame_idx, component, i, j, k from pt2 join vx using (frame_idx, id)), cv as (select * from wh anti join m using (frame_idx, i, j, k)),
  ok as (select frame_idx, component, (row_number() over (partition by frame_idx order by component) - 1)::int as pocket_idx from cv group by 1, 2 having count(*) between 80 and 1500), wo as (select frame_idx, pocket_idx, i, j, k from wh join ok using (frame_idx, component)), co as (select frame_idx, pocket_idx, i, j, k from cv join ok using (frame_idx, component)),
  {_describe_sql("co", "wo", "pocket_idx")} select * from out""")
def pockets_detect(spark, sf_dir):
    return _described(G.detect_pockets(_atoms(spark, sf_dir)), "pocket_idx")


@query(f"""with {_MASK}, ctr as (select frame_idx, 1 as proposal, avg(x) - any_value(lox) ai, avg(y) - any_value(loy) aj, avg(z) - any_value(loz) ak, any_value(nx) nx, any_value(ny) ny, any_value(nz) nz from pt join g using (frame_idx) group by 1),
  wo as (select frame_idx, proposal, i::int i, j::int j, k::int k from ctr, lateral (select unnest(range(greatest(floor(ai)::int - 4, 0), least(ceil(ai)::int + 4, nx - 1) + 1)) i), lateral (select unnest(range(greatest(floor(aj)::int - 4, 0), least(ceil(aj)::int + 4, ny - 1) + 1)) j), lateral (select unnest(range(greatest(floor(ak)::int - 4, 0), least(ceil(ak)::int + 4, nz - 1) + 1)) k)
    where (i - ai) * (i - ai) + (j - aj) * (j - aj) + (k - ak) * (k - ak) <= 16), co as (select * from wo anti join m using (frame_idx, i, j, k)), {_describe_sql("co", "wo", "proposal")} select * from out""")
def characterize(spark, sf_dir):
    atoms = _atoms(spark, sf_dir)
    centres = atoms.groupBy("structure_id", "frame_idx").agg(F.avg("x").alias("px"), F.avg("y").alias("py"), F.avg("z").alias("pz")).withColumn("proposal", F.lit(1))
    return _described(G.characterize(atoms, centres), "proposal")


def _ordered_points(spark, sf_dir) -> DataFrame:
    p = points(spark, sf_dir)
    return p.select((F.col("id") % 20).alias("structure_id"), "frame_idx", F.lit(0).alias("source_ord"), F.col("id").alias("pocket_idx"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"))


_GREEDY = f"""recursive {_PT}, o as (select id % 20 s, id, frame_idx, x, y, z, row_number() over (partition by id % 20 order by frame_idx, id) n from pt),
  r(s, n, id, c, k) as (select s, n, id, [{{'x': x, 'y': y, 'z': z, 'n': 1.0::double}}], 0 from o where n = 1 union all
    select s, n, id, case when best is not null then list_transform(c, lambda q, i: case when i = best + 1 then {{'x': q.x + (px - q.x) / (q.n + 1), 'y': q.y + (py - q.y) / (q.n + 1), 'z': q.z + (pz - q.z) / (q.n + 1), 'n': q.n + 1}} else q end)
      else list_append(c, {{'x': px, 'y': py, 'z': pz, 'n': 1.0::double}}) end, coalesce(best, len(c)::int)
    from (select s, n, id, c, px, py, pz, case when least <= 5.0 then list_position(d, least) - 1 end best from (select *, list_min(d) least from (
      select r.s, o.n, o.id, r.c, o.x px, o.y py, o.z pz, list_transform(r.c, lambda q: sqrt((q.x - o.x) * (q.x - o.x) + (q.y - o.y) * (q.y - o.y) + (q.z - o.z) * (q.z - o.z))) d from r join o on o.s = r.s and o.n = r.n + 1))))"""


@query(f"with {_GREEDY} select s structure_id, id pocket_idx, k::int cluster_id from r")
def greedy_cluster(spark, sf_dir):
    return E.greedy_cluster(_ordered_points(spark, sf_dir)).select("structure_id", "pocket_idx", "cluster_id")


@query()
def anm_modes(spark, sf_dir):
    return E.normal_modes(_small(spark, sf_dir), 5)


@query(f"with {_PT}, s as (select 's' || (id % 20) as structure_id, count(*) n from pt group by 1 having count(*) >= 6) select structure_id, true as solves, true as unit from s")
def mode_equations(spark, sf_dir):
    """Whether all modes of the dense kernel solve Hv = ev, with Hv summed over the springs between neighbouring cells of the points, and have length one."""
    atoms = _small(spark, sf_dir)
    n = 5
    modes = E.normal_modes(atoms, n)
    order = Window.partitionBy("structure_id").orderBy("serial")
    at = atoms.select("structure_id", (F.row_number().over(order) - 1).alias("i"), *(F.col(c).cast("double").alias(c) for c in "xyz"))
    part = modes.select("structure_id", "mode", "eigenvalue", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("vector") / 3).cast("int") - 1), lambda p: F.slice("vector", p * 3 + 1, 3))).alias("i", "v"))
    held = part.groupBy("structure_id", "i").agg(F.array_sort(F.collect_list(F.struct("mode", "eigenvalue", "v"))).alias("held"))
    # Points carry their part of all modes, so that pairs are summed where they arise.
    points_of = staged(at.join(held, ["structure_id", "i"]).select("structure_id", "i", *"xyz", F.transform("held", lambda m: m["eigenvalue"]).alias("e"), F.flatten(F.transform("held", lambda m: m["v"])).alias("v")), "modes")

    def forces(rows, others):
        import pandas as pd

        moves = [np.stack(x["v"].to_list()).reshape(len(x), -1, 3) if len(x) else np.zeros((0, 1, 3)) for x in (rows, others)]
        h = spring_forces(rows[list("xyz")].to_numpy(), moves[0], others[list("xyz")].to_numpy(), moves[1], 8.0) if len(rows) else ()  # a cell around others
        return rows[["structure_id", "i"]].assign(h=pd.Series([x.ravel() for x in h], rows.index, object))

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    product = S.range_map(points_of.drop("e"), points_of.select("structure_id", *"xyz", "v"), 8.0, forces, "structure_id string, i int, h array<double>", on=["structure_id"], partitions=tasks)
    rows = points_of.join(product, ["structure_id", "i"], "left")
    v = lambda k, a: F.get("v", F.lit(3 * k + a))
    off = [F.greatest(*(F.abs(F.get("h", F.lit(3 * k + a)) - F.get("e", F.lit(k)) * v(k, a)) for a in range(3))) for k in range(n)]
    length = [sum((v(k, a) * v(k, a) for a in (1, 2)), v(k, 0) * v(k, 0)) for k in range(n)]
    each = rows.groupBy("structure_id").agg(*(F.max(x).alias(f"off{k}") for k, x in enumerate(off)), *(F.sum(x).alias(f"n{k}") for k, x in enumerate(length)))
    every = lambda xs: F.forall(F.array(*xs), lambda x: x)  # noqa: E731  a mode that a small structure lacks is null
    return each.select("structure_id", every(F.coalesce(F.col(f"off{k}") < 1e-6, F.lit(k > 0)) for k in range(n)).alias("solves"), every(F.coalesce(F.abs(F.col(f"n{k}") - 1) < 1e-9, F.lit(k > 0)) for k in range(n)).alias("unit"))


@query()
def contact_modes(spark, sf_dir):
    return E.contact_normal_modes(_small(spark, sf_dir), 5, 8.0)


def _small(spark, sf_dir) -> DataFrame:
    return _atoms(spark, sf_dir).withColumn("structure_id", F.concat(F.lit("s"), (F.col("serial") % 20).cast("string")))


@query()
def nma_frames(spark, sf_dir):
    return E.generate(_small(spark, sf_dir), 3, "nma")


@query()
def random_frames(spark, sf_dir):
    return E.generate(_small(spark, sf_dir), 3, "random")


@query("with c as (select o_custkey, o_orderpriority, count(*) n, min(o_orderkey) f from orders group by 1, 2), r as (select *, row_number() over (partition by o_custkey order by n desc, f) k from c) select o_custkey, o_orderpriority, n from r where k = 1")
def principal_group(spark, sf_dir):
    return V.principal_group(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query("with r as (select l_orderkey, l_linenumber, l_quantity, row_number() over (partition by l_orderkey order by (l_returnflag = 'R')::int desc, l_extendedprice desc) k from lineitem) select l_orderkey, l_linenumber, l_quantity from r where k = 1")
def main_association(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").withColumn("flag", F.col("l_returnflag") == "R")
    return V.main_association(li, ["l_orderkey"], "flag", "l_extendedprice", ["l_linenumber", "l_quantity"])


@query("select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)")
def left_anti_resume(spark, sf_dir):
    done = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return K.not_done(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("""with l as (select user_id, event_type, arg_max(value, event_id) v from events group by 1, 2)
  select user_id, max(case when event_type = 'click' then v end) click, max(case when event_type = 'view' then v end) "view", max(case when event_type = 'purchase' then v end) purchase from l where event_type in ('click', 'view', 'purchase') group by 1
  having click is not null and "view" is not null and purchase is not null""")
def merge_legs_pivot(spark, sf_dir):
    last = V.latest(read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")
    return last.groupBy("user_id").pivot("event_type", list(_TOOLS)).agg(F.max("value")).dropna()


@query("select p_partkey, 'PRT' || p_size || ':' || chr(65 + (p_partkey % 26)::int) as label, p_size as number from part")
def parse_labels(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("label", M.residue_label(F.lit("PRT"), F.col("p_size"), F.char(F.lit(65) + F.col("p_partkey") % 26)))
    return p.select("p_partkey", "label", M.residue_numbers(F.array("label"))[0].alias("number"))


@query("select p_partkey, printf('ATOM  %5d  %-3s %3s %s%4d%s   %8.3f%8.3f%8.3f  1.00  0.00          %2s', p_partkey % 99999, 'CA', 'ALA', 'A', p_size, case when p_size % 4 = 0 then 'B' else ' ' end, p_size * 1.5::double, -p_size * 0.25::double, (p_partkey % 100) * 1.0::double, 'C') as line from part")
def fixed_width_format(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("structure_id"), (F.col("p_partkey") % 99999 - 1).alias("serial"), F.lit("CA").alias("name"), F.lit("ALA").alias("res_name"), F.lit("A").alias("chain_id"), F.col("p_size").alias("res_seq"), F.when(F.col("p_size") % 4 == 0, "B").otherwise("").alias("icode"), (F.col("p_size") * 1.5).alias("x"), (F.col("p_size") * -0.25).alias("y"), (F.col("p_partkey") % 100).cast("double").alias("z"), F.lit("C").alias("element"))
    return K.structure_pdb(p).select(F.col("structure_id").alias("p_partkey"), "line")


def _sites(spark, sf_dir) -> DataFrame:
    """Orders as ranked clusters with values that print the same everywhere: halves, whole numbers and short texts."""
    o = read(spark, sf_dir, "orders").where("o_orderkey % 40 < 8")
    k = F.col("o_orderkey")
    half = lambda c, n: ((c % n) / 2.0)
    return o.select(
        (k % 8).alias("structure_id"), F.floor(k / 8).cast("int").alias("cluster_id"), F.floor(k / 8).cast("int").alias("rank"), *(half(k, n).alias(c) for c, n in (("cx", 41), ("cy", 53), ("cz", 67))),
        (100 + half(k, 900)).alias("volume"), (50 + half(k, 300)).alias("volume_min"), (90 + half(k, 900)).alias("volume_max"), half(k, 700).alias("apo_volume"), F.lit(0.5).alias("druggability"), F.lit(0.75).alias("max_druggability"),
        ((k % 4 + 1) / 4.0).alias("persistence"), (k % 4 < 3).alias("cryptic"), half(k % 2, 2).alias("crypticity"), F.array(F.concat(F.lit("ALA"), (k % 90).cast("string"), F.lit(":A")), F.lit("GLY7:B")).alias("lining_residues"), F.array(F.lit(0), (k % 5 + 1).cast("int")).alias("appears_in_conformers"),
    )


_SITE = """st as (select o_orderkey % 8 structure_id, (o_orderkey // 8)::int rank, (o_orderkey % 41) / 2.0::double cx, (o_orderkey % 53) / 2.0::double cy, (o_orderkey % 67) / 2.0::double cz, 100 + (o_orderkey % 900) / 2.0::double volume, 50 + (o_orderkey % 300) / 2.0::double volume_min,
  90 + (o_orderkey % 900) / 2.0::double volume_max, (o_orderkey % 700) / 2.0::double apo_volume, (o_orderkey % 4 + 1) / 4.0::double persistence, o_orderkey % 4 < 3 cryptic, (o_orderkey % 2) / 2.0::double crypticity, 'ALA' || (o_orderkey % 90) || ':A' lining, (o_orderkey % 5 + 1)::int frame from orders where o_orderkey % 40 < 8)"""


@query(f"""with {_SITE}, p as (select structure_id, rank, crypticity, '{{"rank":' || rank || ',"centroid":[' || cx || ',' || cy || ',' || cz || '],"volume_A3":' || volume || ',"volume_range_A3":[' || volume_min || ',' || volume_max || '],"apo_volume_A3":' || apo_volume
  || ',"druggability":0.5,"max_druggability":0.75,"persistence":' || persistence || ',"cryptic":' || cryptic || ',"crypticity":' || crypticity || ',"lining_residues":["' || lining || '","GLY7:B"],"appears_in_conformers":[0,' || frame || ']}}' j from st)
  select structure_id, '{{"protein":' || structure_id || ',"n_conformers":7,"ranked_by":"crypticity","n_pockets_found":' || count(*) || ',"n_cryptic_pockets":' || count_if(crypticity >= 0.3) || ',"pockets":[' || string_agg(j, ',' order by rank) || ']}}' as report from p group by 1""")
def json_report(spark, sf_dir):
    return K.reports(_sites(spark, sf_dir), N_FRAMES, "crypticity")


_POINT = "(0, 'C', 0, 0, 0), (1, 'C2', 1, 0, 0), (2, 'C3', -1, 0, 0), (3, 'C4', 0, 1, 0), (4, 'C5', 0, -1, 0), (5, 'C6', 0, 0, 1), (6, 'C7', 0, 0, -1)"


@query(f"with {_SITE}, a as (select * from (values {_POINT}) t(n, name, ax, ay, az)), r as (select *, pow(3 * volume / (4 * 3.14159::double), 1 / 3) r from st) select structure_id, rank, n + 1 line_no, printf('HETATM%5d  %-3s POC P%4d    %8.3f%8.3f%8.3f  1.00  0.50           C', (rank - 1) * 7 + n + 1, name, rank, cx + ax * r, cy + ay * r, cz + az * r) as line from r, a")
def pocket_atoms(spark, sf_dir):
    return K.pocket_pdb(_sites(spark, sf_dir))


@query("with e as (select distinct l_orderkey % 100 rank, chr(65 + (l_suppkey % 4)::int) as chain, (l_partkey % 60)::int n from lineitem) select rank, chain, string_agg(n, ',' order by n) numbers from e group by 1, 2")
def contacts_by_chain(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    label = M.residue_label(F.lit("ALA"), F.col("l_partkey") % 60, F.char(F.lit(65) + F.col("l_suppkey") % 4))
    c = li.groupBy((F.col("l_orderkey") % 100).alias("rank")).agg(F.collect_set(label).alias("lining_residues")).withColumn("structure_id", F.lit("s"))
    return K.contacts(c).select("rank", "chain", F.array_join(F.transform("numbers", lambda n: n.cast("string")), ",").alias("numbers"))


# The clusters of all pockets as ranked sites, centres in thousandths.
_RANKED = f"""{_FULL}, rk as (select structure_id, row_number() over (partition by structure_id order by crypticity desc, max_druggability desc, cluster_id) rank, round(cx::decimal(18, 9), 3)::double cx, round(cy::decimal(18, 9), 3)::double cy, round(cz::decimal(18, 9), 3)::double cz,
  volume, volume_min, volume_max, apo_volume, druggability, max_druggability, persistence, crypticity, ['ALA' || cluster_id || ':A', 'GLY7:B'] lining from c)"""


def _ranked_sites(spark, sf_dir) -> DataFrame:
    lining = F.array(F.concat(F.lit("ALA"), F.col("cluster_id").cast("string"), F.lit(":A")), F.lit("GLY7:B"))
    return C.ranked(clusters(spark, sf_dir)).withColumns({"lining_residues": lining} | {c: F.round(F.col(c).cast("decimal(18, 9)"), 3).cast("double") for c in ("cx", "cy", "cz")})


@query(f"with {_RANKED}, bx as (select *, printf('%.3f', 2 * (pow(3 * volume / (4 * 3.14159::double), 1 / 3) + 8)) s from rk) select structure_id, rank, printf('center_x = %.3f\ncenter_y = %.3f\ncenter_z = %.3f\n', cx, cy, cz) || 'size_x = ' || s || '\nsize_y = ' || s || '\nsize_z = ' || s || '\nexhaustiveness = 8\nnum_modes = 9\n' as text from bx")
def vina_box(spark, sf_dir):
    return K.vina_box(_ranked_sites(spark, sf_dir))


@query(f"with {_RANKED} select structure_id, rank, greatest(druggability, max_druggability) druggability, crypticity, printf('%.0f%%', persistence * 100) persistence, case when volume_max - volume_min > 50 then printf('%.0f -> %.0f', round_even(apo_volume, 0), round_even(volume_max, 0)) else printf('%.0f', round_even(volume, 0)) end volume, array_to_string(lining, ', ') residues from rk")
def console_table(spark, sf_dir):
    shown = K.console(_ranked_sites(spark, sf_dir).withColumn("rank", F.struct("structure_id", "rank")))
    return shown.select("rank.structure_id", "rank.rank", *shown.columns[1:])


@query(f"with {_SITE} select structure_id, rank, 'sequences:\n  - protein:\n      id: A\n      sequence: AG' || structure_id || '\n  - ligand:\n      id: LIG\n      smiles: SMILES_HERE\nconstraints:\n  - pocket:\n      binder: LIG\n      contacts:\n        - [A, ' || regexp_extract(lining, '([0-9]+)', 1) || ']\n        - [B, 7]\n' as text from st")
def constraint_text(spark, sf_dir):
    sites = _sites(spark, sf_dir)
    chains = sites.select("structure_id").distinct().select("structure_id", F.lit("A").alias("chain_id"), F.concat(F.lit("AG"), F.col("structure_id").cast("string")).alias("sequence"))
    return K.constraint_yaml(sites, chains)


@query(f"with {_P} select structure_id, pocket_idx, frame_idx from p where volume between 80 and 1500")
def volume_band(spark, sf_dir):
    return C.volume_band(pockets(spark, sf_dir)).select("structure_id", "pocket_idx", "frame_idx")


@query("select nation.n_name, count(distinct s_suppkey) n from supplier join nation on s_nationkey = n_nationkey group by 1 having n between 1 and 600")
def size_gate(spark, sf_dir):
    from voxelith.plans.discovery import size_gate as gate

    n = F.broadcast(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"))
    s = read(spark, sf_dir, "supplier").join(n, "s_nationkey").select(F.col("n_name").alias("structure_id"), F.col("s_suppkey").alias("res_idx"))
    return gate(s, 1, 600).groupBy(F.col("structure_id").alias("n_name")).agg(F.countDistinct("res_idx").alias("n"))


@query("with h as (select quality, count(*) n, count_if(toxic = 1) p from labels where quality is not null group by 1) select quality, n, round(p / n, 6) mean from h")
def bootstrap_ci(spark, sf_dir):
    lab = read(spark, sf_dir, "labels").where("quality is not null").withColumn("hit", F.col("toxic") == 1)
    return V.bootstrap(lab, "hit", ["quality"]).select("quality", "n", F.round("mean", 6).alias("mean"))


def _interval_sql(rows: str, value: str, statistic: str, group: str, seed: int = 0, resamples: int = 500) -> str:
    """The Poisson bootstrap in SQL: rows names key, groups and values; statistic is of w-weighted sums."""
    ws = ", ".join(f"sum(w * {v})::double {v}" for v in value.split(", "))
    own = ", ".join(f"sum({v})::double {v}" for v in value.split(", "))
    return f"""with b as ({rows}), d as (select *, {V.resample_weight_sql("key", "resample", seed)} w from b, range(1, {resamples} + 1) t(resample)),
  s as (select {group}, resample, sum(w)::double n, {ws} from d group by all), u as (select {group}, list_sort(list({statistic})) lst from s where n > 0 group by all),
  o as (select {group}, count(*)::bigint n, {own} from b group by all)
select {group}, n::bigint as n, round({statistic}, 6) as value, round(lst[floor(len(lst) * 0.025::double)::int + 1], 6) as lo, round(lst[floor(len(lst) * 0.975::double)::int], 6) as hi from o join u using ({group})"""


def _rounded(found: DataFrame, *keys: str) -> DataFrame:
    return found.select(*keys, "n", *(F.round(c, 6).alias(c) for c in ("value", "lo", "hi")))


@query(_interval_sql("select doc_id as key, quality, (toxic = 1)::int hit from labels where quality is not null and toxic is not null and doc_id is not null", "hit", "hit / n", "quality"))
def bootstrap_interval(spark, sf_dir):
    lab = read(spark, sf_dir, "labels").where("quality is not null")
    sums = V.bootstrap_sums(lab, "doc_id", {"hit": (F.col("toxic") == 1).cast("int")}, ["quality"], 500)
    return _rounded(V.bootstrap_interval(sums, F.col("hit") / F.col("n"), ["quality"]), "quality")


_PAIRED = """select user_id as key, 'all' as tools, a, b from (select user_id, max(case when event_type = 'click' then value end) a, max(case when event_type = 'view' then value end) b from events group by 1) where a is not null and b is not null"""


@query(_interval_sql(_PAIRED, "a, b", "(a - b) / n", "tools", 3))
def bootstrap_difference(spark, sf_dir):
    wide = read(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.max("value")).withColumn("tools", F.lit("all"))
    sums = V.bootstrap_sums(wide, "user_id", {"a": F.col("click"), "b": F.col("view")}, ["tools"], 500, seed=3)
    return _rounded(V.bootstrap_interval(sums, (F.col("a") - F.col("b")) / F.col("n"), ["tools"]), "tools")


@query(_interval_sql("select o_orderkey as key, o_orderpriority, (o_orderstatus = 'F')::int hit, o_totalprice price from orders", "hit, price", "1000000 * hit / price", "o_orderpriority", 5, 100))
def bootstrap_ratio(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    sums = V.bootstrap_sums(o, "o_orderkey", {"hit": (F.col("o_orderstatus") == "F").cast("int"), "price": F.col("o_totalprice")}, ["o_orderpriority"], 100, seed=5)
    return _rounded(V.bootstrap_interval(sums, 1000000 * F.col("hit") / F.col("price"), ["o_orderpriority"]), "o_orderpriority")


@query("with s as (select value s, event_type = 'purchase' y from events), r as (select s, y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double r from s) select round((sum(case when y then r end) - count_if(y) * (count_if(y) + 1) / 2.0::double) / (count_if(y) * count_if(not y)), 6) auc from r")
def auc_rank_sum(spark, sf_dir):
    return V.auc(read(spark, sf_dir, "events"), F.col("event_type") == "purchase", "value")


@query("with c as (select value s, count_if(event_type = 'purchase') p, count(*) c from events group by 1), r as (select p, sum(p) over (order by s desc) / sum(c) over (order by s desc) pr from c) select round(sum(p * pr) / sum(p), 6) average_precision from r")
def average_precision(spark, sf_dir):
    return V.average_precision(read(spark, sf_dir, "events"), F.col("event_type") == "purchase", "value")


@query("with r as (select user_id, event_type = 'purchase' y, row_number() over (partition by user_id order by value desc, event_id) k from events), g as (select user_id, max((y and k <= 5)::int) h, max(y::int) c from r group by 1) select round(avg(h), 6) recall, round(avg(c), 6) ceiling from g")
def topk_recall(spark, sf_dir):
    return V.top_k_recall(read(spark, sf_dir, "events"), "user_id", F.col("event_type") == "purchase", "value", 5, "event_id")


class _Linear:
    """A model whose score is a weighted sum of its features: value and hour."""

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("linear", F.col("value") + 3 * F.col("part"))


def _auc_sql(rows: str) -> str:
    return f"(select round((sum(case when y then r end) - count_if(y) * (count_if(y) + 1) / 2.0::double) / (count_if(y) * count_if(not y)), 6) from (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double r from ({rows})))"


_EV = "ev as (select event_id, value, user_id % 11 as part, event_type = 'purchase' y, row_number() over (order by event_id) k from events)"


@query(f"""with {_EV}, d0 as (select value v, row_number() over (order by md5(event_id::varchar || ':4'), event_id) k from ev), d1 as (select part v, row_number() over (order by md5(event_id::varchar || ':5'), event_id) k from ev)
  select 'value' as feature, round({_auc_sql("select y, value + 3 * part s from ev")} - {_auc_sql("select y, v + 3 * part s from ev join d0 using (k)")}, 6) as fall
  union all select 'part', round({_auc_sql("select y, value + 3 * part s from ev")} - {_auc_sql("select y, value + 3 * v s from ev join d1 using (k)")}, 6)""")
def permutation_importance(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "value", (F.col("user_id") % 11).alias("part"), (F.col("event_type") == "purchase").alias("y"))
    return V.permutation_importance(_Linear(), e, ["value", "part"], F.col("y"), F.col("linear"), "event_id", seed=4)


@query(f"with {_FULL}, k as (select *, row_number() over (partition by structure_id order by crypticity desc, max_druggability desc, cluster_id) rank from c), m as (select structure_id, cluster_id, avg(enclosure) a, max(enclosure) b, avg(aromatic_count) d, max(aromatic_count) e from s group by all) select structure_id, cluster_id, round(a, 6) mean_enclosure, round(b, 6) max_enclosure, round(d, 6) mean_aromatic_count, e max_aromatic_count, round(volume_max - volume_min, 4) volume_range, round(rank / count(*) over (partition by structure_id), 6) rank_fraction from k join m using (structure_id, cluster_id)")
def cluster_features(spark, sf_dir):
    f = V.cluster_features(C.ranked(clusters(spark, sf_dir)), pockets(spark, sf_dir), ["structure_id", "cluster_id"])
    return f.select("structure_id", "cluster_id", *(F.round(c, 6).alias(c) for c in ("mean_enclosure", "max_enclosure", "mean_aromatic_count")), "max_aromatic_count", F.round("volume_range", 4).alias("volume_range"), F.round("rank_fraction", 6).alias("rank_fraction"))


@query(f"with {_PT}, c as (select frame_idx, avg(x) rx, avg(y) ry, avg(z) rz from pt group by 1) select frame_idx, round(count_if((x - rx) * (x - rx) + (y - ry) * (y - ry) + (z - rz) * (z - rz) <= 64.0001) / count(*), 6) core from pt join c using (frame_idx) group by 1")
def hotspot_core(spark, sf_dir):
    p = points(spark, sf_dir)
    c = p.groupBy("frame_idx").agg(F.avg("x").alias("rx"), F.avg("y").alias("ry"), F.avg("z").alias("rz"))
    d = M.distance(*(F.col(k) for k in ("x", "y", "z", "rx", "ry", "rz")))
    return p.join(c, "frame_idx").groupBy("frame_idx").agg(F.round(F.count_if(d * d <= 64.0001) / F.count("*"), 6).alias("core"))


@query("select l_returnflag source, count(*) n, min(l_quantity) q from lineitem where l_returnflag in ('A', 'R') group by 1")
def detector_union(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    both = C.fused(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"))
    return both.groupBy("source_ord", F.col("l_returnflag").alias("source")).agg(F.count("*").alias("n"), F.min("l_quantity").alias("q")).drop("source_ord")


@query("with a as (select r_name, row_number() over (order by r_regionkey) - 1 pos from region), b as (select n_name, row_number() over (order by n_nationkey) - 1 pos from nation) select r_name, n_name, a.pos as position from a join b on a.pos = b.pos")
def positional_join(spark, sf_dir):
    from voxelith.sources.tables import by_position

    r = read(spark, sf_dir, "region").select(F.lit("all").alias("id"), F.col("r_regionkey").alias("res_idx"), "r_name")
    n = read(spark, sf_dir, "nation").select(F.lit("all").alias("id"), F.col("n_nationkey").cast("long").alias("position"), "n_name")
    return by_position(r, n.withColumn("position", F.col("position").cast("int"))).select("r_name", "n_name", "position")


@query("select c_custkey from customer order by md5(c_custkey::varchar || ':0'), c_custkey limit 50")
def seeded_sample(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey").orderBy(*V.seeded_order("c_custkey")).limit(50)


_HETERO = "['" + "','".join(("HOH", "ATP", "PE3", "ZN", "HEM", "NAG", "P33", "LIG")) + "']"


@query(f"select p_partkey, ({_HETERO})[p_size % 8 + 1] as res_name from part where p_size % 8 in (1, 4, 5, 7) and not (p_partkey % 25 in (select n_nationkey from nation where n_regionkey = 2) and p_size % 8 = 5)")
def solvent_filter(spark, sf_dir):
    p = read(spark, sf_dir, "part").select((F.col("p_partkey") % 25).alias("structure_id"), "p_partkey", F.get(F.array(*map(F.lit, ("HOH", "ATP", "PE3", "ZN", "HEM", "NAG", "P33", "LIG"))), (F.col("p_size") % 8).cast("int")).alias("res_name"))
    extras = read(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("structure_id"), F.lit("NAG").alias("res_name"))
    return R.without_solvents(p, extras).select("p_partkey", "res_name")


@query(f"""with {_PT}, h as (select id % 4 s, 'A/L' || (id % 3) || '/' || (id % 5) lig, id, x, y, z from pt where frame_idx <= 2 and id % 3 <> 2), k as (select s, lig, row_number() over (partition by s order by count(*) desc, min(id)) r from h group by 1, 2),
  l as (select h.* from h join k using (s, lig) where r = 1), p as (select id % 4 s, id % 50 res_seq, x, y, z from pt where frame_idx > 2)
  select 's' || s as structure_id, string_agg(distinct res_seq, ',' order by res_seq) known from p where exists (select 1 from l where l.s = p.s and (p.x - l.x) * (p.x - l.x) + (p.y - l.y) * (p.y - l.y) + (p.z - l.z) * (p.z - l.z) <= 4.503 * 4.503) group by 1""")
def known_site(spark, sf_dir):
    from voxelith.plans.discovery import known_site as site

    p = points(spark, sf_dir).withColumns({"structure_id": F.concat(F.lit("s"), (F.col("id") % 4).cast("string")), "pos": F.col("id")})
    hetero = p.where("frame_idx <= 2").select("structure_id", "pos", F.lit("A").alias("chain_id"), F.concat(F.lit("L"), (F.col("id") % 3).cast("string")).alias("res_name"), (F.col("id") % 5).alias("res_seq"), "x", "y", "z")
    protein = p.where("frame_idx > 2").select("structure_id", (F.col("id") % 50).alias("res_seq"), "x", "y", "z")
    found = site(hetero, protein, F.col("res_name") == "L2", 4.503)
    return found.select("structure_id", F.array_join(F.transform("known_residues", lambda x: x.cast("string")), ",").alias("known"))


# Files: each query writes its input from the tables to the shared folder, as the formats have it, and reads it back.
def written(rows: DataFrame, name: str, one: bool = False) -> str:
    """The folder that holds a table of one text column as files; one: a row is a file of its own name."""
    path = fresh_path(rows.sparkSession, name)
    rows.write.option("lineSep", "\n").option("maxRecordsPerFile", 1 if one else 0).text(path)
    return path


_NPY = f"""r as (select label g, vec_id, row_number() over (partition by label order by vec_id) - 1 pos, vec_id % 3 l from embeddings), lab as (select g, pos, l from r where g % 2 = 1 or pos < 20)"""


@query(f"""with {_NPY}, m as (select r.g, r.vec_id * 2 res_seq, lab.l from r join lab on r.g = lab.g and r.pos = lab.pos and r.vec_id % 11 <> 99), nr as (select g, count(*) n from r group by 1), nl as (select g, count(*) n from lab group by 1)
  select m.g::varchar as id, string_agg(case when l = 1 then res_seq end, ',' order by res_seq) as known, any_value(nr.n) n_residues, any_value(nl.n) n_labels, count(*) n_matched, count_if(l = 2)::bigint n_excluded from m join nr using (g) join nl using (g) group by 1""")
def npy_labels(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("id"), F.col("vec_id").alias("res_idx"), (F.col("vec_id") * 2).alias("res_seq"), (F.col("vec_id") % 3).alias("l"))
    lists = e.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("res_idx", "l"))), lambda s: s["l"]).alias("a"))
    lists = lists.withColumn("a", F.when(F.col("id").cast("int") % 2 == 1, F.col("a")).otherwise(F.slice("a", 1, 20)))
    header = F.rpad(F.concat(F.lit("{'descr': '|u1', 'fortran_order': False, 'shape': ("), F.size("a").cast("string"), F.lit(",), }")), 117, " ")
    digits = F.array_join(F.transform("a", lambda x: F.lpad(F.hex(x), 2, "0")), "")
    files = lists.select("id", F.unhex(F.concat(F.lit("934E554D505901007600"), F.hex(F.concat(header, F.lit("\n"))), digits)).alias("content"))
    found = T.labelled_site(e.select("id", "res_idx", "res_seq"), T.as_labels(T.npy_values(files)))
    return found.select("id", F.array_join(F.transform("known_residues", lambda x: x.cast("string")), ",").alias("known"), "n_residues", "n_labels", "n_matched", "n_excluded")


@query("""with a as (select vec_id % 4 structure_id, vec_id serial, row_number() over (partition by vec_id % 4 order by vec_id) p from embeddings where label = 0), f as (select vec_id % 4 structure_id, label frame_idx, row_number() over (partition by vec_id % 4, label order by vec_id) p, embedding[1] x, embedding[2] y, embedding[3] z from embeddings where label > 0)
  select a.structure_id, l.frame_idx, serial, round(coalesce(x, 0)::double, 6) x, round(coalesce(y, 0)::double, 6) y, round(coalesce(z, 0)::double, 6) z from a join (select distinct structure_id, frame_idx from f) l using (structure_id) left join f on f.structure_id = a.structure_id and f.frame_idx = l.frame_idx and f.p = a.p""")
def fitted_frames(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).alias("structure_id"), "vec_id", "label", *(F.col("embedding")[k].alias(c) for k, c in enumerate("xyz")))
    frames = e.where("label > 0").select("structure_id", F.col("label").alias("frame_idx"), F.col("vec_id").alias("position"), "x", "y", "z")
    fitted = E.fit_frames(e.where("label = 0").select("structure_id", F.col("vec_id").alias("serial")), frames)
    return fitted.select("structure_id", F.col("frame_idx").cast("long").alias("frame_idx"), "serial", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in "xyz"))


_NAMES = (*R.ONE_LETTER, "MSE", "UNK", "HOH")


def _backbone(spark, sf_dir) -> DataFrame:
    """Chains of 50 residues, a backbone atom N and C each, whose bonds break at multiples of 5 and 7."""
    e = read(spark, sf_dir, "embeddings").select("vec_id")
    names = F.array(*map(F.lit, _NAMES))
    place = (F.col("vec_id") % 50) * 3.0
    res = e.select(F.lit("s").alias("structure_id"), F.floor(F.col("vec_id") / 50).cast("string").alias("chain_id"), F.col("vec_id").alias("res_idx"), F.get(names, (F.col("vec_id") * 7 % len(_NAMES)).cast("int")).alias("res_name"), place.alias("p"), (F.col("vec_id") % 5 == 0).alias("five"), (F.col("vec_id") % 7 == 0).alias("seven"))
    n = res.select("structure_id", "chain_id", "res_idx", "res_name", F.lit("N").alias("name"), F.col("p").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    c = res.select("structure_id", "chain_id", "res_idx", "res_name", F.lit("C").alias("name"), (F.col("p") + F.when(F.col("five"), 1.0).otherwise(1.5)).alias("x"), F.when(F.col("seven"), 1.0).otherwise(0.0).alias("y"), F.lit(0.0).alias("z"))
    return n.unionByName(c)


_CODES = "[" + ", ".join([*(f"'{c}'" for c in R.ONE_LETTER.values()), "null", "null", "null"]) + "]"
_RUNS = f"""e as (select vec_id, (vec_id // 50)::varchar chain_id, ({_CODES})[vec_id * 7 % {len(_NAMES)} + 1] code from embeddings),
  l as (select *, lag(code) over w before, lag(vec_id) over w prev from e window w as (partition by chain_id order by vec_id)),
  b as (select *, case when code is not null and before is not null and prev = vec_id - 1 and prev % 5 <> 0 and prev % 7 <> 0 then 0 else 1 end brk from l),
  u as (select *, sum(brk) over (partition by chain_id order by vec_id) run from b),
  f as (select chain_id, run, count(*) n_residues, string_agg(code, '' order by vec_id) s from u where code is not null group by 1, 2 having count(*) > 1)"""


@query(f"with {_RUNS} select chain_id, (row_number() over (partition by chain_id order by run) - 1)::int as fragment, n_residues, s as sequence from f")
def peptide_fragments(spark, sf_dir):
    return R.fragments(_backbone(spark, sf_dir)).drop("structure_id")


@query(f"with {_RUNS} select chain_id, string_agg(s, '' order by run) as sequence from f group by 1")
def chain_sequences(spark, sf_dir):
    return R.sequences(_backbone(spark, sf_dir)).drop("structure_id")


def _drift(structure, n, options):
    """Frames that move by half a unit each along x, less one along z."""
    return [structure.xyz + [(k + 1) * options.get("step", 0.5), 0.0, -1.0] for k in range(n)]


@query(f"with {_PT} select 's' || (id % 20) as structure_id, f::int as frame_idx, id as serial, round(x + f * 0.5, 3) x, round(y, 3) y, round(z - least(f, 1), 3) z from pt, range(0, 4) t(f)")
def backend_frames(spark, sf_dir):
    E.register_backend("drift", _drift)
    made = E.generate(_small(spark, sf_dir), 3, "drift")
    E.forget_backend("drift")
    return made.select("structure_id", "frame_idx", "serial", *(F.round(F.col(c).cast("double"), 3).alias(c) for c in "xyz"))


@query(f"with {_PT} select 's' || (id % 20) as structure_id, f::int as frame_idx, id as serial, round(x + f * 0.5, 3) x, round(y, 3) y, round(z - least(f, 1), 3) z from pt, range(0, 3) t(f)")
def backend_table_function(spark, sf_dir):
    E.register_backend("drift", _drift)
    E.register_sql(spark, "make_frames")
    E.forget_backend("drift")
    _small(spark, sf_dir).select("structure_id", "serial", "x", "y", "z", "is_anchor").createOrReplaceTempView("voxelith_atoms")
    made = spark.sql("select * from make_frames(TABLE(voxelith_atoms) PARTITION BY (structure_id), 2, 'auto')")
    return made.select("structure_id", "frame_idx", "serial", *(F.round(F.col(c).cast("double"), 3).alias(c) for c in "xyz"))


@query(f"with {_PT} select 's' || (id % 20) as structure_id, count(*) * 4 as n, 0 as other, count(*) as input from pt group by 1")
def fallback_frames(spark, sf_dir):
    """With fewer than six anchors the elastic network gives way to random frames: how many places differ, and how many are the input's."""
    rank = F.row_number().over(Window.partitionBy("structure_id").orderBy("serial"))
    atoms = _small(spark, sf_dir).withColumn("is_anchor", rank <= 5)
    a, b = E.generate(atoms, 3, "nma", seed=5), E.generate(atoms, 3, "random", seed=5).withColumnsRenamed({c: f"{c}2" for c in "xyz"})
    both = a.join(b, ["structure_id", "frame_idx", "serial"]).join(atoms.select("structure_id", "serial", *(F.col(c).cast("float").alias(f"{c}0") for c in "xyz")), ["structure_id", "serial"])
    differs = (F.col("x") != F.col("x2")) | (F.col("y") != F.col("y2")) | (F.col("z") != F.col("z2"))
    own = (F.col("frame_idx") == 0) & (F.col("x") == F.col("x0")) & (F.col("y") == F.col("y0")) & (F.col("z") == F.col("z0"))
    return both.groupBy("structure_id").agg(F.count("*").alias("n"), F.count_if(differs).alias("other"), F.count_if(own).alias("input"))


@query(f"with {_PT}, a as (select 's' || (id % 20) as structure_id, id as serial, x, y, z, (id % 97)::int res from pt), f as (select *, 0 frame_idx from a union all select structure_id, serial, x + k, y, z - k, res, k from a, range(1, 3) t(k)) select structure_id, frame_idx::int as frame_idx, serial, round(x, 3) x, round(y, 3) y, round(z, 3) z, 'ALA' || res || ':A' as res_label from f")
def frames_union(spark, sf_dir):
    """The input's frame and those of another tool, with what is known of the residues; frames numbered below one are not taken."""
    from voxelith.plans.discovery import Settings, frames_of

    atoms = _small(spark, sf_dir)
    k = F.explode(F.array(*map(F.lit, (-1, 0, 1, 2))))
    given = atoms.withColumn("k", k).select("structure_id", F.col("k").alias("frame_idx"), "serial", (F.col("x") + F.col("k")).alias("x"), "y", (F.col("z") - F.col("k")).alias("z"))
    out = frames_of(atoms, Settings(n_conformers=2), given)
    return out.select("structure_id", "frame_idx", "serial", *(F.round(F.col(c).cast("double"), 3).alias(c) for c in "xyz"), "res_label")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@query(f"""with a as (select n_regionkey structure_id, n_nationkey::int serial, (n_nationkey // 2)::int res_idx, chr((65 + n_nationkey % 4)::int) chain_id, n_nationkey * 1.0::double x from nation), o as (select n_regionkey structure_id, s_suppkey op_id, s_suppkey * 1.0::double tx from supplier join nation on s_nationkey = n_nationkey where s_suppkey > 0),
  c as (select structure_id, list_sort(list(distinct chain_id)) chains, max(serial) + 1 ns, max(res_idx) + 1 nr from a group by 1), r as (select *, row_number() over (partition by structure_id order by op_id) - 1 nth from o),
  m as (select a.*, r.nth, r.tx, c.chains, ns, nr, list_filter(string_split('{_LETTERS}', ''), lambda l: not list_contains(c.chains, l)) free from a join r using (structure_id) join c using (structure_id))
  select structure_id, serial, chain_id, res_idx, x from a union all select structure_id, (serial + ns * (nth + 1))::int, coalesce(free[(nth * len(chains) + list_position(chains, chain_id))::int], chain_id || '+'), (res_idx + nr * (nth + 1))::int, x + tx from m""")
def assembly_chains(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    atoms = n.select(F.col("n_regionkey").alias("structure_id"), F.col("n_nationkey").cast("int").alias("serial"), F.floor(F.col("n_nationkey") / 2).cast("int").alias("res_idx"), F.char(65 + F.col("n_nationkey") % 4).alias("chain_id"), F.col("n_nationkey").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    supplier = read(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    ops = supplier.select(F.col("n_regionkey").alias("structure_id"), F.col("s_suppkey").alias("op_id"), *(F.lit(float(i == j)).alias(f"r{i}{j}") for i in (1, 2, 3) for j in (1, 2, 3)), F.col("s_suppkey").cast("double").alias("tx"), F.lit(0.0).alias("ty"), F.lit(0.0).alias("tz"))
    return E.assemble(atoms, ops).select("structure_id", "serial", "chain_id", "res_idx", "x")


_RES = ("ALA", "TRP", "GLY", "HIS", "SER")


@query(f"""with {_PT}, a as (select *, id // 60 s, (id % 60) // 4 r, row_number() over (partition by id // 60 order by id) - 1 serial from pt where id % 9 <> 0), n as (select *, (['N', 'CA', 'C', 'O'])[id % 4 + 1] as name, (['ALA', 'TRP', 'GLY', 'HIS', 'SER'])[(id // 4) % 5 + 1] res_name from a)
  select chr((65 + s % 26)::int) chain_id, serial::int serial, name, res_name, r::int res_seq, (dense_rank() over (partition by s order by r) - 1)::int res_idx, res_name || r || ':' || chr((65 + s % 26)::int) res_label, x, y, z, res_name in ('ALA', 'TRP') hydrophobic, res_name in ('TRP', 'HIS') aromatic, name = 'CA' is_anchor from n""")
def read_structures(spark, sf_dir):
    """Atoms of 60 points a file, with hetero rows, alternative places and a second model that are not read."""
    p = points(spark, sf_dir).withColumns({"s": F.floor(F.col("id") / 60).cast("int"), "r": F.floor((F.col("id") % 60) / 4).cast("int")})
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), k.cast("int"))
    atoms = p.select(F.col("s").alias("structure_id"), F.col("id").alias("serial"), pick(("N", "CA", "C", "O"), F.col("id") % 4).alias("name"), pick(_RES, F.floor(F.col("id") / 4) % 5).alias("res_name"), F.char(65 + F.col("s") % 26).alias("chain_id"), F.col("r").alias("res_seq"), "x", "y", "z", F.lit("C").alias("element"))
    rows = K.structure_pdb(atoms).withColumn("line", F.when(F.col("serial") % 9 == 0, F.concat(F.lit("HETATM"), F.substring("line", 7, 200))).otherwise(F.col("line")))
    twice = F.concat_ws("\n", "line", F.when(F.col("serial") % 5 == 0, F.col("line")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("serial", twice.alias("line")))), lambda x: x["line"]), "\n")
    files = rows.groupBy("structure_id").agg(text.alias("t"), F.max("line").alias("more")).select(F.concat(F.lit("MODEL        1\n"), "t", F.lit("\nENDMDL\nMODEL        2\n"), "more", F.lit("\nENDMDL")).alias("value"))
    found = R.read_structures(spark, written(files, "structures", one=True))
    return found.select("chain_id", "serial", "name", "res_name", "res_seq", "res_idx", "res_label", *(F.round(F.col(c).cast("double"), 2).alias(c) for c in "xyz"), "hydrophobic", "aromatic", "is_anchor")


@query(f"with {_PT}, m as (select id, id // 40 f, (id % 40) // 10 + 1 m, row_number() over (partition by id // 10 order by id) - 1 p, x, y, z from pt) select ((f * 0) + m)::int frame_idx, p::int as position, count(*) n, round(sum(x), 3) x, round(sum(y), 3) y, round(sum(z), 3) z from m group by 1, 2")
def read_model_files(spark, sf_dir):
    """Trajectories of four models of ten points a file, split by model as they are read; summed over the files."""
    p = points(spark, sf_dir).withColumn("f", F.floor(F.col("id") / 40))
    atoms = p.select(F.lit("s").alias("structure_id"), F.col("id").alias("serial"), F.lit("CA").alias("name"), F.lit("ALA").alias("res_name"), F.lit("A").alias("chain_id"), (F.col("id") % 10).cast("int").alias("res_seq"), "x", "y", "z", F.lit("C").alias("element"))
    rows = K.structure_pdb(atoms).withColumns({"f": F.floor(F.col("serial") / 40), "m": F.floor(F.col("serial") % 40 / 10)})
    model = rows.groupBy("f", "m").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("serial", "line"))), lambda x: x["line"]), "\n").alias("t"))
    text = F.concat(F.format_string("MODEL     %4d\n", F.col("m") + 1), F.col("t"), F.lit("\nENDMDL"))
    files = model.groupBy("f").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("m", text.alias("x")))), lambda x: x["x"]), "\n").alias("value")).select("value")
    found = R.read_frames(spark, written(files, "models", one=True))
    return found.groupBy("frame_idx", "position").agg(F.count("*").alias("n"), *(F.round(F.sum(F.col(c).cast("double")), 3).alias(c) for c in "xyz"))


@query(f"with {_PT} select frame_idx, string_agg(printf('%.2f/%.2f/%.2f', x, y, z), ' ' order by id) as coords from pt group by 1")
def coordinate_arrays(spark, sf_dir):
    found = R.coords_array(points(spark, sf_dir).withColumnRenamed("id", "serial"), ["frame_idx"])
    return found.select("frame_idx", F.array_join(F.transform("coords", lambda c: F.format_string("%.2f/%.2f/%.2f", c[0], c[1], c[2])), " ").alias("coords"))


@query(f"with {_TF} select op_id::int op_id, " + ", ".join(f"round({c}, 4) {c}" for c in ("r11", "r12", "r22", "r33", "tx", "ty", "tz")) + " from tf where op_id <> 3")
def read_operators(spark, sf_dir):
    """Operators as REMARK 350 rows; the one of nation 3 lacks its last row, and rows after the first atom do not count."""
    ops = operators_table(spark, sf_dir)
    row = lambda i: F.format_string(f"REMARK 350   BIOMT{i} %3d %9.6f %9.6f %9.6f     %10.5f", F.col("op_id"), *(F.col(f"r{i}{j}") for j in (1, 2, 3)), F.col(f"t{'xyz'[i - 1]}"))
    text = F.concat_ws("\n", row(1), row(2), F.when(F.col("op_id") != 3, row(3)))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("op_id", text.alias("t")))), lambda x: x["t"]), "\n")
    files = ops.agg(lines.alias("t")).select(F.concat("t", F.lit("\nATOM      1  CA  ALA A   1       0.000   0.000   0.000  1.00  0.00           C\nREMARK 350   BIOMT1 999  9.0 9.0 9.0 9.0")).alias("value"))
    found = R.read_biomt(spark, written(files, "operators"))
    return found.select("op_id", *(F.round(c, 4).alias(c) for c in ("r11", "r12", "r22", "r33", "tx", "ty", "tz")))


@query(f"with {_TF} select op_id::int op_id, " + ", ".join(f"round({c}, 4) {c}" for c in ("r11", "r12", "r22", "r33", "tx", "ty", "tz")) + " from tf where op_id <> 3")
def read_operators_cif(spark, sf_dir):
    ops = operators_table(spark, sf_dir)
    names = ["id", *(f"matrix[{i}][{j}]" for i in (1, 2, 3) for j in (1, 2, 3)), *(f"vector[{i}]" for i in (1, 2, 3))]
    cells = [F.col("op_id").cast("string"), *(F.format_string("%.6f", f"r{i}{j}") for i in (1, 2, 3) for j in (1, 2, 3)), F.format_string("%.5f", "tx"), F.format_string("%.5f", "ty"), F.when(F.col("op_id") == 3, "?").otherwise(F.format_string("%.5f", "tz"))]
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("op_id", F.concat_ws(" ", *cells).alias("t")))), lambda x: x["t"]), "\n")
    head = "data_x\nloop_\n" + "".join(f"_pdbx_struct_oper_list.{n}\n" for n in names)
    files = ops.agg(rows.alias("t")).select(F.concat(F.lit(head), "t", F.lit("\n#")).alias("value"))
    return R.read_oper_list(spark, written(files, "operators")).select("op_id", *(F.round(c, 4).alias(c) for c in ("r11", "r12", "r22", "r33", "tx", "ty", "tz")))


@query("""with p as (select s_suppkey k, n_regionkey g, row_number() over (partition by n_regionkey order by s_suppkey) r, s_acctbal a from supplier join nation on s_nationkey = n_nationkey) select g::int frame_idx, (r - 1)::int proposal, r::int rank, round(a, 2) px, k * 1.0::double py, 'ALA' || (k % 50) || ':A ' || (k % 7) || ':B' as residues from p""")
def read_proposals(spark, sf_dir):
    """Proposals of one detector's files, one a region, as proposals of frames; some rows do not parse."""
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    row = F.format_string("pocket , , %.2f, 0.5 , %.2f , %d.0, -1.5, A_%d B_%d", F.col("s_acctbal"), F.col("s_acctbal"), F.col("s_suppkey"), F.col("s_suppkey") % 50, F.col("s_suppkey") % 7)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("t")))), lambda x: x["t"]), "\n")
    files = s.groupBy("n_regionkey").agg(lines.alias("t")).select(F.concat(F.lit("name, rank, score, probability, center_x, center_y, center_z, residue_ids\n"), "t", F.lit("\nbroken, x\n")).alias("value"))
    found = T.read_proposals(spark, written(files, "proposals", one=True))
    names = spark.range(50).select(F.lit("A").alias("chain_id"), F.col("id").cast("int").alias("res_seq"), F.lit("ALA").alias("res_name"))
    labels = T.proposal_labels(found, names)
    regions = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("double").alias("py"), F.col("n_regionkey").cast("int").alias("g"))
    placed = T.proposals_of_frames(found.join(regions, "py"), F.col("g"))
    return placed.join(labels.select("py", "rank", "residues"), "py").select("frame_idx", "proposal", "rank", F.round("px", 2).alias("px"), "py", F.array_join("residues", " ").alias("residues"))


@query(f"with {_SITE} select structure_id::varchar protein, rank - 1 pos, rank, round(cx, 3) cx, volume, lining || ',GLY7:B' as lining from (select *, row_number() over (partition by structure_id order by rank) n from st) where n <= 5")
def read_reports(spark, sf_dir):
    text = K.reports(_sites(spark, sf_dir).withColumn("structure_id", F.col("structure_id").cast("string")), N_FRAMES, "crypticity")
    back = T.read_report(spark, written(text.select("report"), "reports", one=True) , 5)
    first = back.groupBy("protein").agg(F.min("rank").alias("low"))
    return back.join(first, "protein").select("protein", (F.col("rank") - 1).alias("pos"), F.col("rank").cast("int").alias("rank"), F.element_at("centroid", 1).alias("cx"), F.col("volume_A3").alias("volume"), F.array_join("lining_residues", ",").alias("lining"))


@query("select o_custkey::varchar id, chr((65 + o_orderkey % 3)::int) apo_chain, o_orderkey % 2 = 0 is_main, round(o_totalprice / 1000, 3) pRMSD, o_orderstatus || o_orderkey as selection from orders")
def read_dataset(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    one = F.struct(F.char(65 + F.col("o_orderkey") % 3).alias("apo_chain"), (F.col("o_orderkey") % 2 == 0).alias("is_main_holo_structure"), F.round(F.col("o_totalprice") / 1000, 3).alias("pRMSD"), F.array(F.concat("o_orderstatus", F.col("o_orderkey").cast("string"))).alias("apo_pocket_selection"))
    lists = o.groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.collect_list(one).alias("a"))
    maps = lists.groupBy(F.pmod(F.xxhash64("id"), F.lit(7))).agg(F.map_from_entries(F.collect_list(F.struct("id", "a"))).alias("m"))
    found = T.read_dataset(spark, written(maps.select(F.to_json("m").alias("value")), "dataset", one=True))
    return found.select("id", "apo_chain", F.col("is_main_holo_structure").alias("is_main"), F.round("pRMSD", 3).alias("pRMSD"), F.col("apo_pocket_selection")[0].alias("selection"))


@query("select o_orderpriority fold, o_orderkey::varchar id, c_name from orders join customer on o_custkey = c_custkey where c_acctbal > 5000")
def read_folds(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("fold"), F.col("o_orderkey").cast("string").alias("id"), "o_custkey")
    maps = o.groupBy("fold").agg(F.collect_list("id").alias("ids")).agg(F.map_from_entries(F.collect_list(F.struct("fold", "ids"))).alias("m"))
    folds = T.read_folds(spark, written(maps.select(F.to_json("m").alias("value")), "folds"))
    c = read(spark, sf_dir, "customer").where("c_acctbal > 5000")
    return V.join_folds(folds, o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("id", "c_name")).select("fold", "id", "c_name")


@query("select user_id::varchar id, event_type tool, round(arg_max(value, event_id), 3) jaccard, arg_max(event_id, event_id)::int n_known from events group by 1, 2")
def read_legs(spark, sf_dir):
    """Legs as JSON lines, in files that follow each other in order, between lines that are none."""
    leg = F.to_json(F.struct(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("tool"), F.col("value").alias("jaccard"), F.col("event_id").cast("int").alias("n_known")))
    e = read(spark, sf_dir, "events").select("event_id", leg.alias("value"))
    ends = spark.range(2).select(F.when(F.col("id") == 1, F.lit(2**63 - 1)).alias("event_id"), F.when(F.col("id") == 0, "not json").otherwise("").alias("value"))
    files = e.unionByName(ends).repartitionByRange("event_id").sortWithinPartitions("event_id").select("value")
    return T.read_legs(spark, written(files, "legs")).select("id", "tool", F.round("jaccard", 3).alias("jaccard"), "n_known")


@query("select p_partkey, p_size, round(p_retailprice, 2) p_retailprice, p_brand from part")
def read_features(spark, sf_dir):
    path = fresh_path(spark, "features")
    read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand").write.csv(path, header=True)
    return T.read_features(spark, path).select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_size").cast("long").alias("p_size"), F.round("p_retailprice", 2).alias("p_retailprice"), "p_brand")


@query("select p_size % 12 as pocket, string_agg(distinct p_partkey % 90, ',' order by p_partkey % 90) numbers from part group by 1")
def read_pocket_files(spark, sf_dir):
    """Pocket atom files, whose chain letters tell them apart."""
    p = read(spark, sf_dir, "part").select((F.col("p_size") % 12).alias("g"), F.col("p_partkey").alias("serial"), F.lit("CA").alias("name"), F.lit("ALA").alias("res_name"), F.char(65 + F.col("p_size") % 12).alias("chain_id"), (F.col("p_partkey") % 90).cast("int").alias("res_seq"), *(F.lit(1.0).alias(c) for c in "xyz"), F.lit("C").alias("element"))
    lines = K.structure_pdb(p.withColumnRenamed("g", "structure_id"))
    files = lines.groupBy("structure_id").agg(F.array_join(F.collect_list("line"), "\n").alias("value")).select("value")
    path = written(files, "pockets", one=True)
    sets = T.read_pocket_files(spark, path)
    chain = R.raw_atoms(spark, path).groupBy("structure_id").agg(F.min("chain_id").alias("c"))
    return sets.join(chain, "structure_id").select((F.ascii("c") - 65).cast("long").alias("pocket"), F.array_join(F.transform("res_seqs", lambda x: x.cast("string")), ",").alias("numbers"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
