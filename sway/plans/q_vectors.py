"""Vector consistency queries (V1-V5, A15) over ``embeddings``: vector 2k is
the "before" and 2k+1 the "after" of pair k."""

from __future__ import annotations

from pyspark.sql import functions as F

from sway.functions.vectors import as_double, nll_of_max
from sway.operators import consistency as C
from sway.plans.registry import register, table

ALPHA = 0.1  # consistency weight of the shipped training script
BATCH = 8
CLOUD = 8  # pairs of an example: the block of 8 consecutive pair ids
#: pair ids of a cloud that is solved block by block
LARGE_CLOUD = 1000

PAIRS_CTE = """e as (select vec_id // 2 as pair_id, vec_id % 2 as side, label, embedding from embeddings),
p as (select l.pair_id, l.label, l.embedding as a, r.embedding as b
      from e l join e r on l.pair_id = r.pair_id and l.side = 0 and r.side = 1),
u as (select pair_id, label, unnest(a)::double as x, unnest(b)::double as y from p),
s as (select pair_id, label, avg((x - y) * (x - y)) as mse,
        sum(x * y) / (greatest(sqrt(sum(x * x)), 1e-6) * greatest(sqrt(sum(y * y)), 1e-6)) as cosine,
        max(x) as mx, max(y) as my from u group by pair_id, label),
l as (select u.pair_id, s.mx + ln(sum(exp(u.x - s.mx))) as lx, s.my + ln(sum(exp(u.y - s.my))) as ly
      from u join s on u.pair_id = s.pair_id group by u.pair_id, s.mx, s.my),
k as (select u.pair_id, sum(exp(u.y - l.ly) * ((u.y - l.ly) - (u.x - l.lx))) as kl,
        -max(u.x - l.lx) as loss, -max(u.y - l.ly) as loss_followup
      from u join l on u.pair_id = l.pair_id group by u.pair_id),
ps as (select s.pair_id, s.label, s.mse, s.cosine, k.kl, k.loss, k.loss_followup from s join k on s.pair_id = k.pair_id)"""


def pairs(spark, sf_dir):
    return C.pair_scores(C.pair_vectors(table(spark, sf_dir, "embeddings")))


@register("pair_mse", f"with {PAIRS_CTE} select pair_id, label, round(mse, 6) as mse from ps")
def q_pair_mse(spark, sf_dir):
    return pairs(spark, sf_dir).select("pair_id", "label", F.round("mse", 6).alias("mse"))


@register("pair_cosine", f"with {PAIRS_CTE} select pair_id, round(cosine, 6) as cosine from ps")
def q_pair_cosine(spark, sf_dir):
    return pairs(spark, sf_dir).select("pair_id", F.round("cosine", 6).alias("cosine"))


@register("pair_kl", f"with {PAIRS_CTE} select pair_id, round(kl, 6) as kl from ps")
def q_pair_kl(spark, sf_dir):
    return pairs(spark, sf_dir).select("pair_id", F.round("kl", 6).alias("kl"))


@register("consistency_by_label", f"""with {PAIRS_CTE}
select label, count(*) as n_pairs, round(avg(mse), 6) as mse, round(avg(cosine), 6) as cossim, round(avg(kl), 6) as kl
from ps group by label""")
def q_consistency_by_label(spark, sf_dir):
    out = pairs(spark, sf_dir).groupBy("label").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("mse").alias("mse"), F.avg("cosine").alias("cossim"),
        F.avg("kl").alias("kl"))
    return out.select("label", "n_pairs", *[F.round(c, 6).alias(c) for c in ("mse", "cossim", "kl")])


@register("combined_score", f"""with {PAIRS_CTE}
select pair_id // {BATCH} as batch, round(avg(loss), 6) as loss, round(avg(loss_followup), 6) as loss_followup,
  round(avg(kl), 6) as consistency,
  round(avg(loss) + {ALPHA} * (avg(loss_followup) + 1e-5 * avg(kl)), 6) as objective
from ps group by pair_id // {BATCH}""")
def q_combined_score(spark, sf_dir):
    """A15 over batches of 8 pairs: loss = NLL of the most likely component of
    the softmaxed "before" vector, loss_followup the same for "after",
    consistency = KL between them."""
    p = pairs(spark, sf_dir)
    p = p.withColumn("loss", nll_of_max("left")).withColumn("loss_followup", nll_of_max("right")).withColumn(
        "consistency", F.col("kl"))
    p = p.withColumn("batch", F.floor(F.col("pair_id") / BATCH).cast("bigint"))
    out = C.combined_score(p, "batch", ALPHA)
    return out.select("batch", *[F.round(c, 6).alias(c) for c in ("loss", "loss_followup", "consistency", "objective")])


def _sinkhorn_sql(size: int = CLOUD) -> str:
    """V4 unrolled: the fixed cooling plan as a chain of CTEs over all point pairs
    of a cloud, for the three problems (left-right, left-left, right-right)."""
    plan = C.temperatures()
    points = f"""{PAIRS_CTE.split('u as (')[0].rstrip().rstrip(',')},
pt as (select label, pair_id // {size} as cloud, pair_id, 0 as side, a as v from p
       union all select label, pair_id // {size}, pair_id, 1, b from p),
c as (select x.label, x.cloud, k.prob, x.pair_id as i, y.pair_id as j,
        0.5 * list_sum(list_transform(list_zip(x.v, y.v), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))) as cost
      from (values ('xy', 0, 1), ('xx', 0, 0), ('yy', 1, 1)) k(prob, sx, sy)
      join pt x on x.side = k.sx join pt y on y.side = k.sy and y.label = x.label and y.cloud = x.cloud),
f0 as (select distinct label, cloud, prob, i, 0.0::double as f from c),
g0 as (select distinct label, cloud, prob, j, 0.0::double as g from c)"""

    def soft(side: str, other: str, value: str, src: str, t: float) -> str:
        score = f"(o.{value} - c.cost) / {t!r}"
        return (f"select label, cloud, prob, {side}, -{t!r} * (any_value(top) + ln(avg(exp(s - top)))) as v from ("
                f"select c.label, c.cloud, c.prob, c.{side}, {score} as s, "
                f"max({score}) over (partition by c.label, c.cloud, c.prob, c.{side}) as top "
                f"from c join {src} o using (label, cloud, prob, {other})) z group by label, cloud, prob, {side}")

    ctes = [points]
    for n, t in enumerate(plan):
        ctes.append(f"f{n + 1} as (select o.label, o.cloud, o.prob, o.i, 0.5 * (o.f + n.v) as f from f{n} o "
                    f"join ({soft('i', 'j', 'g', f'g{n}', t)}) n using (label, cloud, prob, i))")
        ctes.append(f"g{n + 1} as (select o.label, o.cloud, o.prob, o.j, 0.5 * (o.g + n.v) as g from g{n} o "
                    f"join ({soft('j', 'i', 'f', f'f{n}', t)}) n using (label, cloud, prob, j))")
    n, t = len(plan), plan[-1]
    ctes.append(f"fe as (select label, cloud, prob, avg(v) as f from ({soft('i', 'j', 'g', f'g{n}', t)}) z group by label, cloud, prob)")
    ctes.append(f"ge as (select label, cloud, prob, avg(v) as g from ({soft('j', 'i', 'f', f'f{n}', t)}) z group by label, cloud, prob)")
    ctes.append("d as (select label, cloud, sum(case prob when 'xy' then f + g else -(f + g) / 2 end) as s "
                "from fe join ge using (label, cloud, prob) group by label, cloud)")
    return "with " + ",\n".join(ctes)


def clouds(spark, sf_dir):
    return C.pair_vectors(table(spark, sf_dir, "embeddings")).withColumn(
        "example", F.floor(F.col("pair_id") / CLOUD).cast("bigint"))


@register("group_sinkhorn", f"""{_sinkhorn_sql()}
select d.label, count(*) as n_clouds, sum(n.n)::BIGINT as n_left, round(avg(s), 6) as sinkhorn
from d join (select label, pair_id // {CLOUD} as cloud, count(*) as n from p group by all) n using (label, cloud)
group by d.label""")
def q_group_sinkhorn(spark, sf_dir):
    """V4: debiased Sinkhorn divergence between the "before" and "after" vectors of
    every example (a label's pairs in one block of 8 pair ids), mean by label."""
    pts = clouds(spark, sf_dir).select("label", "example", F.inline(F.array(
        F.struct(F.lit(0).alias("side"), as_double("left").alias("embedding")),
        F.struct(F.lit(1).alias("side"), as_double("right").alias("embedding")))))
    out = C.group_sinkhorn(pts, "label", "example")
    return out.select("label", "n_clouds", "n_left", F.round("sinkhorn", 6).alias("sinkhorn"))


@register("block_sinkhorn", f"""{_sinkhorn_sql(LARGE_CLOUD)}
select label, cloud, round(s, 6) as sinkhorn from d""")
def q_block_sinkhorn(spark, sf_dir):
    """V4 for clouds that are split over tasks: blocks of 32 points of clouds with more."""
    pts = C.pair_vectors(table(spark, sf_dir, "embeddings")).select(
        F.col("label").alias("grp"), F.floor(F.col("pair_id") / LARGE_CLOUD).cast("bigint").alias("cloud"), F.inline(F.array(
            F.struct(F.lit(0).alias("side"), as_double("left").alias("v")),
            F.struct(F.lit(1).alias("side"), as_double("right").alias("v")))))
    out = C.block_sinkhorn(pts, block=32)
    return out.select(F.col("grp").alias("label"), "cloud", F.round("sinkhorn", 6).alias("sinkhorn"))


@register("consistency_criteria", f"""{_sinkhorn_sql()},
{PAIRS_CTE[PAIRS_CTE.index('u as ('):].replace('c as', 'c_ as')}
select 'mse' as criterion, label, round(avg(mse), 6) as consistency from ps group by label
union all select 'cossim', label, round(avg(cosine), 6) from ps group by label
union all select 'kl', label, round(avg(kl), 6) from ps group by label
union all select 'ot', label, round(avg(s), 6) from d group by label""")
def q_consistency_criteria(spark, sf_dir):
    """V5: the criterion dispatch, every criterion by label."""
    pairs_ = clouds(spark, sf_dir)
    out = None
    for criterion in ("mse", "cossim", "kl", "ot"):
        got = C.consistency(pairs_, criterion, cloud="example").select(
            F.lit(criterion).alias("criterion"), "label", F.round("consistency", 6).alias("consistency"))
        out = got if out is None else out.unionByName(got)
    return out
