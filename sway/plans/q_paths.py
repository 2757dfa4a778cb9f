"""Run-path queries (F21-F23, SRC5 provenance) over paths built from
``orders`` keys: every order stands for one result file of some run."""

from __future__ import annotations

from pyspark.sql import functions as F

from sway.functions.constants import ALPHA_DIR
from sway.functions.paths import INFER_RE, infer_path, plain_train_path, run_dimensions, train_path
from sway.plans.registry import register, table

RUNS_SQL = """
select o_orderkey as k,
  case o_orderkey % 3 when 0 then 'medqa' when 1 then 'openbookqa' else 'gsm8k' end as dataset,
  case o_custkey % 4 when 0 then 'unsloth/Meta-Llama-3.1-8B-Instruct-bnb-4bit'
                     when 1 then 'unsloth/Qwen2.5-7B-Instruct'
                     when 2 then 'checkpoint-' || cast((o_orderkey % 5) * 500 as string)
                     else 'checkpoint-' || cast((o_orderkey % 5) * 500 as string) || '-4bit' end as model,
  'ckpt_' || cast(o_custkey % 7 as string) as model_str,
  case o_orderkey % 4 when 0 then 'random' when 1 then 'general practitioner' when 2 then 'analyst' else 'none' end as identity,
  case o_orderkey % 2 when 0 then 'alpaca' else 'sharegpt' end as fmt,
  case o_orderkey % 5 when 0 then '0.1' when 1 then '1' when 2 then '0.25' else null end as alpha,
  case o_orderkey % 3 when 0 then 'test' when 1 then 'train_' || cast(o_orderkey % 4 as string) else 'dev' end as split
from {orders}
"""

_ALPHA = ALPHA_DIR
_INFER = INFER_RE


def _paths_sql() -> str:
    out_dir = "case when model like '%unsloth%' then 'outputs' else 'outputs_tworound_inference' end"
    return f"""runs as ({RUNS_SQL.format(orders='orders')}),
p as (select k, concat_ws('/', '/data/runs', {out_dir}, dataset, case when model like '%4bit%' then '4bit' end,
        replace(identity, ' ', '_'), fmt, model_str, model, case when alpha is not null then 'alpha_' || alpha end)
        || '/' || split || '.jsonl' as path from runs)"""


def _g(i: int) -> str:
    return f"nullif(regexp_extract(path, '{_INFER}', {i}), '')"


@register("run_dimensions", f"""with {_paths_sql()}
select k, path,
  case when path like '%medqa%' or path like '%medaq%' then 'medqa' when path like '%openbookqa%' then 'openbookqa'
       when path like '%gsm8k%' then 'gsm8k' else 'unknown' end as dataset,
  {_g(1)} as output_dir, {_g(3)} is not null as is_4bit, {_g(4)} as identity, {_g(5)} as format,
  {_g(6)} as model_str, {_g(7)} as model, nullif(regexp_extract(path, '{_ALPHA}', 1), '') as alpha, {_g(9)} as split
from p""")
def q_run_dimensions(spark, sf_dir):
    runs = spark.sql(RUNS_SQL, orders=table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"]))
    folder = infer_path(F.lit("/data/runs"), "dataset", "model", "model_str", "identity", "fmt", "alpha")
    paths = runs.select("k", F.concat(folder, F.lit("/"), F.col("split"), F.lit(".jsonl")).alias("path"))
    return paths.select("k", "path", run_dimensions("path").alias("d")).select("k", "path", "d.*")


@register("run_path", f"""with runs as ({RUNS_SQL.format(orders='orders')})
select k, concat_ws('/', '.', 'outputs', dataset, case when model like '%4bit%' then '4bit' end, 'consistency_sft', fmt, model,
  case when model like '%4bit%' then 'ot_0.0001_8' else 'ot' end) as train_path from runs""")
def q_run_path(spark, sf_dir):
    runs = spark.sql(RUNS_SQL, orders=table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"]))
    return runs.select("k", train_path(F.lit("."), "dataset", "model", "fmt", F.lit("ot"), F.lit("0.0001"),
                                       F.lit(8)).alias("train_path"))


@register("plain_run_path", f"""with runs as ({RUNS_SQL.format(orders='orders')})
select k, './outputs/' || dataset || case when model like '%4bit%' then '/4bit' else '' end || '/LLMs/' || fmt || '/'
  || model || '_0.0001_8' as train_path from runs""")
def q_plain_run_path(spark, sf_dir):
    """the folder of a plain training run."""
    runs = spark.sql(RUNS_SQL, orders=table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"]))
    return runs.select("k", plain_train_path(F.lit("."), "dataset", "model", "fmt", F.lit("0.0001"),
                                             F.lit(8)).alias("train_path"))
