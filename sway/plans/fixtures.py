"""Fixture tables derived from the supplied Parquet tables.

The SQL below runs unchanged in Spark (``{orders}`` bound to a DataFrame)
and in DuckDB (``{orders}`` replaced by the view name), so the Spark query and
its oracle start from identical rows. Both fixtures have one row per order,
so they grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QA_CHOICE_SQL = """
select item_id, run, question, opt_a, opt_b, opt_c, opt_d, answer_idx,
  case v1 when 0 then concat('Let us think. The correct answer is ', l1, ': nation.')
          when 1 then concat('so the correct answer is ', l1, '.')
          when 2 then concat(l1, ': nation.')
          when 3 then concat('The correct answer is ', substr('DABC', cast(s1+1 as int), 1), '. Wait. The correct answer is: ', l1, ':')
          when 4 then 'I cannot decide.'
          else 'The correct answer is not listed.' end as resp1,
  case v2 when 0 then concat('Let us think. The correct answer is ', l2, ': nation.')
          when 1 then concat('so the correct answer is ', l2, '.')
          when 2 then concat(l2, ': nation.')
          when 3 then concat('The correct answer is ', substr('DABC', cast(s2+1 as int), 1), '. Wait. The correct answer is: ', l2, ':')
          when 4 then 'I cannot decide.'
          else 'The correct answer is not listed.' end as resp2
from (
  select *, substr('ABCD', cast(g+1 as int), 1) as answer_idx,
    substr('ABCD', cast(s1+1 as int), 1) as l1, substr('ABCD', cast(s2+1 as int), 1) as l2
  from (
    select *, case when item_id % 7 < 4 then s1 when item_id % 7 = 4 then g else (s1+1) % 4 end as s2
    from (
      select o_orderkey as item_id,
        concat('run_', cast(cast(floor(o_orderkey/60) as bigint) % 3 as string)) as run,
        concat('which nation placed order ', cast(o_orderkey as string)) as question,
        concat('nation ', cast((o_orderkey+0) % 25 as string)) as opt_a,
        concat('nation ', cast((o_orderkey+1) % 25 as string)) as opt_b,
        concat('nation ', cast((o_orderkey+2) % 25 as string)) as opt_c,
        concat('nation ', cast((o_orderkey+3) % 25 as string), case when o_orderkey % 11 = 0 then ', north' else '' end) as opt_d,
        o_orderkey % 4 as g,
        case when o_orderkey % 10 < 6 then o_orderkey % 4 else (o_orderkey % 4 + 1 + o_orderkey % 3) % 4 end as s1,
        cast(floor(o_orderkey/4) as bigint) % 6 as v1,
        cast(floor(o_orderkey/5) as bigint) % 6 as v2
      from {orders}) a) b) c
"""

QA_NUMBER_SQL = """
select item_id, run, question, concat('work it out. #### ', cast(n as string)) as answer,
  case item_id % 8 when 0 then concat('so #### ', cast(n as string))
    when 1 then concat('so #### $', cast(n as string), '.00')
    when 2 then concat('so #### ', cast(cast(floor(n/1000) as bigint) as string), ',', lpad(cast(n % 1000 as string), 3, '0'))
    when 3 then concat('so #### -', cast(n as string))
    when 4 then concat('#### 1 no, #### ', cast(n as string))
    when 5 then 'no idea'
    when 6 then concat('####', chr(10), cast(n as string))
    else '#### .5' end as resp1,
  case when item_id % 5 < 3 then concat('#### ', cast(n as string), '.0') else concat('#### ', cast(n+1 as string)) end as resp2
from (
  select o_orderkey as item_id, concat('run_', cast(cast(floor(o_orderkey/60) as bigint) % 3 as string)) as run,
    concat('how much is order ', cast(o_orderkey as string)) as question,
    1000 + (o_orderkey * 37) % 900000 as n
  from {orders}) a
"""

# Raw multiple-choice records with options as a map (medqa-like). The recorded
# answer text disagrees with the keyed option for every 13th item, which the
# integrity check must reject.
RAW_CHOICE_MAP_SPARK = """
select item_id, run, question,
  case when item_id % 13 = 0 then concat(gold, ' (disputed)') else gold end as answer,
  map('A', opt_a, 'B', opt_b, 'C', opt_c, 'D', opt_d) as options, answer_idx, resp1, resp2
from (select *, case answer_idx when 'A' then opt_a when 'B' then opt_b when 'C' then opt_c else opt_d end as gold
      from {qa}) q
"""

# Raw multiple-choice records with parallel label/text lists and a supporting
# fact (openbookqa-like). Every 17th item names a key that is not a label.
RAW_CHOICE_LISTS_SPARK = """
select item_id, run,
  concat('  order ', cast(item_id as string), ' was placed by one nation  ') as fact1,
  question as question_stem,
  named_struct('text', array(opt_a, opt_b, opt_c, concat(opt_d, '!')), 'label', array('A', 'B', 'C', 'D')) as choices,
  case when item_id % 17 = 0 then 'E' else answer_idx end as answerKey
from {qa}
"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order keys, dealt out over the cores: 8 bytes a row are exchanged, and
    the string work on the records made from them runs in parallel however the
    table is stored."""
    keys = orders(spark, sf_dir).select("o_orderkey")
    return keys.repartition(spark.sparkContext.defaultParallelism, "o_orderkey")


def qa_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(QA_CHOICE_SQL, orders=order_keys(spark, sf_dir))


def qa_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(QA_NUMBER_SQL, orders=order_keys(spark, sf_dir))


def raw_choice_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW_CHOICE_MAP_SPARK, qa=qa_choice(spark, sf_dir))


def raw_choice_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW_CHOICE_LISTS_SPARK, qa=qa_choice(spark, sf_dir))


def raw_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa_number(spark, sf_dir).select("item_id", "run", "question", "answer", "resp1", "resp2")


def duck(sql: str, **tables: str) -> str:
    """Fixture SQL for DuckDB: placeholders become view names / CTE names."""
    return sql.format(**tables)
