import re, sys
import os
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from sway.plans import QUERIES
from sway.session import get_spark
from tools.plan_summary import OPS
spark = get_spark('local[8]', shuffle_partitions=16)
spark.sparkContext.setLogLevel('ERROR')
jvm = spark.sparkContext._jvm
sf = '/root/testdata/sf0.1'
out = ["# PLANS — physical plans at sf0.1 (local[8], AQE on)", "",
       "Generated with `tools/plan_summary.py` / `DataFrame.explain`. Counts are of the initial (pre-AQE) physical plan.",
       "Eager jobs are those that run while the query is built: one for the schema of each table read, scalar sizes, and tables written to the shared folder.",
       "The fixtures deal their 8-byte order keys out over the cores, which is one exchange of every query over them.",
       "",
       "| query | scans | exchanges | broadcasts | sort-merge joins | windows | Python stages | eager jobs |",
       "|---|---|---|---|---|---|---|---|"]
plans = {}
for name, fn in QUERIES.items():
    spark.sparkContext.setJobGroup(name, name)
    df = fn(spark, sf)
    eager = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    plan = jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    c = {k: len(re.findall(v, plan)) for k, v in OPS.items()}
    out.append(f"| `{name}` | {c['scan']} | {c['exchange']} | {c['bcast']} | {c['smj']} | {c['window']} | {c['python']} | {eager} |")
    if name in ("leaderboard", "two_round", "pack_chunks"):
        plans[name] = jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
for name, p in plans.items():
    head = p.split("\n\n(1)")[0]
    scan = re.search(r"\(1\) Scan parquet.*?\n\n", p, re.S)
    out += ["", f"## `{name}`", "", "```", head.strip(), "```"]
    if scan:
        out += ["", "Scan node:", "", "```", scan.group(0).strip(), "```"]
open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), 'PLANS.md'), 'w').write("\n".join(out) + "\n")
print("ok")
