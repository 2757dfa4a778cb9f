"""Run identity <-> output location (F21-F23) as Column expressions.

Inference results live at
``{root}/{output_dir}/{dataset}/[4bit/]{identity}/{format}/{model_str}/{model}[/alpha_{alpha}]/{split}.jsonl``;
training outputs at
``{root}/outputs/{dataset}[/4bit]/{method_dir}/{format}/{model}/{criterion}[_{lr}_{batch}]``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sway.functions.constants import ALPHA_DIR
from sway.functions.text import ColumnOrName, col, slug

ALPHA_RE = ALPHA_DIR
INFER_RE = (r"(?:^|/)([^/]+)/(medqa|medaq|openbookqa|gsm8k|squad_v2)/(?:(4bit)/)?([^/]+)/(alpaca|sharegpt)/"
            r"([^/]+)/(.+?)/(?:" + ALPHA_RE + r"/)?([^/]+)\.jsonl$")


def dataset_of(path: ColumnOrName) -> Column:
    """Dataset by substring, in the analyzer's precedence (medqa or its
    misspelling first); unknown paths are reported as 'unknown', not fatal."""
    p = col(path)
    return (F.when(p.contains("medqa") | p.contains("medaq"), F.lit("medqa"))
            .when(p.contains("openbookqa"), F.lit("openbookqa"))
            .when(p.contains("gsm8k"), F.lit("gsm8k"))
            .otherwise(F.lit("unknown")))


_SEP = "\u0001"


def run_dimensions(path: ColumnOrName) -> Column:
    """struct of run dimensions parsed from a result-file path. The
    layout regex runs once per row: a whole-string replacement lays the
    groups out separated by \\u0001 and a split picks them up."""
    p = col(path)
    laid = F.regexp_replace(p, r"^(?:.*?)" + INFER_RE, _SEP + _SEP.join(f"${i}" for i in range(1, 10)))
    parts = F.when(F.startswith(laid, F.lit(_SEP)), F.split(F.substring(laid, 2, 1 << 30), _SEP, -1))

    def g(i: int) -> Column:
        return F.nullif(F.get(parts, i - 1), F.lit(""))

    return F.struct(
        dataset_of(p).alias("dataset"),
        g(1).alias("output_dir"),
        g(3).isNotNull().alias("is_4bit"),
        g(4).alias("identity"),
        g(5).alias("format"),
        g(6).alias("model_str"),
        g(7).alias("model"),
        F.nullif(F.regexp_extract(p, ALPHA_RE, 1), F.lit("")).alias("alpha"),
        g(9).alias("split"),
    )


def infer_path(root: ColumnOrName, dataset: ColumnOrName, model: ColumnOrName, model_str: ColumnOrName,
               identity: ColumnOrName, fmt: ColumnOrName, alpha: ColumnOrName) -> Column:
    """F23 (inference): output folder of a two-round run."""
    m = col(model)
    out_dir = F.when(m.contains("unsloth"), F.lit("outputs")).otherwise(F.lit("outputs_tworound_inference"))
    parts = [col(root), out_dir, col(dataset), F.when(m.contains("4bit"), F.lit("4bit")), slug(identity), col(fmt),
             col(model_str), m, F.when(col(alpha).isNotNull() & (col(alpha) != ""), F.concat(F.lit("alpha_"), col(alpha)))]
    return F.concat_ws("/", *parts)


def train_path(root: ColumnOrName, dataset: ColumnOrName, model: ColumnOrName, fmt: ColumnOrName,
               criterion: ColumnOrName, lr: ColumnOrName, batch_size: ColumnOrName,
               method_dir: str = "consistency_sft") -> Column:
    """F23 (training): checkpoint folder of a consistency-training run
    (``method_dir`` names the training method's folder)."""
    m = col(model)
    q = m.contains("4bit")
    tail = F.when(q, F.concat_ws("_", col(criterion), col(lr).cast("string"), col(batch_size).cast("string"))) \
        .otherwise(col(criterion))
    return F.concat_ws("/", col(root), F.lit("outputs"), col(dataset), F.when(q, F.lit("4bit")), F.lit(method_dir),
                       col(fmt), m, tail)


def plain_train_path(root: ColumnOrName, dataset: ColumnOrName, model: ColumnOrName, fmt: ColumnOrName,
                     lr: ColumnOrName, batch_size: ColumnOrName) -> Column:
    """F23 (plain training): ``{root}/outputs/{dataset}[/4bit]/LLMs/{format}/{model}_{lr}_{batch}``."""
    m = col(model)
    tail = F.concat_ws("_", m, col(lr).cast("string"), col(batch_size).cast("string"))
    return F.concat_ws("/", col(root), F.lit("outputs"), col(dataset), F.when(m.contains("4bit"), F.lit("4bit")),
                       F.lit("LLMs"), col(fmt), tail)
