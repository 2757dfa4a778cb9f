import re
from collections import Counter, defaultdict
from hashlib import md5

from pyspark.sql import functions as F

from corpus_pipeline import SHARDS, SLOTS, STAGES, language_id, run
from sway.llm.mixing import mix
from sway.llm.sharding import fill

from test_decontam import WORD, brute as brute_hits, lower
from test_mixing import brute_targets
from test_simhash import brute_components


def fixture(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).collect()
    bench = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rows = [tuple(r) for r in docs]
    top = max(r[0] for r in rows)
    long = next(r[1] for r in rows if len(r[1].split()) > 150)
    rows += [(top + 1, None, "en", "src0", None), (top + 2, "12 34 !", "fr", None, 7), (top + 3, "", "en", None, 0),
             (top + 4, long + " again", "en", "src1", 1), (top + 5, long, "en", "src1", 1), (top + 5, long, "en", "src1", 1),
             (top + 6, bench[0][1], None, "src2", 1), (top + 7, long.upper()[:700] + " " + bench[1][1] + " " + long[:500], "en", "src2", 1),
             (None, "a text without an id of its own, " * 9, "en", None, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans int, row string"
    spark.createDataFrame([(*r, 1, "r") for r in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, bench


def test_run_against_brute_force(spark, tmp_path):
    rows, bench = fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert len(STAGES) == 5
    got = run(spark, str(tmp_path))
    assert got.columns == [*docs.columns, "slot", "shard"]

    rows = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    labelled = brute_components([r[:2] for r in rows])
    component = {(d if not none else None): c for none, d, _, c in labelled}
    kept = {}
    for r in rows:
        if component[r[0]] == r[0]:
            kept.setdefault(r[0], r)
    rows = list(kept.values())
    hits = brute_hits([r[:2] for r in rows], bench)
    texts = {}
    for k, r in enumerate(rows):
        n, hit, _ = hits[k]
        if 2 * len(hit) <= n:
            text, places = r[1], [m.span() for m in WORD.finditer(lower(r[1]))]
            cut = sorted(hit)
            for i in reversed(range(len(cut))):  # word by word, with what stands between two of a span
                end = places[cut[i]][1] if i + 1 == len(cut) or cut[i + 1] != cut[i] + 1 else places[cut[i] + 1][0]
                text = text[:places[cut[i]][0]] + text[end:]
            texts[r[0]] = (text, r[3])
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, (t, _) in texts.items()}
    sizes = defaultdict(int)
    for d, (_, s) in texts.items():
        sizes[s] += size[d]
    target, _ = brute_targets(dict(sizes))
    copies = Counter()
    for s in sizes:
        order = sorted((d for d in texts if texts[d][1] == s), key=lambda d: (
            int(md5(str("" if d is None else d).encode()).hexdigest()[:8], 16) % 4096, md5(str("" if d is None else d).encode()).hexdigest()))
        start = 0
        for d in order:
            passes = int(target[s] // sizes[s])
            copies[d] = passes + (start + size[d] / 2 < target[s] - passes * sizes[s])
            start += size[d]
    out = got.collect()
    assert Counter(r.doc_id for r in out) == +copies
    table = fill(SHARDS, SLOTS)
    for r in out:
        assert r.text == texts[r.doc_id][0]
        name = str(r.doc_id) if r.doc_id is not None else "text:" + r.text
        assert r.slot == int(md5(name.encode()).hexdigest()[:15], 16) % SLOTS and r.shard == table[r.slot]
        assert r.n_chars == len(r.text) or r.text == next(x[1] for x in kept.values() if x[0] == r.doc_id)


def test_stages_on_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert run(spark, str(tmp_path)).count() == 0
    assert mix(spark.read.parquet(f"{tmp_path}/documents.parquet")).count() == 0


def test_documents_without_a_language_get_the_one_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    some = F.col("doc_id") % 10 == 3
    bare = docs.withColumn("lang", F.when(~some, F.col("lang")))
    out = language_id(spark, bare, "/root/testdata/sf0.01")
    assert out.columns == docs.columns and out.where("lang IS NULL").count() == 0
    both = out.select("doc_id", F.col("lang").alias("found")).join(docs, "doc_id")
    assert both.where(~some & (F.col("found") != F.col("lang"))).count() == 0
    assert both.where(some & (F.col("found") == F.col("lang"))).count() >= 0.95 * both.where(some).count() > 50
