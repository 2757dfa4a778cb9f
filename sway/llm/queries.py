"""The queries opN_<name> over the supplied tables, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sway.llm import decontam, toxicity
from sway.llm.exact_dedup import exact_dedup
from sway.llm.langid import held_out, identify, train
from sway.llm.line_dedup import near_lines
from sway.llm.mixing import mix
from sway.llm.periodic import periodic_runs
from sway.llm.resampling import resample
from sway.llm.secret_scan import listed, scan
from sway.llm.sharding import fill, place
from sway.llm.simhash import simhash_components
from sway.llm.suffix_dedup import suffix_dedup
from sway.llm.url_filter import filter_urls

SHARDS, SLOTS = corpus_pipeline.SHARDS, corpus_pipeline.SLOTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(documents(spark, sf_dir), shingle=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    of_kind = lambda name: F.size(F.filter("base", lambda s: s["name"] == name)).cast("long").alias(f"n_{name}")
    return found.select(
        "doc_id", *map(of_kind, ("assign", "access", "hex")), F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.find(documents(spark, sf_dir).select("doc_id", "text"), benchmark, width=10)
    hit = decontam.n_hit(F.col("spans"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op3_decontamination"] = f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS words FROM benchmark),
phrases AS (
  SELECT DISTINCT item, least(len(words), 10) AS width, array_to_string(list_slice(words, p + 1, p + 10), ' ') AS phrase
  FROM items, unnest(range(greatest(len(words) - 9, 1))) t(p) WHERE len(words) > 0),
docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
places AS (
  SELECT doc_id, p, width, array_to_string(list_slice(words, p + 1, p + width), ' ') AS phrase
  FROM docs, unnest(range(len(words))) t(p), (SELECT DISTINCT width FROM phrases) w WHERE p + width <= len(words)),
hits AS (SELECT doc_id, p, places.width, item FROM places JOIN phrases USING (phrase, width)),
covered AS (SELECT doc_id, count(DISTINCT b) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + width)) AS b FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", F.col("keep").alias("keep_id"), "group_size", "kept",
                        F.lower(F.hex("digest")).alias("text_sha256"))


ORACLES["op4_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(documents(spark, sf_dir), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


ORACLES["op5_suffix_dedup"] = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
windows AS (SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS w FROM docs, unnest(range(greatest(n - 99, 0))) t(s)),
later AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 100)) AS b FROM later),
edges AS (SELECT doc_id, count(*) AS n_removed, sum(CASE WHEN before = b - 1 THEN 0 ELSE 1 END) AS n_spans
          FROM (SELECT doc_id, b, lag(b) OVER (PARTITION BY doc_id ORDER BY b) AS before FROM gone) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * b + 1, 2), '' ORDER BY b) AS h
         FROM (SELECT doc_id, h, b FROM docs, unnest(range(n)) t(b) WHERE doc_id IN (SELECT doc_id FROM edges)) x
         ANTI JOIN gone USING (doc_id, b) GROUP BY doc_id)
SELECT docs.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n_removed IS NULL THEN docs.h ELSE coalesce(kept.h, '') END)) AS kept_sha256
FROM docs LEFT JOIN edges USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(documents(spark, sf_dir), SHARDS, SLOTS).select("doc_id", "slot", "shard")


ORACLES["op6_sharding"] = f"""
SELECT doc_id, slot, CAST(list_extract({fill(SHARDS, SLOTS)}, slot + 1) AS INTEGER) AS shard
FROM (SELECT doc_id, CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || text, '')), 15) AS BIGINT)
             % {SLOTS} AS slot FROM documents)
"""


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = held_out(F.col("doc_id"), 5, 0)
    scorer = toxicity.train(docs.where(~held), spark.read.parquet(f"{sf_dir}/labels.parquet"), every=docs)
    found = toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), scorer)
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_lines(documents(spark, sf_dir), threshold=2, per=5)
    return found.select("doc_id", "line_no", "class_id", "links", "kept")


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = held_out(F.col("doc_id"), 4, 2)
    model = train(docs.where(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model)


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.try_element_at("positions", F.lit(1))
    found = mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", F.size("positions").alias("copies"),
        F.round(first, 9).alias("first_position"))
    # what isn't taken is spread over the end of the order
    return found.orderBy(F.coalesce("first_position", F.lit(1) + F.rand(7)))


#: the closed form of one linear piece from (t0, w0) to (t1, w1), at the share x of the whole integral
def _piece(t0, w0, t1, w1, done, whole):
    slope = (w1 - w0) / (t1 - t0)
    left = f"(x * {whole!r} - {done!r})"
    return f"{t0!r} + " + (f"{left} / {w0!r}" if slope == 0 else
                           f"(sqrt(greatest(0.0, {w0 * w0!r} + {2 * slope!r} * {left})) - {w0!r}) / {slope!r}")


ORACLES["op10_mixing"] = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0
           ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn
  FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][turn % 3 + 1] AS w, 2 * source_size AS most FROM sources),
ordered AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS heft,
         coalesce(sum(most) OVER b, 0) AS most_before, coalesce(sum(w) OVER b, 0) AS heft_before
  FROM weighed
  WINDOW b AS (ORDER BY most / w, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, (total * 3 - most_before * 2) * w >= most * 2 * (heft - heft_before) AS capped FROM ordered),
levels AS (
  SELECT *, sum(CASE WHEN capped THEN most ELSE 0 END) OVER () AS most_capped,
         sum(CASE WHEN capped THEN w ELSE 0 END) OVER () AS heft_capped FROM judged),
aims AS (
  SELECT source, source_size, turn, CASE WHEN capped THEN CAST(most AS DOUBLE)
         ELSE CAST(w * (total * 3 - most_capped * 2) AS DOUBLE) / CAST(2 * (heft - heft_capped) AS DOUBLE) END AS target
  FROM levels),
started AS (
  SELECT s.doc_id, s.size, a.source_size, a.turn, a.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source
           ORDER BY md5_order, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         CASE WHEN a.source_size > 0 THEN CAST(floor(a.target / a.source_size) AS BIGINT) ELSE 1 END AS passes
  FROM (SELECT *, CAST('0x' || left(h, 8) AS BIGINT) % 4096 AS md5_range,
               lpad(CAST(CAST('0x' || left(h, 8) AS BIGINT) % 4096 AS VARCHAR), 4, '0') || h AS md5_order
        FROM (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM sized)) s
  JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
counted AS (
  SELECT *, passes + CASE WHEN size > 0 AND start + size / 2 < target - passes * source_size THEN 1 ELSE 0 END AS copies,
         CASE WHEN target > 0 THEN least(1.0, (start + size / 2) / target) ELSE 0.0 END AS x
  FROM started)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * copies AS BIGINT) AS taken,
       CAST(copies AS INTEGER) AS copies,
       round(CASE WHEN copies = 0 THEN NULL ELSE least(1.0, CASE turn % 3
         WHEN 0 THEN CASE WHEN x * 1.25 < 0.75 THEN {_piece(0.0, 2.0, 0.5, 1.0, 0.0, 1.25)}
                          WHEN x * 1.25 < 1.25 THEN {_piece(0.5, 1.0, 1.0, 1.0, 0.75, 1.25)} ELSE 1.0 END
         WHEN 1 THEN CASE WHEN x < 1.0 THEN x ELSE 1.0 END
         ELSE CASE WHEN x * 1.0 < 0.3 THEN {_piece(0.0, 0.5, 0.6, 0.5, 0.0, 1.0)}
                   WHEN x * 1.0 < 1.0 THEN {_piece(0.6, 0.5, 1.0, 3.0, 0.3, 1.0)} ELSE 1.0 END END) END, 9) AS first_position
FROM counted
"""


#: rules of op11: blocked and allowed parts of hosts
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"''\s>]*)"""
_FOLDED = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_RULE_ROWS = ", ".join(f"('{v}', '{r}', '{r.split('/')[0]}', '{r[r.index('/'):]}')" for v, r in RULES)

ORACLES["op11_url_filter"] = f"""
WITH RECURSIVE parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_FOLDED}) AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{_LINK}', 1), lambda h: translate(h, {_FOLDED}))) AS targets
  FROM pages),
edges AS (
  SELECT host AS source, target, count(*) AS n FROM (SELECT host, unnest(targets) AS target FROM parsed)
  WHERE host <> '' AND target <> '' AND host <> target GROUP BY ALL),
rules(verdict, rule, suffix, start) AS (VALUES {_RULE_ROWS}),
places AS (
  SELECT DISTINCT host, path FROM parsed
  UNION SELECT DISTINCT target, '/' FROM edges WHERE target NOT IN (SELECT host FROM parsed)),
ruled AS (
  SELECT host, path, rule, verdict FROM places JOIN rules
    ON (host = suffix OR ends_with(host, '.' || suffix)) AND starts_with(path, start)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, verdict DESC, rule) = 1),
counted AS (
  SELECT host, path FROM parsed WHERE host <> ''
  UNION ALL SELECT DISTINCT target, '/' FROM edges WHERE target NOT IN (SELECT host FROM parsed)),
seeds AS (
  SELECT host, avg((verdict IS NOT DISTINCT FROM 'allow')::INT) AS trust, avg((verdict IS NOT DISTINCT FROM 'block')::INT) AS distrust
  FROM counted LEFT JOIN ruled USING (host, path) GROUP BY host),
moves AS (
  SELECT 0 AS kind, source AS host, target AS towards, 0.85::DOUBLE * n / sum(n) OVER (PARTITION BY source) AS share FROM edges
  UNION ALL SELECT 1, target, source, 0.85::DOUBLE * n / sum(n) OVER (PARTITION BY target) FROM edges),
walk(step, kind, host, value) AS (
  SELECT 0, kind, host, value FROM (SELECT 0 AS kind, host, trust AS value FROM seeds UNION ALL SELECT 1, host, distrust FROM seeds)
  UNION ALL
  SELECT step + 1, kind, towards, sum(value * share) FROM walk JOIN moves USING (kind, host)
  WHERE step < 30 AND value > 0 GROUP BY step, kind, towards),
scores AS (SELECT host, sum(CASE WHEN kind = 0 THEN -value ELSE value END) AS distrust FROM walk GROUP BY host)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN coalesce(distrust, 0) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed LEFT JOIN ruled USING (host, path) LEFT JOIN scores USING (host)
"""


def _crc(bytes_: str) -> str:
    """SQL for the CRC-32 of a list of bytes; ``crc_table`` must be in scope."""
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), "
            "lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)")


_BYTES = "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: ('0x' || x)::BIGINT)"
#: the table of CRC-32, each entry from eight halving steps
_CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY k) AS t FROM (
  SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) r(k)))"""


def looped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts of the contract of op12: for a tenth of the rows the words from ``a`` on
    repeat the first ``p`` of them; the other texts are as they are."""
    h = F.crc32(F.col(key).cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), 0))
    rows = docs.select(key, text, F.floor(h / 10).alias("g"), words.alias("words")).withColumn("n", F.size("words").cast("long"))
    a = F.when(F.col("n") > 0, F.col("g") % F.col("n"))
    rows = rows.withColumn("a", a).withColumn(
        "p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    rest = (F.col("n") - F.col("a")).cast("int")
    unit = F.array_join(F.slice("words", F.col("a").cast("int") + 1, F.col("p").cast("int")), " ")
    times = F.ceil(rest / F.col("p")).cast("int")
    tail = F.slice(F.split(F.array_join(F.array_repeat(unit, times), " "), " "), F.lit(1), rest)
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), tail), " ")
    return rows.select(key, F.when(F.col("n") > 0, changed).otherwise(F.col(text)).alias(text))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(looped(documents(spark, sf_dir).select("doc_id", "text")), least=12)
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed_runs = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed_runs = F.when(F.size("runs") > 0, F.concat(listed_runs, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed_runs, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


ORACLES["op12_periodic_runs"] = f"""
WITH {_CRC_TABLE},
numbered AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         {_crc(_BYTES.format("CAST(doc_id AS VARCHAR)"))} AS h FROM documents, crc_table),
sized AS (SELECT *, len(words) AS n, h // 10 AS g FROM numbered),
aimed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM sized),
stepped AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM aimed),
placed AS (
  SELECT r, doc_id, n, i, words[CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END + 1] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM stepped)),
grams AS (
  SELECT r, n, i, hash(word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w, lead(word, 5) OVER w) AS six
  FROM placed WINDOW w AS (PARTITION BY r ORDER BY i)),
-- six words in a row agree at the distance p wherever a run of twelve words or more has the period p
pairs AS (
  SELECT x.r, x.n, x.i, y.i - x.i AS p FROM grams x JOIN grams y ON x.r = y.r AND x.six = y.six AND x.i < y.i
  WHERE y.i + 6 <= x.n),
stretches AS (
  SELECT r, p, min(i) AS start, max(i) + 6 + p - min(i) AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS stretch FROM pairs) GROUP BY r, p, stretch),
runs AS (
  SELECT r, start, length, min(p) AS period FROM stretches WHERE length >= greatest(12, 2 * p) GROUP BY r, start, length),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
collapsed AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM placed ANTI JOIN gone USING (r, i) GROUP BY r),
listed AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS list,
         arg_min({{'start': start, 'length': length, 'period': period}}, [-length, start, period]) AS best
  FROM runs GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
       1000 * best.length // best.period AS exponent_milli,
       sha256(coalesce(list, '')) AS runs_sha256, sha256(coalesce(collapsed.text, '')) AS collapsed_sha256
FROM numbered LEFT JOIN listed USING (r) LEFT JOIN collapsed USING (r)
"""


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample(documents(spark, sf_dir), target, percent=25, least=20, buckets=10_000, seed=7)


ORACLES["op13_importance_resampling"] = f"""
WITH {_CRC_TABLE},
texts AS (
  SELECT 's' AS side, row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents
  UNION ALL SELECT 't', row_number() OVER (), NULL, {_WORDS} FROM benchmark),
features AS (
  SELECT side, r, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM texts),
names AS (SELECT feature, {_crc(_BYTES.format("feature"))} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM features), crc_table),
held AS (SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM features JOIN names USING (feature) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
                                      / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM held),
meant AS (
  SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS whole
  FROM features JOIN names USING (feature) JOIN gains USING (bucket) WHERE side = 's' GROUP BY r),
weighed AS (
  SELECT r, doc_id, coalesce(n_features, 0) AS n_features, len(words) AS n_words,
         coalesce((whole - ((whole % n_features) + n_features) % n_features) // n_features, 0) AS weight
  FROM texts LEFT JOIN meant USING (r) WHERE side = 's'),
scored AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM weighed),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
