"""Secret scan: fixed patterns and a randomness test battery.

The patterns find assigned secrets, access keys and hex strings. The battery
looks at every other long run of key characters. Its encoding is inferred: the
smallest alphabet that holds the run, after folding the case of runs of one case.
The null hypothesis is ordinary text, and a secret is a discovery against it.
What ordinary text looks like in each alphabet is counted over the shorter runs
of all documents: the frequencies of symbols and of neighbouring pairs. Three
statistics of a run are held against their mean and deviation in ordinary text of
the same length, each towards the value that a random string has. A run that lies
``WITHIN`` deviations or more from that value in any of them isn't random:

* chi-squared: how unequal the symbols' frequencies are (uniform if random);
* runs: how often neighbours lie on different halves of the alphabet;
* serial correlation of neighbouring symbols.

The three p-values are combined by Fisher's method. The false-discovery rate is
controlled by the Benjamini-Hochberg procedure within classes of one encoding and
similar length, so a short run, whose statistics tell little, must stand out
among short runs. P-values are counted in bins of a twentieth of a decade, which
bounds the table of thresholds.

All steps are DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sway.llm.common import saved


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: kind, pattern, group and least length of the group
PATTERNS = (
    ("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # the runs of [0-9a-f]+ that are long enough
)
WITHIN = 4.0
KINDS = [p[0] for p in PATTERNS] + ["random"]
RUN = "[A-Za-z0-9+/_=-]"

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: encoding, alphabet, pattern of the runs that it can hold, whether case is folded
ENCODINGS = (
    ("decimal", _DIGITS, "^[0-9]+$", False),
    ("hex", _DIGITS + "abcdef", "^([0-9a-f]+|[0-9A-F]+)$", True),
    ("letters", _LOWER, "^([a-z]+|[A-Z]+)$", True),
    ("base36", _DIGITS + _LOWER, "^([0-9a-z]+|[0-9A-Z]+)$", True),
    ("base62", _DIGITS + _LOWER.upper() + _LOWER, "^[0-9A-Za-z]+$", False),
    ("base64", _DIGITS + _LOWER.upper() + _LOWER + "+/", "^.*$", False),
)


def matches(text, pattern: str) -> F.Column:
    """The leftmost non-overlapping matches as (start, end, found), in code points:
    what lies between the matches tells where they are."""
    pieces = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
                          F.split(text, pattern, -1).alias("p"))
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def step(done, x):
        start = done["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        here = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("found"))
        return F.when(x["m"].isNull(), done).otherwise(
            F.struct(end.alias("at"), F.concat(done["out"], F.array(here)).alias("out")))

    begin = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(pieces, begin, step, lambda done: done["out"])).otherwise(none)


def base_spans(text) -> F.Column:
    """The spans (start, kind, end, name) of the fixed patterns, unordered."""
    out = []
    for kind, (name, pattern, group, least) in enumerate(PATTERNS):
        found = F.filter(matches(text, pattern), lambda m: F.length(
            F.regexp_extract(m["found"], pattern, group)) >= least)
        out.append(F.transform(found, lambda m: F.struct(
            m["start"], F.lit(kind).alias("kind"), m["end"], F.lit(name).alias("name"))))
    return F.concat(*out)


def _plain(run) -> F.Column:
    """The run without padding, in the standard form of base 64."""
    return F.translate(F.rtrim(run, F.lit("=")), "-_", "+/")


def _folded(run) -> F.Column:
    one_case = run.rlike("^([^A-Z]*|[^a-z]*)$")
    return F.when(one_case, F.lower(run)).otherwise(run)


def _pairs(run) -> F.Column:
    return F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))


def ordinary(docs: DataFrame, text: str, shortest: int) -> DataFrame:
    """For each encoding what its symbols do in ordinary text, that is, in runs of
    at least 12 characters that are too short to be judged: one row an encoding."""
    runs = docs.select(F.explode(F.regexp_extract_all(
        F.col(text), F.lit(rf"(?<!{RUN}){RUN}{{12,{shortest - 1}}}(?!{RUN})"), F.lit(0))).alias("run"))
    runs = runs.select(_plain(F.col("run")).alias("run")).where(F.length("run") > 1)
    # at most 66 x 66 pairs, those of folded runs besides
    pairs = runs.select(_folded(F.col("run")).alias("folded"), "run").select(F.explode(F.concat(
        F.transform(_pairs(F.col("run")), lambda p: F.struct(F.lit(False).alias("fold"), p.alias("pair"))),
        F.transform(_pairs(F.col("folded")), lambda p: F.struct(F.lit(True).alias("fold"), p.alias("pair"))))).alias("x"))
    pairs = saved(pairs.groupBy("x.fold", "x.pair").agg(F.count("*").alias("c")), "pairs")
    every = []
    for name, alphabet, _, fold in ENCODINGS:
        k = len(alphabet)
        at = lambda i: F.instr(F.lit(alphabet), F.substring("pair", i, 1)) - 1  # noqa: E731, B023
        every.append(pairs.where(F.col("fold") == fold).select(
            F.lit(name).alias("encoding"), F.lit(k).alias("k"), at(1).alias("x"), at(2).alias("y"), "c"))
    rows = every[0]
    for other in every[1:]:
        rows = rows.unionByName(other)
    rows = rows.where("x >= 0 and y >= 0")
    mid, var = (F.col("k") - 1) / 2, (F.col("k") ** 2 - 1) / 12
    product = (F.col("x") - mid) * (F.col("y") - mid) / var
    other_half = ((F.col("x") * 2 < F.col("k")) != (F.col("y") * 2 < F.col("k"))).cast("double")
    total = F.sum("c")
    by_pair = rows.groupBy("encoding").agg(
        (F.sum(F.col("c") * other_half) / total).alias("w"), (F.sum(F.col("c") * product) / total).alias("r1"),
        (F.sum(F.col("c") * product * product) / total).alias("r2"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("encoding"))
    by_symbol = (rows.groupBy("encoding", "x").agg(F.sum("c").alias("n")).withColumn("q", share)
                 .groupBy("encoding").agg(F.sum(F.col("q") ** 2).alias("s2"), F.sum(F.col("q") ** 3).alias("s3")))
    return by_pair.join(by_symbol, "encoding")


#: fixed values: letters of English prose, in percent, from a to z
LETTER_SHARES = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4,
                 0.15, 2.0, 0.07)


def prior(spark) -> DataFrame:
    """What ``ordinary`` returns, for text of which nothing is known: letters as in prose, a
    twentieth of them in upper case where there are two cases, few other symbols, and
    neighbours that don't depend on each other."""
    rows = []
    for name, alphabet, *_ in ENCODINGS:
        k, cases = len(alphabet), any("a" <= c <= "z" for c in alphabet)
        shares = [LETTER_SHARES[ord(c.lower()) - 97] / (20 if cases and c.isupper() else 1) if c.isalpha() else 0.5 for c in alphabet]
        shares = [q / sum(shares) for q in shares]
        centred = [i - (k - 1) / 2 for i in range(k)]
        var, low = (k * k - 1) / 12, sum(q for i, q in enumerate(shares) if i * 2 < k)
        r1 = sum(q * x for q, x in zip(shares, centred)) ** 2 / var
        r2 = (sum(q * x * x for q, x in zip(shares, centred)) / var) ** 2
        rows.append((name, 2 * low * (1 - low), r1, r2, *(sum(q ** e for q in shares) for e in (2, 3))))
    return spark.createDataFrame(rows, "encoding string, w double, r1 double, r2 double, s2 double, s3 double")


def _minus_log_tail(z) -> F.Column:
    """-ln of the upper tail of the normal distribution: a closed form that is
    right to about one percent (1.98 and 1.135 are its constants)."""
    a = F.greatest(F.abs(z), F.lit(1e-6))
    log_tail = F.log(1 - F.exp(-1.98 / 2 ** 0.5 * a)) - a * a / 2 - F.log(a * (1.135 * (2 * 3.141592653589793) ** 0.5))
    return F.when(z >= 0, -log_tail).otherwise(-F.log1p(-F.exp(log_tail)))


def battery(runs: DataFrame, null: DataFrame) -> DataFrame:
    """``runs`` with a column ``run``, plus ``encoding``, ``length_class`` (power of
    two) and ``bin`` (-20 log10 of the combined p-value, rounded down). ``null`` is
    what ``ordinary`` returns; an encoding that it doesn't know is judged by ``prior``."""
    plain = _plain(F.col("run"))
    encoding, number = F.lit(None).cast("string"), F.lit(None).cast("array<int>")
    for name, alphabet, pattern, fold in reversed(ENCODINGS):
        fits = F.col("plain").rlike(pattern)
        shown = F.lower("plain") if fold else F.col("plain")
        codes = F.transform(F.filter(F.split(shown, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
        encoding = F.when(fits, F.lit(name)).otherwise(encoding)
        number = F.when(fits, codes).otherwise(number)
    sizes = F.create_map(*[F.lit(x) for name, alphabet, *_ in ENCODINGS for x in (name, len(alphabet))])
    rows = runs.withColumn("plain", plain).where(F.length("plain") > 2).withColumn("encoding", encoding)
    rows = rows.withColumn("codes", number).withColumn("k", sizes[F.col("encoding")])
    # one row an encoding
    unknown = prior(runs.sparkSession).join(F.broadcast(null), "encoding", "left_anti")
    rows = rows.join(F.broadcast(null.unionByName(unknown)), "encoding")
    codes, k = F.col("codes"), F.col("k")
    n = F.size(codes).cast("double")
    counts = F.transform(F.sequence(F.lit(0), k - 1), lambda s: F.size(F.filter(codes, lambda c: c == s)))
    equal = F.aggregate(counts, F.lit(0.0), lambda done, c: done + c.cast("double") * (c - 1) / 2)
    steps = F.sequence(F.lit(1), F.size(codes) - 1)
    half = lambda i: F.get(codes, i) * 2 < k
    switches = F.size(F.filter(steps, lambda i: half(i) != half(i - 1))).cast("double")
    mid, var = (k - 1) / 2, (k * k - 1) / 12
    products = F.aggregate(steps, F.lit(0.0), lambda done, i: done + (F.get(codes, i) - mid) * (F.get(codes, i - 1) - mid) / var)
    rows = rows.select("*", n.alias("n"), equal.alias("equal"), switches.alias("switches"), products.alias("products"))
    n, s2, s3, w, r1, r2 = (F.col(c) for c in ("n", "s2", "s3", "w", "r1", "r2"))
    pairs = n * (n - 1) / 2
    # chi-squared is a linear function of the number of equal pairs, whose mean and variance are known
    spread = pairs * (s2 - s2 * s2) + n * (n - 1) * (n - 2) * F.greatest(F.lit(0.0), s3 - s2 * s2)
    tests = ((F.col("equal"), pairs * s2, spread, pairs / k, pairs * (k - 1) / (k * k)),
             (F.col("switches"), (n - 1) * w, (n - 1) * w * (1 - w), (n - 1) / 2, (n - 1) / 4),
             (F.col("products"), (n - 1) * r1, (n - 1) * (r2 - r1 * r1), F.lit(0.0), n - 1))
    y, fits = F.lit(0.0), F.lit(True)
    for seen, mean, variance, random, chance in tests:
        # beyond the random value a run is no more random
        gain = F.abs(random - mean) - F.abs(seen - random)
        y = y + F.when(variance > 1e-12, _minus_log_tail(gain / F.sqrt(variance))).otherwise(0.0)
        fits = fits & (F.abs(seen - random) < WITHIN * F.sqrt(chance))
    y = F.when(fits, y).otherwise(0.0)
    rows = rows.withColumn("y", y)
    tail = F.col("y") - F.log(1 + F.col("y") + F.col("y") * F.col("y") / 2)
    return rows.select(*runs.columns, "encoding", F.floor(F.log2("n")).cast("int").alias("length_class"),
                       F.floor(F.greatest(F.lit(0.0), tail) / 2.302585092994046 * 20).cast("int").alias("bin"))


def discoveries(tested: DataFrame, rate: float) -> DataFrame:
    """The rows of ``tested`` that the Benjamini-Hochberg procedure finds in their
    class. Thresholds come from counts by class and bin."""
    of_class = ["encoding", "length_class"]
    counts = tested.groupBy(*of_class, "bin").agg(F.count("*").alias("c"))
    counts = counts.withColumn("m", F.sum("c").over(Window.partitionBy(*of_class)))
    counts = counts.withColumn("found", F.sum("c").over(Window.partitionBy(*of_class).orderBy(F.desc("bin"))))
    passes = F.pow(F.lit(10.0), -F.col("bin") / 20) * F.col("m") <= rate * F.col("found")
    limits = counts.where(passes).groupBy(*of_class).agg(F.min("bin").alias("limit"))
    return tested.join(limits, of_class).where("bin >= limit").drop("limit")


def scan(docs: DataFrame, shortest: int = 20, rate: float = 0.01, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``key``, ``row`` (its number in the scan),
    ``base`` and ``spans``: arrays of (start, kind, end, name) in code points, end
    exclusive, by start and kind, a number into ``KINDS``. ``spans`` holds ``base``
    and the random runs of ``shortest`` characters or more that meet no base span.

    ``docs`` must be a scan that yields the same rows again, such as a table. Null
    and empty texts have no spans; equal texts in one table have equal spans; rows
    that repeat are scanned each; an empty table gives no rows. Other columns are
    not read."""
    rows = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    runs = F.transform(matches(F.col("text"), f"{RUN}{{{shortest},}}"),
                       lambda m: F.struct(m["start"], m["end"], m["found"].alias("run")))
    rows_of = rows.select("key", "row", base_spans(F.col("text")).alias("base"), runs.alias("runs"))
    free = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    rows_of = saved(rows_of.select("key", "row", F.array_sort("base").alias("base"), free.alias("runs")), "runs")
    null = saved(ordinary(rows, "text", shortest), "ordinary")
    found = rows_of.select("row", F.explode("runs").alias("r")).select("row", "r.start", "r.end", "r.run")
    found = discoveries(saved(battery(found, null).drop("run"), "tested"), rate)
    random = KINDS.index("random")
    found = found.groupBy("row").agg(F.collect_list(F.struct(
        "start", F.lit(random).alias("kind"), "end", F.lit("random").alias("name"))).alias("more"))
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return rows_of.join(found, "row", "left").select(F.col("key").alias(key), "row", "base", spans.alias("spans"))


def listed(spans) -> F.Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")
