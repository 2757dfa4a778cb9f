"""Importance resampling of documents towards a target distribution.

Features are the words of a text and its pairs of neighbouring words; a feature's
bucket is its CRC-32 modulo the number of buckets. A bucket's gain compares its share
among the target texts with its share among all documents, a document's weight is the
mean gain of its features, and the documents with the highest weights plus Gumbel noise
are drawn.

Features are named by a head-tail vocabulary. The head holds words and pairs that make
up at least a ``frequent``-th part of all words, so no more than ``1 / frequent`` of
either: it is counted over all texts and broadcast, words with the CRC state that
their pairs go on from, pairs with their bucket. The others, the tail, get their CRC
where they are met. Both feed the same exact totals, so the head decides how long the
work takes and nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sway.llm.common import byte_texts, saved, shared_path
from sway.operators.ordering import with_positions, write_ordered

#: bytes of texts that a task works on at once; a longer text is worked on alone
BATCH = 4 << 20
#: share of all words from which a word or a pair belongs to the head
FREQUENT = 2.0 ** -15

_LETTERS = bytes(range(ord("A"), ord("Z") + 1))
_APART = bytes(b for b in range(128) if not (chr(b).isascii() and chr(b).isalnum()))
#: A-Z to lower case, what no word holds to a space
FOLD = bytes.maketrans(_LETTERS + _APART, _LETTERS.lower() + b" " * len(_APART))


def _texts(batches, column: int):
    """Documents of Arrow batches, some megabytes at a time: their batch's slice and
    their words."""
    for batch in batches:
        texts, size, at = [], 0, 0
        for i, t in enumerate(byte_texts(batch.column(column)), 1):
            texts.append((t or b"").translate(FOLD).split())
            size += len(t or b"")
            if size >= BATCH or i == batch.num_rows:
                yield batch.slice(at, i - at), texts
                texts, size, at = [], 0, i


def _coded(texts):
    """The different words, each text's number of words, all words by number, and for
    every word but a text's last the pair with the next one as one number."""
    import numpy as np
    import pyarrow as pa

    counts = np.array([len(t) for t in texts], np.int64)
    words = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    ids = words.indices.to_numpy().astype(np.int64)
    inner = np.ones(len(ids), bool)
    inner[(np.cumsum(counts) - 1)[counts > 0]] = False
    inner = np.flatnonzero(inner)
    words = words.dictionary.to_pylist()
    return words, counts, ids, inner, ids[inner] * len(words) + ids[inner + 1] if len(inner) else inner


def _frequent_rows(frequent: float):
    """Words ``(a, null)`` and pairs ``(a, b)`` that are frequent among some megabytes of
    texts, with their counts there, and the number of words as ``(null, null)``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _, texts in _texts(batches, 0):
            words, _, ids, _, pairs = _coded(texts)
            least = frequent * len(ids)
            n = np.bincount(ids, minlength=len(words))
            some = np.flatnonzero(n >= least)
            rows = [(None, None, len(ids))] + [(words[k], None, int(n[k])) for k in some]
            pairs, n = np.unique(pairs, return_counts=True)
            some = np.flatnonzero(n >= least)
            rows += [(words[p // len(words)], words[p % len(words)], int(k)) for p, k in zip(pairs[some].tolist(), n[some])]
            a, b, n = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())],
                                             names=["a", "b", "n"])

    return run


def head_vocabulary(docs: DataFrame, buckets: int, frequent: float = FREQUENT, text: str = "text") -> dict:
    """The head as plain values: ``words`` (word to (number, CRC state)) and ``pairs``
    ((number, number) as one long, ascending) with their ``buckets``.

    A word or pair that is frequent in all texts is so in some task's megabytes at least,
    which report it. Counts of reports add up to no more than the true count, so fewer
    than ``1 / frequent`` words, and pairs, pass."""
    from zlib import crc32

    import numpy as np

    counts = docs.select(text).mapInArrow(_frequent_rows(frequent), "a binary, b binary, n long")
    counts = saved(counts.groupBy("a", "b").agg(F.sum("n").alias("n")), "frequent")
    total = counts.where("a is null").agg(F.sum("n")).first()[0] or 0
    head = counts.where((F.col("n") >= frequent * total) & F.col("a").isNotNull())
    single = sorted(bytes(r.a) for r in head.where("b is null").select("a").collect())
    words = {w: (k, crc32(w)) for k, w in enumerate(single)}
    pairs = {}
    for r in head.where("b is not null").select("a", "b").collect():
        a, b = words.get(bytes(r.a)), words.get(bytes(r.b))
        if a and b:
            pairs[a[0] << 32 | b[0]] = crc32(b" " + bytes(r.b), a[1]) % buckets
    codes = sorted(pairs)
    return {"words": words, "pairs": np.array(codes, np.int64), "buckets": np.array([pairs[c] for c in codes], np.int64)}


def _buckets(coded, head: dict, buckets: int):
    """The buckets of all words, and of all pairs."""
    from zlib import crc32

    import numpy as np

    words, _, ids, _, pairs = coded
    known = head["words"]
    found = [known.get(w) or (-1, crc32(w)) for w in words]
    place = np.array([f[0] for f in found], np.int64)
    state = [f[1] for f in found]
    pairs, which = np.unique(pairs, return_inverse=True)
    a, b = pairs // max(1, len(words)), pairs % max(1, len(words))
    bucket = np.full(len(pairs), -1, np.int64)
    if len(head["pairs"]):
        code = np.where((place[a] >= 0) & (place[b] >= 0), place[a] << 32 | place[b], -1)
        at = np.minimum(np.searchsorted(head["pairs"], code), len(head["pairs"]) - 1)
        bucket = np.where(head["pairs"][at] == code, head["buckets"][at], -1)
    tail = np.flatnonzero(bucket < 0)
    bucket[tail] = [crc32(b" " + words[y], state[x]) % buckets for x, y in zip(a[tail].tolist(), b[tail].tolist())]
    return (np.array(state, np.int64) % buckets)[ids], bucket[which]


def bucket_totals(docs: DataFrame, head, buckets: int, text: str = "text") -> DataFrame:
    """``(bucket, n)``: how many features of all texts a bucket holds, if any. ``head`` is
    a broadcast vocabulary."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for _, texts in _texts(batches, 0):
            for part in _buckets(_coded(texts), head.value, buckets):
                total += np.bincount(part, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return (docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, gain)`` for every bucket, from the totals of both sides."""
    both = docs.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    none = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"), *[F.lit(0).cast("long").alias(c) for c in "st"])
    rows = both.unionByName(none).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    whole = rows.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    ratio = ((d("t") + 1) * (d("all_s") + buckets)) / ((d("s") + 1) * (d("all_t") + buckets))
    # the one row of sums beside the fixed number of buckets
    return rows.join(F.broadcast(whole)).select("bucket", F.floor(F.lit(1000) * F.log(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, target: DataFrame, buckets: int = 10_000, frequent: float = FREQUENT, key: str = "doc_id",
            text: str = "text") -> DataFrame:
    """``(key, n_features, weight)`` for each row of ``docs``."""
    import numpy as np

    spark = docs.sparkSession
    head = spark.sparkContext.broadcast(head_vocabulary(docs, buckets, frequent, text))
    gains = bucket_gains(saved(bucket_totals(docs, head, buckets, text), "totals"),
                         saved(bucket_totals(target, head, buckets, text), "totals"), buckets)
    gains = np.array([r.gain for r in gains.orderBy("bucket").collect()], np.int64)
    gains = spark.sparkContext.broadcast(gains)
    names = [key, "n_features", "weight"]

    def run(batches):
        import pyarrow as pa

        for batch, texts in _texts(batches, 1):
            coded = _coded(texts)
            _, counts, ids, inner, _ = coded
            single, double = _buckets(coded, head.value, buckets)
            gain = gains.value[single]
            gain[inner] += gains.value[double]
            ends = np.cumsum(counts)
            whole = np.append(0, np.cumsum(gain))
            features = np.maximum(2 * counts - 1, 0)
            weight = (whole[ends] - whole[ends - counts]) // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(features), pa.array(weight)], names=names)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least: int = 20, buckets: int = 10_000, seed: int = 7,
             frequent: float = FREQUENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``key``, ``n_features``, ``weight`` (floored mean of
    the gains, in thousandths), ``score`` (weight plus Gumbel noise from ``seed`` and key) and
    ``rank`` (1, 2, 3, ... for the ``percent`` % of all rows of at least ``least`` words with
    the highest scores; null for the others).

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased.
    Null, empty and wordless texts have no feature and weight 0. Ties of the score go to the
    smaller key, null keys last, then to fewer features; a null key draws its noise as
    the empty one. Repeated rows are rows of their own, all copies of a key have the same
    noise. An empty ``docs`` gives no rows, an empty target nothing to prefer. Other columns
    are not read. ``docs`` is read three times: for the head, the totals and the weights."""
    rows = saved(weights(docs, target, buckets, frequent, key, text), "weights")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    unit = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000) * F.log(-F.log(unit))).cast("long")
    rows = rows.select(F.col(key).alias("key"), "n_features", "weight", (F.col("weight") + noise).alias("score"),
                       (F.col("n_features") < 2 * least - 1).alias("short"))
    by = [F.col("short"), F.desc("score"), F.asc_nulls_last("key"), F.col("n_features")]
    rows = write_ordered(rows, by, shared_path(docs.sparkSession, "scores"))
    eligible = rows.where("not short").count()
    position = F.col("position")
    return with_positions(rows).select(
        F.col("key").alias(key), "n_features", "weight", "score",
        F.when(position < eligible * percent // 100, position + 1).alias("rank"))
