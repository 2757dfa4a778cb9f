"""SimHash near-duplicates by tiled exact comparison.

Fingerprints of all documents are reduced to the distinct ones. These are laid
out in tiles by the population counts of their four 16-bit quarters. The counts
of two fingerprints differ, summed over the quarters, by no more than their
Hamming distance, so a pair of tiles whose counts differ beyond the radius is
skipped; every other pair is compared in full with numpy XOR and bit counts.
A pair of tiles emits a spanning forest of its links, at most one link fewer
than it has fingerprints, which keeps the components and never lists all pairs
of a group of copies.

Cost: each fingerprint is sent to the tiles of its neighbouring counts, a fixed
number for a given radius (65 for 3), so the shuffle grows with the input; the
comparisons grow with the square of the distinct fingerprints over the number
of count cells (about one pair in twenty is compared at radius 3)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sway.llm.common import byte_texts, components, fresh, numbered, saved

QUARTERS = 4


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the lower-cased words of ``text``: a bit is set
    if it is set in over half of the shingles' hashes. No words: 0."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter((xxh64_intdigest(g, 42) for g in grams), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.uint32)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but ``text``, and ``fp``."""
    rest = [c for c in docs.columns if c != text]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(len(rest))
            fps = pa.array([fingerprint(t, shingle) for t in byte_texts(column)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(rest)], fps], names=[*rest, "fp"])

    schema = docs.select(*rest).withColumn("fp", F.lit(0).cast("long")).schema
    return docs.select(*rest, text).mapInArrow(run, schema)


def _quarter(fp, k: int):
    return F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)))


def _cell(counts) -> F.Column:
    """One integer for the population counts of the quarters, five bits each.
    A count of 0 to 16 is stored with 8 added, so that adding a move of up to 7
    never carries into the next quarter."""
    return sum(((c + 8) * 32 ** k for k, c in enumerate(counts)), F.lit(0)).cast("int")


def _forest(a, b, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between the fingerprints ``a`` and ``b``."""
    import numpy as np

    every = np.concatenate([a, b])
    label = np.arange(len(every))
    out = []
    step = max(1, (1 << 20) // len(b))
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at:at + step, None] ^ b[None, :]) <= radius
        for i in np.flatnonzero(near.any(axis=1)):
            hits = len(a) + np.flatnonzero(near[i])
            mine = label[at + i]
            own, first = np.unique(label[hits], return_index=True)
            for other, k in zip(own, first):
                if other != mine and every[at + i] != every[hits[k]]:
                    out.append((int(every[at + i]), int(every[hits[k]])))
            if len(own) > 1 or own[0] != mine:
                group = np.append(own, mine)
                label[np.isin(label, group)] = group.min()
    return out


def links(fps: DataFrame, radius: int = 3, tile: int = 4096) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the distinct values of ``fps.fp``
    within ``radius`` bits of each other (a spanning set, not all pairs)."""
    counts = [_quarter(F.col("fp"), k) for k in range(QUARTERS)]
    fps = fps.select("fp", _cell(counts).alias("cell"))
    # one row for each vector of population counts: 17^4 at most
    tiles_of = fps.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile)).alias("tiles"))
    tiles = saved(
        fps.join(tiles_of, "cell")
        .groupBy("cell", F.pmod(F.xxhash64("fp"), "tiles").cast("int").alias("tile"))
        .agg(F.collect_list("fp").alias("fps")), "tiles")
    moves = [sum(d * 32 ** k for k, d in enumerate(move)) for move in product(range(-radius, radius + 1), repeat=QUARTERS)
             if sum(map(abs, move)) <= radius and move >= (0,) * QUARTERS]
    left = tiles.select(F.col("cell").alias("cell_a"), F.col("tile").alias("tile_a"), F.col("fps").alias("a"),
                        F.explode(F.array(*[F.col("cell") + m for m in moves])).alias("cell"))
    pairs = (left.join(tiles, "cell").where("cell <> cell_a or tile >= tile_a")
             .select("a", F.col("fps").alias("b")))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = []
            for a, b in zip(batch.column(0), batch.column(1)):
                a, b = (np.asarray(x.values).view(np.uint64) for x in (a, b))
                found += _forest(a, b, radius)
            ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3, key: str = "doc_id",
                       text: str = "text", row: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``key``, ``row`` (its number: the column
    named by ``row``, or else that of the one scan), ``fp``, ``component_id`` (smallest key reachable over links of at most
    ``radius`` bits) and ``stays`` (true for one row of each component: the
    smallest key, then the smallest row number).

    Null and wordless texts have fingerprint 0 and link like any other; equal
    texts and repeated rows share a fingerprint; a component whose keys are all
    null has a null id and keeps one row; an empty table gives no rows. Other
    columns are not read, so their names can't clash."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(F.col(key).alias("key"), number.alias("row"), F.col(text).alias("text"))
    fps = saved(fingerprints(rows, shingle), "fingerprints")
    # the smallest key, nulls last, then the smallest row
    first = F.min(F.struct(F.col("key").isNull(), "key", "row")).alias("first")
    distinct = saved(fps.groupBy("fp").agg(first), "distinct")
    roots = components(links(distinct, radius))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    classes = rooted.join(least, "root").select("fp", "least")
    return fps.join(classes, "fp").select(
        F.col("key").alias(key), "row", "fp", F.col("least.key").alias("component_id"),
        (F.col("row") == F.col("least.row")).alias("stays"))


def simhash_dedup(docs: DataFrame, shingle: int = 3, radius: int = 3, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, all columns, whatever their
    names. They are numbered and written once."""
    columns, (row,) = docs.columns, fresh(docs, "__row")
    docs = numbered(docs, "rows", row)
    stays = simhash_components(docs, shingle, radius, key, text, row).where("stays").select(F.col("row").alias(row))
    return docs.join(stays, row, "left_semi").select(*columns)
