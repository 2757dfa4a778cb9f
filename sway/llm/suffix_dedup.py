"""Removal of repeated byte strings by a suffix array with bucket-pointer refinement.

A byte goes if a string of ``length`` bytes that covers it also starts earlier, in
a document with a smaller key or earlier in its own.

1. Copies. A text that equals an earlier one goes whole; the rest works on the
   first of each group of equal texts.
2. Anchors. In every window of ``length`` bytes the smallest hash of a ``GRAM``-byte
   gram, the leftmost of ties, is its anchor, so equal windows have equal anchors.
   Windows whose anchor occurs once in the corpus can't repeat.
3. Contexts. The bytes of all other windows go to the task of their anchor's
   hash: one context for the adjoining windows of an occurrence. An anchor with
   more than ``hot`` occurrences sends its windows one by one, by a hash of their
   bytes. A context that repeats within a batch is sent once; the later ones are
   known to go.
4. Suffix array. A task sorts the suffixes of its contexts to the depth of
   ``length`` bytes: buckets of 8-grams, then buckets refined by the bucket pointers
   at later offsets (8, 16, 32 bytes on, ...), each round using the pointers of the
   last one. Suffixes alone in their bucket leave the race. Of the windows in one
   bucket at full depth all but the earliest go. Contexts that are equal are sorted
   once, and go but for the earliest.
5. The covered bytes of a document are merged and cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sway.llm.common import byte_texts, numbered, saved

GRAM = 24
#: rows or spans up to which a join may broadcast a side (16 bytes each, or little more)
BROADCAST_ROWS = 2_000_000
#: bytes of contexts that a task sorts at once, and of texts that it looks for anchors in
BATCH = 1 << 20
#: contexts among which repeated ones are found before they are sent
GATHERED = 150_000


def gram_hashes(data):
    """64-bit hashes of the ``GRAM`` bytes from each place; ``data`` is followed by
    enough bytes."""
    import numpy as np

    n = len(data) - GRAM + 1
    word = np.array(np.ndarray((n + GRAM - 8,), "<u8", data.data, 0, (1,)))
    x = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k, factor in ((8, 0xC2B2AE3D27D4EB4F), (16, 0xD6E8FEB86659FD93)):
        x ^= x >> np.uint64(32)
        x += word[k:k + n]
        x *= np.uint64(factor)
    x ^= x >> np.uint64(29)
    return x


def anchors(data, ends, length: int, step: int = 1 << 17):
    """Anchors of all windows of the concatenated texts ``data`` (uint8) that end at
    ``ends``: text number, first window's start in it, number of windows, hash."""
    import numpy as np

    starts = np.concatenate([[0], ends[:-1]])
    padded = np.concatenate([data, np.zeros(length, np.uint8)])
    grams = length - GRAM + 1
    out = []
    for at in range(0, len(data), step):
        upto = min(at + step, len(data))
        hashes = gram_hashes(padded[at:upto + length - 1])
        low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while 2 * width <= grams:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < grams:
            low = np.minimum(low[:width - grams], low[grams - width:])
        text = np.searchsorted(ends, np.arange(at, upto), side="right")
        valid = np.flatnonzero(np.arange(at, upto) + length <= ends[text])
        if not len(valid):
            continue
        place = (low[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1)]))
        run = valid[first]
        out.append((text[run], at + run - starts[text[run]], np.diff(np.append(first, len(valid))), hashes[place[first]]))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out))


def repeated_windows(data, left, length: int):
    """Suffix array to the depth of ``length`` over the concatenated contexts
    ``data``; ``left`` is the number of bytes from each place to the end of its
    context. Returns the places of windows that repeat one at a smaller place."""
    import numpy as np

    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    grams = np.ndarray((n,), ">u8", padded.data, 0, (1,)).astype(np.uint64)
    pointer = np.full(n + length, -1, np.int64)
    depth, places = 8, np.flatnonzero(left >= 8)
    keys = grams[places]
    while True:
        order = np.argsort(keys)
        keys, places = keys[order], places[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(keys)))
        many = np.repeat(counts > 1, counts)
        bucket = np.repeat(first, counts)
        if depth == length:
            earliest = np.repeat(np.minimum.reduceat(places, first), counts) if len(first) else places
            return np.sort(places[many & (places != earliest)])
        pointer[:] = -1
        pointer[places[many]] = bucket[many]
        # two later pointers at once, where three of them fit into a key
        steps = 2 if n < 1 << 21 else 1
        deeper = min((steps + 1) * depth, length)
        places = np.flatnonzero((pointer[:n] >= 0) & (left >= deeper))
        offsets = [min(k * depth, deeper - depth) for k in range(1, steps + 1)]
        for offset in offsets:
            places = places[pointer[places + offset] >= 0]
        keys = pointer[places]
        for offset in offsets:
            keys = keys * n + pointer[places + offset]
        depth = deeper


def _runs(places):
    """Maximal runs of consecutive numbers as (first, last)."""
    import numpy as np

    edge = np.flatnonzero(np.diff(places) != 1)
    return places[np.concatenate([[0], edge + 1])], places[np.concatenate([edge, [len(places) - 1]])]


def _anchor_rows(length: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            texts, size, at = [], 0, 0
            for i, t in enumerate(byte_texts(batch.column(1)), 1):
                texts.append(t or b"")
                size += len(texts[-1])
                if size < BATCH and i < len(rows):
                    continue
                ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
                text, start, windows, hashes = anchors(np.frombuffer(b"".join(texts), np.uint8), ends, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(rows[at:][text]), pa.array(start * 256 + windows)],
                    names=["hash", "row", "place"])
                texts, size, at = [], 0, i

    return run


def _context_rows(length: int, names: list):
    """Contexts of the documents' repeated anchors, as (key, first, row, start, bytes);
    without bytes: a context that is known to repeat, and the end of its cover."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch in batches:
            first, row = (batch.column(k).to_numpy() for k in (0, 1))
            texts, places = list(byte_texts(batch.column(2))), batch.column(3)
            parent = np.repeat(np.arange(batch.num_rows), places.value_lengths().to_numpy())
            anchor, place, hot = (c.to_numpy(zero_copy_only=False) for c in places.flatten().flatten())
            start, windows = place >> 8, place & 255
            # one context for an anchor, but one for each window of a hot one
            upto = np.cumsum(np.where(hot, windows, 1))
            at = 0
            while at < len(place):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + GATHERED, side="right")))
                n = np.where(hot[at:to], windows[at:to], 1)
                which = at + np.repeat(np.arange(to - at), n)
                begin = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                end = begin + np.where(hot[which], 1, windows[which]) + length - 1
                of = parent[which]
                contexts = [texts[t][a:b] for t, a, b in zip(of.tolist(), begin.tolist(), end.tolist())]
                key = anchor[which]
                for k in np.flatnonzero(hot[which]).tolist():
                    h = xxh64_intdigest(contexts[k])
                    key[k] = h - (h >> 63 << 64)
                names_of = {}
                name = np.array([names_of.setdefault(c, len(names_of)) for c in contexts])
                order = np.lexsort((begin, row[of], first[of], name))
                known = np.append(False, name[order[1:]] == name[order[:-1]])
                contexts = [None if k else contexts[i] for i, k in zip(order.tolist(), known.tolist())]
                of, begin, end = of[order], begin[order], end[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[order]), pa.array(first[of]), pa.array(row[of]), pa.array(begin.astype(np.int32)),
                     pa.array(np.where(known, end, 0).astype(np.int32)), pa.array(contexts, pa.binary())], names=names)
                at = to

    return run


def _covered_rows(length: int):
    """Of contexts sorted by key: the covered byte ranges (row, start, end). Keys
    are gathered until ``BATCH`` bytes; a key's contexts stay together."""

    def solve(contexts):
        import numpy as np

        contexts.sort(key=lambda c: c[:3])  # earlier documents and places come first
        seen, different = set(), []
        for c in contexts:
            if c[3] in seen:
                yield c[1], c[2], c[2] + len(c[3])
            else:
                seen.add(c[3])
                different.append(c)
        contexts = different
        lengths = np.array([len(c[3]) for c in contexts], np.int64)
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(c[3] for c in contexts), np.uint8)
        left = np.repeat(ends, lengths) - np.arange(len(data))
        places = repeated_windows(data, left, length)
        if not len(places):
            return
        # a run never spans contexts: the last places of a context start no window
        for a, b in zip(*_runs(places)):
            c = np.searchsorted(ends, a, side="right")
            begin = contexts[c][2] + int(a - (ends[c] - lengths[c]))
            yield contexts[c][1], begin, begin + int(b - a) + length

    def run(batches):
        import pyarrow as pa

        def packed(rows):
            kinds = [pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["row", "start", "end"])

        waiting, size, last = [], 0, None
        for batch in batches:
            known = batch.column(5).is_null()
            yield pa.RecordBatch.from_arrays([c.filter(known) for c in batch.columns[2:5]], names=["row", "start", "end"])
            batch, rows = batch.filter(batch.column(5).is_valid()), []
            for key, first, row, start, context in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5))):
                if size > BATCH and key != last:
                    rows += solve(waiting)
                    waiting, size = [], 0
                waiting.append((first, row, start, context))
                size += len(context)
                last = key
            if rows:
                yield packed(rows)
        rows = list(solve(waiting)) if waiting else []
        if rows:
            yield packed(rows)

    return run


def covered(docs: DataFrame, length: int = 100, hot: int = 10_000) -> DataFrame:
    """Ranges ``(row, start, end)`` of bytes of ``docs (first, row, text)`` that go; they
    may overlap. Documents are ordered by ``first`` and ``row``, both long."""
    def anchor_rows():
        return docs.select("row", "text").mapInArrow(_anchor_rows(length), "hash long, row long, place long")

    # written, so that the join below has two plain sides and can split a common anchor
    times = saved(anchor_rows().groupBy("hash").agg(F.count("*").alias("times")).where("times > 1"), "times")
    again = (anchor_rows().join(times, "hash")
             .groupBy("row").agg(F.collect_list(F.struct("hash", "place", (F.col("times") > hot).alias("hot"))).alias("places")))
    names = ["key", "first", "row", "start", "end", "context"]
    contexts = docs.join(again, "row").select("first", "row", "text", "places").mapInArrow(
        _context_rows(length, names), "key long, first long, row long, start int, end int, context binary")
    # what is known to go needn't meet its key: it is spread by few numbers, which pack well
    known = F.col("context").isNull()
    spread = F.when(known, F.pmod(F.xxhash64("row"), F.lit(1 << 16))).otherwise(F.col("key"))
    return (contexts.withColumn("key", spread).withColumn("first", F.when(~known, F.col("first"))).repartition("key").sortWithinPartitions("key")
            .mapInArrow(_covered_rows(length), "row long, start int, end int"))


SPANS = "array<struct<start:int,end:int>>"


def _merge(ranges) -> list:
    """Sorted (start, end) pairs, overlapping and adjoining ones as one."""
    out = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _merge_rows(batches):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        spans = []
        for ranges in batch.column(1):
            starts, ends = (ranges.values.field(k).to_pylist() for k in ("start", "end"))
            spans.append([{"start": a, "end": b} for a, b in _merge(zip(starts, ends))])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["row", "spans"])


def _cut(text: bytes, spans) -> bytes:
    kept, at = [], 0
    for s in spans:
        kept.append(text[at:s["start"]])
        at = s["end"]
    return b"".join([*kept, text[at:]])


def suffix_dedup(docs: DataFrame, length: int = 100, hot: int = 10_000, key: str = "doc_id", text: str = "text",
                 with_kept: bool = False) -> DataFrame:
    """One row for each row of ``docs``: ``key``, ``n_bytes``, ``n_removed``, ``spans``
    (maximal removed ranges (start, end) in bytes, end exclusive), ``kept_sha256`` and,
    if wanted, ``kept`` (the bytes that stay; cuts may split a character).

    The rows are numbered and written once, and every step reads them there; keys are
    integers. Null texts are empty; texts shorter than ``length`` lose nothing; null keys
    come after all others and rows of one key in scan order, so of repeated rows the
    first stays; an empty table gives no rows. Other columns are not read."""
    if length < GRAM or length > GRAM + 254:
        raise ValueError(f"the length must lie between {GRAM} and {GRAM + 254}")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("first"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = numbered(rows, "rows", "row")
    copies = rows.select("first", "row", F.octet_length("text").alias("n"), F.unhex(F.sha2("text", 256)).alias("digest"))
    copies = copies.where(F.col("n") >= length)
    earliest = copies.groupBy("digest").agg(F.min(F.struct("first", "row")).alias("least"), F.count("*").alias("c")).where("c > 1")
    # written, so that the join has two plain sides and can split a common text
    earliest = saved(earliest, "earliest")
    copies = saved(copies.join(earliest, "digest").where("row <> least.row").select("row", F.lit(0).alias("start"), F.col("n").cast("int").alias("end")), "copies")
    few = copies.count() <= BROADCAST_ROWS
    rest = rows.join(F.broadcast(copies) if few else copies, "row", "left_anti")
    ranges = covered(rest, length, hot).unionByName(copies)
    spans = saved(ranges.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
                  .mapInArrow(_merge_rows, f"row long, spans {SPANS}"), "spans")
    few = (spans.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(spans) if few else spans, "row", "left").select("key", "text", "spans")

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            out = []
            for t, spans in zip(byte_texts(batch.column(1)), batch.column(2)):
                spans = spans.as_py() or []
                kept = _cut(t, spans)
                out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest(), *([kept] * with_kept)))
            columns = zip(*out) if out else [()] * (4 + with_kept)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    kinds = f"n_bytes long, n_removed long, spans {SPANS}, kept_sha256 string" + ", kept binary" * with_kept
    names = [key, "n_bytes", "n_removed", "spans", "kept_sha256"] + ["kept"] * with_kept
    return joined.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {kinds}")
