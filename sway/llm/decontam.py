"""Benchmark decontamination by an FM-index over every training shard.

Each task packs its documents into shards of a bounded number of words and
builds an FM-index over each: a suffix array over word numbers, its
Burrows-Wheeler transform in a wavelet tree, and sampled suffix positions. The
windows of the benchmark are searched backwards, all at once, through wavelet
ranks; occurrences are located by walking to a sampled position; overlapping
occurrences merge into removal spans. No text is shuffled. Words that no window
has end a suffix, as the end of a document does: no match crosses them.

The benchmark is handed to the tasks in blocks of a bounded size. One pass over
the documents serves one block; more blocks take more passes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sway.llm.common import byte_texts, saved, shared, unshared

#: every byte but 0-9, a-z and those of non-ASCII characters separates words
SEPARATORS = bytes(b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else 0x20 for b in range(256))
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().translate(SEPARATORS).split() if text else []


@dataclass
class Phrases:
    """Distinct windows of benchmark items as rows of word numbers (from 1)."""

    vocabulary: dict
    windows: object  # (n, width) int array, aligned to the right, padded with 0
    lengths: object
    items: list  # for each window the ids of its items

    @classmethod
    def of(cls, items, width: int) -> Phrases:
        import numpy as np

        vocabulary, owners = {}, {}
        for item, text in items:
            numbers = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            for at in range(max(1, len(numbers) - width + 1) if numbers else 0):
                owners.setdefault(tuple(numbers[at:at + width]), set()).add(item)
        windows = np.zeros((len(owners), width), np.int64)
        for row, window in zip(windows, owners):
            row[width - len(window):] = window
        return cls(vocabulary, windows, np.array([len(w) for w in owners], np.int64), [sorted(x) for x in owners.values()])


def suffix_array(symbols):
    """Suffix array of ``symbols``, where every 0 is a symbol of its own, smaller
    than the others and than every later 0; the last symbol is 0. Unresolved
    suffixes are sorted by their rank and the rank of what follows, doubling."""
    import numpy as np

    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    sa = np.argsort(rank, kind="stable")
    key, at, h = rank[sa], np.arange(n), 0
    while True:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(np.append(first, len(at)))
        rank[sa[at]] = np.repeat(at[first], counts)
        at = at[np.repeat(counts > 1, counts)]
        if not len(at):
            return sa
        h = 2 * h or 1
        suffixes = sa[at]
        key = rank[suffixes] * n + rank[suffixes + h]
        order = np.argsort(key)
        key, sa[at] = key[order], suffixes[order]


class WaveletTree:
    """Ranks over a sequence of numbers, one bit of them a level, high bits first;
    a level holds the sequence sorted, stably, by the bits above."""

    def __init__(self, values, bits: int):
        import numpy as np

        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            values = np.concatenate([values[~bit], values[bit]])
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))

    def rank(self, value, at):
        """How often ``value`` occurs before ``at`` (arrays)."""
        import numpy as np

        low = np.zeros_like(at)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = (value >> self.bits - 1 - level & 1).astype(bool)
            a, b = ones[low], ones[at]
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
        return at - low


class FMIndex:
    def __init__(self, symbols, alphabet: int, sample: int = 16):
        import numpy as np

        sa = suffix_array(symbols)
        self.bwt = symbols[sa - 1]  # of suffix 0: the last symbol, a 0
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet + 1))])
        self.tree = WaveletTree(self.bwt, max(1, int(alphabet).bit_length()))
        # the walk of locate() goes no further than the symbol after a 0
        sampled = (sa % sample == 0) | (self.bwt == 0)
        self.samples = np.where(sampled, sa, -1).astype(np.int32)

    def search(self, windows, lengths):
        """The rows ``[first, last)`` of the suffixes that start with each window."""
        import numpy as np

        first = np.zeros(len(windows), np.int64)
        last = np.full(len(windows), len(self.bwt), np.int64)
        width = windows.shape[1]
        for step in range(width):
            live = np.flatnonzero((lengths > step) & (first < last))
            symbol = windows[live, width - 1 - step]
            first[live] = self.before[symbol] + self.tree.rank(symbol, first[live])
            last[live] = self.before[symbol] + self.tree.rank(symbol, last[live])
        return first, last

    def locate(self, rows):
        import numpy as np

        out, walked = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            known = self.samples[rows]
            done = known >= 0
            out[left[done]] = known[done] + walked[left[done]]
            left, rows = left[~done], rows[~done]
            walked[left] += 1
            symbol = self.bwt[rows]
            rows = self.before[symbol] + self.tree.rank(symbol, rows)
        return out


def shard_hits(documents, phrases: Phrases):
    """For each document of the shard, given as arrays of word numbers (0: in no
    window): its hit words as a boolean array, and the ids of its items."""
    import numpy as np

    sizes = np.array([len(d) for d in documents], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(starts[-1] + 1, np.int64)  # ends with a 0
    for d, s in zip(documents, starts):
        text[s:s + len(d)] = d
    # of several 0 in a row the first is enough
    kept = np.flatnonzero((text != 0) | np.concatenate([[True], text[:-1] != 0]))
    index = FMIndex(text[kept], len(phrases.vocabulary))
    first, last = index.search(phrases.windows, phrases.lengths)
    times = np.maximum(last - first, 0)
    window = np.repeat(np.arange(len(times)), times)
    rows = np.repeat(first - np.cumsum(times) + times, times) + np.arange(len(window))
    at = kept[index.locate(rows)]
    cover = np.zeros(len(text) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + phrases.lengths[window], -1)
    hit = np.cumsum(cover) > 0
    owner = np.searchsorted(starts, at, side="right") - 1
    items = [set() for _ in documents]
    for pair in np.unique(owner * max(1, len(times)) + window):
        items[pair // len(times)].update(phrases.items[pair % len(times)])
    return [hit[s:s + n] for s, n in zip(starts, sizes)], items


def spans(hit) -> list[tuple[int, int]]:
    """Maximal runs of true as (start, end), end exclusive."""
    import numpy as np

    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]


def without(text: bytes, cuts) -> str:
    """``text`` without the words of the spans ``cuts`` and what stands between."""
    places = [(m.start(), m.end()) for m in WORD.finditer(text.lower())]
    out, at = [], 0
    for a, b in cuts:
        out.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]]).decode()


def find(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", item: str = "item_id",
         shard_words: int = 1 << 20, block_bytes: int = 1 << 24, clean: bool = False,
         own: tuple[str, str, str] = ("n_words", "spans", "items")) -> DataFrame:
    """All columns of ``docs`` but ``text``, with ``n_words``, ``spans`` (removal
    spans ``(start, end)`` in words, end exclusive) and ``items`` (ids, as
    strings, of the benchmark items with a window in the text, each once); with
    ``clean``, ``text`` too, without its spans. ``own`` names the new columns, which
    replace columns of these names.

    A window is ``width`` consecutive words of an item; a shorter item is one
    window. Null and wordless texts have no words and no spans; null, empty and
    wordless items have no window; a null item id counts as the empty string;
    items that repeat an id count as one. A text of more than ``shard_words`` words
    is indexed in overlapping pieces. Either table may be empty."""
    rest = [c for c in docs.columns if c not in (*own, text)]
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"),
                             F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*docs.select(*rest).schema.fields, T.StructField(own[0], T.LongType()),
                           T.StructField(own[1], span), T.StructField(own[2], T.ArrayType(T.StringType())),
                           T.StructField(text, T.StringType())])
    empty = [F.lit(0).cast("long"), F.array().cast(span), F.array().cast("array<string>")]
    out = docs.select(*rest, *[c.alias(n) for c, n in zip(empty, own)], text)
    if blocks > 1:
        items = saved(items, "items")
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        phrases = shared(docs.sparkSession, Phrases.of(((r.item, r.text.encode()) for r in part.collect()), width))
        out = out.mapInArrow(_search(phrases, len(rest), schema.names, width, shard_words), schema)
        if blocks > 1:  # one block's index and workers at a time
            out = saved(out, "searched")
    if not clean:
        return out.drop(text)

    @F.pandas_udf("string")
    def cleaned(texts, cuts):
        import pandas as pd

        return pd.Series([without(t.encode(), [(c["start"], c["end"]) for c in x]) for t, x in zip(texts, cuts)], dtype=object)

    marked = F.size(own[1]) > 0
    cut = cleaned(F.when(marked, F.col(text)).otherwise(""), F.col(own[1]))
    return out.withColumn(text, F.when(marked, cut).otherwise(F.col(text)))


def _search(broadcast, rest: int, names: list, width: int, shard_words: int):
    """The function for mapInArrow: a batch's rows are put into shards, a shard's
    rows leave together."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        phrases = unshared(broadcast)
        get = phrases.vocabulary.get
        for batch in batches:
            texts = batch.column(rest + 3)
            found = [(s, i) for s, i in zip(batch.column(rest + 1).to_pylist(), batch.column(rest + 2).to_pylist())]
            counts = [0] * len(texts)
            pieces, owner, size = [], [], 0

            def flush():
                hits, items = shard_hits([p[1] for p in pieces], phrases)
                by_row = {}
                for (start, _), row, hit, ids in zip(pieces, owner, hits, items):
                    if ids:
                        cover, all_ids = by_row.setdefault(row, (np.zeros(counts[row], bool), set()))
                        cover[start:start + len(hit)] |= hit
                        all_ids.update(ids)
                for row, (cover, ids) in by_row.items():
                    for s in found[row][0]:
                        cover[s["start"]:s["end"]] = True
                    found[row] = ([{"start": a, "end": b} for a, b in spans(cover)], sorted(ids.union(found[row][1])))

            for row, text in enumerate(byte_texts(texts)):
                numbers = np.array([get(w, 0) for w in words_of(text)], np.int64)
                counts[row] = len(numbers)
                for start in range(0, max(1, len(numbers) - width + 1), shard_words):
                    piece = numbers[start:start + shard_words + width - 1]
                    pieces.append((start, piece))
                    owner.append(row)
                    size += len(piece) + 1
                    if size >= shard_words:
                        flush()
                        pieces, owner, size = [], [], 0
            if pieces:
                flush()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:rest], pa.array(counts, pa.int64()),
                 pa.array([f[0] for f in found], batch.column(rest + 1).type),
                 pa.array([f[1] for f in found], batch.column(rest + 2).type), texts], names=names)

    return run


def n_hit(column) -> F.Column:
    """The number of words in removal spans."""
    return F.aggregate(column, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
