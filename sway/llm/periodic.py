"""Periodic runs of words by recompression.

A run is a stretch of consecutive words with smallest period q, at least 2 * q (and
``least``) words long, that no neighbouring word extends keeping the period.

1. Harmonic grid. A run with period p holds a grid point k * p and the next one, so
   the pairs (k * p, (k + 1) * p) for all p are all candidates there can be: n ln n
   of them. Most end at their first word; what agrees over too few words in a row to
   make a run of ``least`` goes too.
2. Recompression. The word numbers of the texts that are left become a run-length
   grammar: maximal blocks of one symbol turn into one, then the symbols are split
   into left and right ones and every left-right pair turns into one, by turns until
   one symbol is left. Equal stretches are parsed alike but for their edges.
3. Extensions. The longest common extension of two places climbs the levels as long
   as both stand at the start of equal nodes, then descends to the words at which
   they part: a step or two a level, for all candidates at once. The mirrored levels
   give extensions to the left. Together they bound the run exactly."""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import DataFrame

from sway.llm.common import byte_texts

#: bytes of texts that a task works on at once; a longer text is worked on alone
BATCH = 1 << 20
#: candidates that are looked at together
CANDIDATES = 1 << 20

#: one level: ``symbols`` (and a last one that equals none), ``edge`` (whether a node of the
#: level above starts there), ``up`` (the node above), ``first`` (where the nodes
#: above start), ``blocks`` (whether these are blocks or pairs)
Level = namedtuple("Level", "symbols edge up first blocks")


def _level(symbols, edge, blocks):
    import numpy as np

    symbols, edge = np.append(symbols, -1), np.append(edge, True)
    return Level(symbols, edge, np.cumsum(edge) - 1, np.flatnonzero(edge), blocks)


def grammar(symbols):
    """The levels of the grammar of ``symbols``, an array of numbers from 0 on, the
    lowest first. The last one isn't compressed any further."""
    import numpy as np

    levels, turn = [], 0
    while len(symbols) > 1 and turn < 400:
        turn += 1
        if turn % 2:
            edge = np.append(True, symbols[1:] != symbols[:-1])
            if edge.all():
                continue
            first = np.flatnonzero(edge)
            names = symbols[first] * (len(symbols) + 1) + np.diff(np.append(first, len(symbols)))
        else:
            mixed = (symbols + turn).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            left = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63) == 0
            pairs, turned = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
            pairs = turned if turned.sum() > pairs.sum() else pairs
            if not pairs.any():
                continue
            edge = np.append(True, ~pairs)
            first = np.flatnonzero(edge)
            second = np.append(symbols, 0)[first + 1]
            names = symbols[first] * (int(symbols.max()) + 2) + np.where(np.append(pairs, False)[first], second + 1, 0)
        levels.append(_level(symbols, edge, bool(turn % 2)))
        symbols = np.unique(names, return_inverse=True)[1]
    return [*levels, _level(symbols, np.ones(len(symbols), bool), False)]


def mirrored(levels):
    """The levels of the same grammar for the symbols read backwards."""
    out = []
    for level in levels:
        out.append(_level(level.symbols[-2::-1], level.edge[:0:-1], level.blocks))
    return out


def extensions(levels, a, b):
    """How many symbols agree from places ``a`` and ``b`` on (arrays, a < b everywhere)."""
    import numpy as np

    begin, parted = a, []
    which = np.arange(len(a))
    for level in levels[:-1]:
        same = level.symbols[a] == level.symbols[b]
        parted.append((which[~same], a[~same], b[~same]))
        which, a, b = which[same], a[same], b[same]
        # inside a node one side at least: on to its end
        rest_a, rest_b = level.first[level.up[a] + 1] - a, level.first[level.up[b] + 1] - b
        step = np.where(level.edge[a] & level.edge[b], 0, np.minimum(rest_a, rest_b))
        a, b = a + step, b + step
        stop = (step > 0) & (rest_a != rest_b)
        parted[-1] = tuple(np.concatenate([x, y[stop]]) for x, y in zip(parted[-1], (which, a, b)))
        which, a, b = which[~stop], level.up[a[~stop]], level.up[b[~stop]]
    top = levels[-1].symbols
    last = []
    while len(which):
        same = top[a] == top[b]
        last.append((which[~same], a[~same], b[~same]))
        which, a, b = which[same], a[same] + 1, b[same] + 1
    which, a, b = (np.concatenate(x) for x in zip(*last)) if last else (which, a, b)
    for level, more in zip(levels[-2::-1], parted[::-1]):
        # different nodes: on over what both begin with
        a, b = level.first[a], level.first[b]
        step = (level.symbols[a] == level.symbols[b]).astype(np.int64)
        if level.blocks:
            inner = np.flatnonzero(step)
            step[inner] = np.minimum(*(level.first[level.up[x[inner]] + 1] - x[inner] for x in (a, b)))
        which, a, b = (np.concatenate(x) for x in zip((which, a + step, b + step), more))
    out = np.empty(len(begin), np.int64)
    out[which] = a
    return out - begin


def _grid(starts, counts):
    """Pairs (place, period) of the harmonic grids of the texts that start at
    ``starts`` and have ``counts`` words, some at a time."""
    import numpy as np

    halves = counts // 2
    text = np.repeat(np.arange(len(counts)), halves)
    period = np.arange(len(text)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    points = (counts[text] - 1) // period
    upto = np.cumsum(points)
    at = 0
    while at < len(text):
        # at least one (text, period), so at most one text's words beyond the bound
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CANDIDATES, side="right")))
        n = points[at:to]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p = np.repeat(period[at:to], n)
        yield np.repeat(starts[text[at:to]], n) + k * p, p
        at = to


def _agreeing(words, at, period, enough):
    """The candidates whose words agree at the place and around it ``enough`` times in
    a row, one more side counted up to there."""
    import numpy as np

    keep = words[at] == words[at + period]
    at, period = at[keep], period[keep]
    row = np.ones(len(at), np.int64)
    for side in (1, -1):
        going = np.arange(len(at))
        for k in range(1, enough):
            x, p = at[going] + side * k, period[going]
            going = going[(words[x] == words[x + p])]
            if not len(going):
                break
            row[going] += 1
    return at[row >= enough], period[row >= enough]


def runs_of(words, counts, least: int):
    """All runs of the texts whose word numbers (from 0 on) are in ``words``, one text
    after the other with ``counts`` words each, as arrays (text, start, length, period)
    in order of text, start and period."""
    import numpy as np

    none = (np.zeros(0, np.int64),) * 4
    counts = np.asarray(counts, np.int64)
    if not len(words):
        return none
    # a number of its own after each text and around all, so that no stretch leaves a text
    kinds, enough = int(words.max()) + 1, max(1, (least + 1) // 2)
    text = np.repeat(np.arange(len(counts)), counts)
    starts = np.cumsum(counts) - counts + np.arange(len(counts)) + enough
    whole = np.arange(kinds, kinds + len(words) + len(counts) + 2 * enough)
    whole[np.arange(len(words)) + text + enough] = words
    found = [_agreeing(whole, at, p, enough) for at, p in _grid(starts, counts)]
    at, period = (np.concatenate(x) for x in zip(*found)) if found else none[:2]
    if not len(at):
        return none
    # the grammar of the texts that hold a candidate
    of = np.searchsorted(starts, at, side="right") - 1
    some = np.unique(of)
    sizes = counts[some] + 1
    new = np.cumsum(sizes) - sizes
    inside = np.arange(sizes.sum()) - np.repeat(new, sizes) + np.repeat(starts[some], sizes)
    levels = grammar(np.unique(whole[inside], return_inverse=True)[1])
    back = mirrored(levels)
    at += new[np.searchsorted(some, of)] - starts[of]
    size, out = len(inside), []
    for k in range(0, len(at), CANDIDATES):
        a, p = at[k:k + CANDIDATES], period[k:k + CANDIDATES]
        start = a - extensions(back, size - a - p, size - a)
        end = a + p + extensions(levels, a, a + p)
        fits = end - start >= np.maximum(least, 2 * p)
        out.append((start[fits], end[fits], p[fits]))
    start, end, period = (np.concatenate(x) for x in zip(*out))
    # multiples of a period give the same stretch
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    once = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[:len(start)]
    start, end, period = start[once], end[once], period[once]
    of = np.searchsorted(new, start, side="right") - 1
    order = np.lexsort((period, start))
    return tuple(x[order] for x in (some[of], start - new[of], end - start, period))


def _rows(least: int, names: list):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

        def solved(keys, texts):
            counts = np.array([len(t) for t in texts], np.int64)
            words = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
            text, *run = runs_of(words, counts, least)
            start, length, period = run
            ends = np.cumsum(counts)
            # words after the first period of a run go
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, (ends - counts)[text] + start + period, 1)
            np.add.at(depth, (ends - counts)[text] + start + length, -1)
            stays = np.cumsum(depth) == 0
            kept = []
            for i, t in enumerate(texts):
                part = stays[ends[i] - counts[i]:ends[i]]
                kept.append(b" ".join(t if part.all() else [t[k] for k in np.flatnonzero(part)]))
            offsets = np.searchsorted(text, np.arange(len(texts) + 1))
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(x) for x in run], fields=list(kind.value_type)))
            kept = pa.array(kept, pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([keys, pa.array(counts), runs, kept], names=names)

        for batch in batches:
            texts, size, at = [], 0, 0
            for i, t in enumerate(byte_texts(batch.column(1)), 1):
                texts.append((t or b"").split())
                size += len(t or b"")
                if size >= BATCH or i == batch.num_rows:
                    yield solved(batch.column(0).slice(at, i - at), texts)
                    texts, size, at = [], 0, i

    return run


def periodic_runs(docs: DataFrame, least: int = 12, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``key``, ``n_words``, ``runs`` (structs of
    ``start``, ``length`` and ``period`` in words, numbered from 0, by start, then
    period) and ``collapsed`` (the words that stay, joined by one space: a word goes if
    a run holds it after the run's first period).

    Words are what white space of ASCII separates. Null and empty texts have none, and
    texts with fewer than ``least`` words no run. Texts are worked on one by one, so
    ties, repeated rows and null keys are like any other; a long text is worked on
    whole, in memory in proportion to its words. An empty table gives no rows; other
    columns are not read."""
    if least < 2:
        raise ValueError("a run has at least two words")
    names = [key, "n_words", "runs", "collapsed"]
    return docs.select(key, text).mapInArrow(
        _rows(least, names), f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words long, "
        "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
