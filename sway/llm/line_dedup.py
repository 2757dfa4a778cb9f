"""Line deduplication by a segment-partition edit join.

A line of n characters may differ by t(n) edits: one for every ``per`` characters, up to
the threshold; two lines are near if their edit distance is at most that of the
shorter. The shorter is split into t + 1 segments; an edit touches one of them at most,
so the longer line holds one unchanged, not far from its place. The segments are
indexed by edits, number and content; a line probes the index of its own and the t next
smaller lengths with the substrings at the places that can match (multi-match
aware). Lines that meet are verified with a banded bit-parallel edit distance.

Keys travel as 64-bit hashes with the 64-bit hash that names a line. Probes and
index meet in semi-joins, which adaptive execution can split, so a line or key
that holds a third of all rows isn't expanded there. What is left is cut into
blocks of at most about ``block`` lines of a key; the lines of two blocks are
compared inside one row, and links alone leave it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sway.llm.common import components, saved

#: rows (a few longs each) up to which a join may broadcast a side
BROADCAST_ROWS = 2_000_000
#: characters up to which the built-in distance is cheaper than the automaton
BUILT_IN_CHARS = 1000


def _segment(length: int, i: int, parts: int) -> tuple[int, int]:
    """Start (from 0) and length of segment ``i`` of a line: as even as can be,
    the longer ones last."""
    base, longer = divmod(length, parts)
    return base * i + max(0, longer + i - parts), base + (longer + i >= parts)


def _spots(n: int, threshold: int, per: int, probe: bool) -> list[int]:
    """Where a line of ``n`` characters is read for its keys, each place once: number of edits,
    number of the segment, and by how much start and size are more than an even share's, in
    16 bits each. The index has the line's own segments, a probe those of each length that
    the other line may have, at each possible shift."""
    out = []
    for edits in range(1, threshold + 1):
        for shorter in range(edits + 1 if probe else 1):
            other, share = n - shorter, n // (edits + 1)
            if other < edits * per or edits < threshold and other >= (edits + 1) * per:
                continue
            for i in range(edits + 1):
                start, size = _segment(other, i, edits + 1)
                # as many edits before the segment as there are segments before it, and as many
                # after as there are after
                shifts = range(max(-i, shorter - edits + i), min(i, shorter + edits - i) + 1) if probe else (0,)
                out += [(edits << 16 | i) << 32 | start + shift - share * i + (1 << 15) << 16 | size - share + (1 << 15)
                        for shift in shifts]
    return list(dict.fromkeys(out))


def key_rows(lines: DataFrame, threshold: int, per: int, probe: bool) -> DataFrame:
    """``(id, key)`` of the lines ``(id, line, n)``: the keys of their segments, for the index,
    or those under which it holds lines that may be near (``probe``). A key holds number
    and content of a segment and the number of edits; the segment's size leaves
    ``edits + 1`` lengths of its line. The places are a table by the length, or what the length
    leaves by the number of segments; one expression reads them all. Characters of
    one byte each are counted as bytes, so that none is read to find a place."""
    parts, low = threshold + 1, threshold * per + threshold
    table = F.array(*[F.array(*[F.lit(x).cast("long") for x in _spots(n, threshold, per, probe)]).cast("array<bigint>")
                      for n in range(low + parts)])
    n, line, spot = F.col("n"), F.col("line"), F.col("spot")
    places = F.get(table, F.when(n < low, n).otherwise((n - low) % parts + low))
    rows = lines.select("id", "line", "n", (F.octet_length("line") == n).alias("plain"), F.explode(places).alias("spot"))
    part = lambda bits: F.shiftright(spot, bits).bitwiseAND(F.lit((1 << 16) - 1)).cast("int")
    share = F.call_function("div", n, part(48) + 1).cast("int")
    start, size = share * part(32) + part(16) - ((1 << 15) - 1), share + part(0) - (1 << 15)
    text = F.when(F.col("plain"), F.substring(line.cast("binary"), start, size).cast("string")).otherwise(F.substring(line, start, size))
    return rows.select("id", F.xxhash64(F.shiftright(spot, 32), text).alias("key"))


_HALVES = [1 << k for k in range(30, -1, -1)]


def _common(a, b, most, reverse: bool = False) -> F.Column:
    """Length of the longest common prefix (or suffix) of at most ``most``
    characters, by halving steps."""
    steps = F.filter(F.array(*map(F.lit, _HALVES)), lambda step: step <= most)

    def part(x, done, step):
        return F.substring(F.right(x, done + step), F.lit(1), step) if reverse else F.substring(x, done + 1, step)

    return F.aggregate(steps, F.lit(0), lambda done, step: F.when(
        (done + step <= most) & (part(a, done, step) == part(b, done, step)), done + step).otherwise(done))


def near(a, b, threshold: int) -> F.Column:
    """Whether the edit distance of ``a`` and ``b`` is at most ``threshold``.

    What both begin and end with is cut off. Over the rest, bit k of the number
    for e edits tells that the prefix of ``b`` read so far turns into the prefix of
    ``a`` that is k - threshold characters longer with e edits or fewer. A step
    reads a character of ``b`` and moves the band of 2 * threshold + 1 cells on."""
    t = threshold
    whole = (1 << 2 * t + 1) - 1

    def rest(x):
        head = _common(x["a"], x["b"], F.least(F.length(x["a"]), F.length(x["b"])))
        return F.struct(F.substring(x["a"], head + 1, F.length(x["a"])).alias("a"),
                        F.substring(x["b"], head + 1, F.length(x["b"])).alias("b"))

    def core(x):
        tail = _common(x["a"], x["b"], F.least(F.length(x["a"]), F.length(x["b"])), reverse=True)
        return F.struct(F.left(x["a"], F.length(x["a"]) - tail).alias("a"), F.left(x["b"], F.length(x["b"]) - tail).alias("b"))

    def chars(x):
        return F.struct(F.filter(F.split(x["a"], ""), lambda c: c != "").alias("a"),
                        F.filter(F.split(x["b"], ""), lambda c: c != "").alias("b"))

    def verdict(x):
        m, n = F.size(x["a"]), F.size(x["b"])

        def step(state, j):  # j: characters of b read, this one included
            equal = sum((F.when(F.get(x["a"], j - 1 - t + k) == F.get(x["b"], j - 1), 1 << k).otherwise(0)
                         for k in range(2 * t + 1)), F.lit(0))
            return F.when(state[f"e{t}"] == 0, state).otherwise(_moved(state, equal, m, j))

        def _moved(state, equal, m, j):
            # cells before the first or after the last character of a don't exist
            low = F.greatest(F.lit(0), t - j)
            high = F.least(F.lit(2 * t), m - j + t)
            inside = F.when(high < 0, 0).otherwise(
                F.lit(whole).bitwiseAND(-F.call_function("shiftleft", F.lit(1), low))
                .bitwiseAND(F.call_function("shiftleft", F.lit(2), F.greatest(F.lit(0), high)) - 1))
            now = [state["e0"].bitwiseAND(equal).bitwiseAND(inside)]
            for e in range(1, t + 1):
                before = state[f"e{e - 1}"]
                now.append(state[f"e{e}"].bitwiseAND(equal).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1))
                           .bitwiseOR(F.shiftleft(now[-1], 1)).bitwiseAND(inside))
            return F.struct(*[v.cast("int").alias(f"e{e}") for e, v in enumerate(now)])

        # nothing read: the first e characters of a are e edits away
        begin = F.struct(*[F.least(F.lit(whole), F.lit(((1 << e + 1) - 1) << t)).bitwiseAND(
            F.call_function("shiftleft", F.lit(2), F.least(F.lit(2 * t), m + t)) - 1).cast("int").alias(f"e{e}")
            for e in range(t + 1)])
        end = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), begin, step)
        return F.when(F.abs(m - n) > t, False).otherwise(
            F.call_function("shiftright", end[f"e{t}"], m - n + t).bitwiseAND(1) == 1)

    # a chain of transforms, so that each stage is computed once
    pair = F.array(F.struct(a.alias("a"), b.alias("b")))
    for stage in (rest, core, chars, verdict):
        pair = F.transform(pair, stage)
    return F.get(pair, F.lit(0))


def possible(a, b, length, threshold: int) -> F.Column:
    """False for most pairs of lines, ``a`` of ``length`` characters, that ``near`` says no
    to, at a tenth of its cost: lines that share a segment mostly differ by words. The
    built-in distance takes the square of the length, so long lines are left to ``near``."""
    return (length > BUILT_IN_CHARS) | (F.levenshtein(a, b, threshold) >= 0)


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The lines ``(key, row, line_no, line, id)`` of all texts that aren't blank."""
    rows = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    lines = rows.where("text is not null").select("key", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.regexp_like("line", F.lit(r"[^\x00-\x20]"))).withColumn("id", F.xxhash64("line"))


def _measured(lines: DataFrame) -> DataFrame:
    """``(id, line, n)``, ``n`` the length. It comes out of a generator of one row, so
    that expressions which read it often read a column."""
    return lines.select("id", "line", F.explode(F.array(F.length("line"))).alias("n"))


def _shared(side: DataFrame) -> DataFrame:
    """A side of a join, broadcast if its counted rows are few."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def links(lines: DataFrame, threshold: int, per: int, block: int = 64) -> DataFrame:
    """All pairs ``(a, b)``, a < b, of ids of different near lines, each once."""
    lines = _measured(lines).where(F.col("n") >= per)
    # an index entry once, however often its line occurs
    index = saved(key_rows(lines, threshold, per, False).distinct(), "segments")
    probe = key_rows(lines, threshold, per, True)
    other = index.select(F.col("key").alias("key2"), F.col("id").alias("id2"))
    probe = saved(probe.join(other, (F.col("key") == F.col("key2")) & (F.col("id") != F.col("id2")), "left_semi").distinct(),
                  "probes")
    index = saved(index.join(_shared(probe.select("key").distinct()), "key", "left_semi"), "index")
    both = index.withColumn("role", F.lit(0)).unionByName(probe.withColumn("role", F.lit(1)))
    blocks = both.groupBy("key", "role").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks"))
    both = both.join(blocks, ["key", "role"]).withColumn("block", F.pmod(F.xxhash64(F.lit(7), "id"), "blocks"))
    ids = saved(both.select("id").distinct(), "ids")
    texts = lines.join(_shared(ids), "id").dropDuplicates(["id"])
    grouped = saved(both.join(texts, "id").groupBy("key", "role", "block")
                    .agg(F.collect_list(F.struct("id", "line", "n")).alias("lines")), "blocks")
    side = lambda role, name: grouped.where(F.col("role") == role).select("key", F.col("lines").alias(name))
    found = side(1, "p").join(side(0, "q"), "key").select(F.explode("p").alias("p"), "q")
    # of two lines of one length, both probe: one of the probes is enough
    close = lambda x, edits: possible(x["line"], F.col("p.line"), x["n"], edits) & near(x["line"], F.col("p.line"), edits)

    def verified(x):  # the line of the index is the shorter one
        out = F.when(x["n"] >= threshold * per, close(x, threshold))
        for edits in range(threshold - 1, 0, -1):
            out = out.when(x["n"] >= edits * per, close(x, edits))
        return out

    hits = F.filter("q", lambda x: (
        (x["id"] != F.col("p.id")) & ((x["n"] < F.col("p.n")) | ((x["n"] == F.col("p.n")) & (x["id"] < F.col("p.id"))))
        & verified(x)))
    hits = found.select(F.col("p.id").alias("a"), F.transform(hits, lambda x: x["id"]).alias("hits"))
    hits = hits.select("a", F.explode("hits").alias("b"))
    return hits.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_lines(docs: DataFrame, threshold: int = 2, per: int = 5, block: int = 64, key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """One row for each line that isn't blank: ``key``, ``row`` (of ``docs``, in
    scan order), ``line_no`` (from 0), ``class_id`` (of the near-duplicate class: the
    least line id reachable over links), ``links`` (number of different lines near
    it) and ``kept``: true for one line of a class, the first by key (nulls last),
    row and number.

    Lines are near if they differ by at most one edit for every ``per`` characters of the
    shorter one, and by ``threshold`` edits at most: with 5, four fifths of a line stay as
    they are. Lines of fewer than ``per`` characters are near none; like all lines they
    share a class with equal ones.

    ``docs`` must be a scan that yields the same rows again, such as a table. Lines
    end at line feeds. Null texts have no lines, blank lines (spaces and control
    characters only) no class; rows that repeat are lines of their own; an empty table
    gives no rows. Other columns are not read. Lines are named by a 64-bit hash."""
    if threshold < 1 or per <= threshold:
        raise ValueError("a line that may differ needs more characters for each edit than there are edits")
    lines = lines_of(docs, key, text)
    found = saved(links(lines, threshold, per, block), "links")
    degree = found.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    classes = components(found).withColumnsRenamed({"node": "id", "root": "class_id"}).join(degree, "id")
    classes = _shared(saved(classes, "classes"))
    lines = saved(lines.select("key", "row", "line_no", "id"), "lines").join(classes, "id", "left").select(
        "key", "row", "line_no", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    # written, so that the join has two plain sides and can split a common line
    first = saved(lines.groupBy("class_id").agg(
        F.min(F.struct(F.col("key").isNull(), "key", "row", "line_no")).alias("first")), "first")
    return lines.join(first, "class_id").select(
        F.col("key").alias(key), "row", "line_no", "class_id", "links",
        ((F.col("row") == F.col("first.row")) & (F.col("line_no") == F.col("first.line_no"))).alias("kept"))
