import random

import xxhash

from sway.llm.simhash import fingerprint, simhash_components, simhash_dedup


def brute_fp(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(rows):
    fps = [brute_fp(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[i] < label[j]:
                    label[j] = label[i]
                    changed = True
    ids = {}
    for (d, _), lab in zip(rows, label):
        if d is not None:
            ids[lab] = min(ids.get(lab, d), d)
    return sorted((d is None, d or 0, fp, ids.get(lab)) for (d, _), fp, lab in zip(rows, fps, label))


def corpus(seed=5):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([400, 900]))]
        for _ in range(rnd.choice([1, 2, 25])):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append((len(rows) + 10, " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (1004, "One"), (1005, "one two"),
             (None, "one two"), (None, "only null"), (None, "only null"), (1007, rows[0][1]), (1007, rows[0][1]),
             (1008, "Éa x y z"), (1009, "long " * 60000)]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, component_id int")
    got = simhash_components(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp & (1 << 64) - 1, r.component_id) for r in got) == brute_components(rows)
    groups = {}
    for r in got:
        groups.setdefault((r.component_id, r.component_id is None and r.fp), []).append(r.stays)
    assert all(sum(s) == 1 for s in groups.values())


def test_dedup_keeps_one_row_of_each_group(spark, tmp_path):
    rows = corpus(6)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = simhash_dedup(docs)
    assert kept.columns == docs.columns
    ids = {r[3] for r in brute_components(rows)}
    assert {r.doc_id for r in kept.collect()} == ids
    assert kept.count() == len(ids)


def test_empty_table(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprint_is_lower_cased_in_ascii_only():
    assert fingerprint("A B C".encode()) == fingerprint(b"a b c")
    assert fingerprint("É b c".encode()) != fingerprint("é b c".encode())
