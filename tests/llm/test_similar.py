import random

import pytest

import corpus_pipeline
from paperloom.llm import similar

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(rng, n=60):
    """Rows with copies at similarities about 0.8, null and repeated ids, short and empty texts."""
    out = []
    for i in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(150)]
        out.append((i, " ".join(words)))
        for k in range(rng.randrange(4)):
            copy = list(words)
            for at in rng.sample(range(150), rng.randrange(1, 5)):
                copy[at] = f"x{rng.randrange(3000)}"
            out.append((rng.choice([1000 + 4 * i + k, None, 5, i]), " ".join(copy)))
    out += [(2000, out[0][1].upper()), (2000, out[0][1].upper()), (None, "alone and unique"), (None, "alone and unique"), (7, "other words"), (2001, None), (None, ""), (2002, "a b c"), (2003, "a b d"), (2004, "a b c")]
    rng.shuffle(out)
    return out


def brute_kept(rows):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))})
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                group[root(a)] = root(b)
    first = {}
    for x, (i, _) in enumerate(rows):
        first.setdefault(root(x), []).append((i is None, i or 0))
    return sorted(map(min, first.values())), [root(x) for x in range(len(rows))]


@pytest.mark.parametrize("seed", [1])
def test_near_stage_keeps_one_row_of_each_group(spark, seed):
    rows = texts(random.Random(seed))
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(5)
    found = corpus_pipeline.keep_one_of_group(spark, table, "").collect()
    want, groups = brute_kept(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == want
    of = {(i, t): g for (i, t), g in zip(rows, groups, strict=True)}
    assert len({of[r.doc_id, r.text] for r in found}) == len(found)  # a row of each group
    assert all(r.lang == "en" and r.n_chars == len(r.text or "") for r in found)


def test_near_stage_empty(spark):
    assert similar.one_of_group(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize(("rounds", "kept"), [(0, 512), (1, 512), (0, 16)])
def test_links_of_one_block(spark, monkeypatch, rounds, kept):
    """Chains: a block whose heads are like few of its members, compared in small squares and by many copies of a head; with few hashes kept, pairs are read."""
    from paperloom.llm.shared import Scratch

    for name, value in (("ROUNDS", rounds), ("SQUARE", 2), ("MEMBERS", 2), ("SLACK", 1.0), ("KEPT", kept), ("MARGIN", 1.0 if kept < 512 else similar.MARGIN)):
        monkeypatch.setattr(similar, name, value)
    said = [(i, " ".join(f"w{k}" for k in range(10 * i, 10 * i + 104))) for i in range(12)] + [(50, "alone " * 60)]
    nodes = spark.createDataFrame([(i, [7] + [1000 * i + k for k in range(1, similar.BANDS)]) for i, _ in said], "node long, bands array<long>")
    texts = spark.createDataFrame([(i, t.encode()) for i, t in said], "node long, text binary")
    scratch = Scratch(spark)
    found = similar.links(nodes, lambda wanted: texts.join(wanted, "node"), scratch)
    assert {r.node: r.root for r in similar.components(found, scratch).collect()} == {i: 0 for i in range(12)}


def test_agreement_is_similarity():
    import numpy as np

    a, b = np.arange(2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(200, 2200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert abs(similar.agreement(similar.sketch(a)[None], similar.sketch(b)[None])[0] - 1800 / 2200) < 0.1
    assert similar.jaccard(np.sort(a), np.sort(b)) == 1800 / 2200


def test_estimate_is_exact_for_whole_sets_and_near_for_others():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 40, 512, 6000):
        own = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        sets = []
        for share, more in ((1.0, 0), (0.95, n // 20), (0.8, n // 5), (0.0, 30)):
            part = own[: max(1, int(share * n))] if share else own[:0]
            sets.append(np.unique(np.concatenate([part, rng.integers(0, 1 << 63, more, dtype=np.uint64)])))
        wholes = np.array([len(x) <= similar.KEPT for x in sets])
        found = similar.estimate(similar.lowest(own), n <= similar.KEPT, [similar.lowest(x) for x in sets], wholes)
        want = np.array([similar.jaccard(own, x) for x in sets])
        assert (found == want).all() if n < 512 else (abs(found - want) < similar.MARGIN).all()


def test_hot_keys_are_attached_like_others(spark):
    from pyspark.sql import functions as F

    from paperloom.llm.shared import attach

    rows = spark.range(200).select(F.when(F.col("id") < 120, 1).otherwise(F.col("id") % 7).alias("k"), "id")
    of = spark.createDataFrame([(k, f"v{k}", 150 if k == 1 else 10) for k in range(5)], "k long, v string, n long")
    for limit in (5, 20, 1000):
        found = sorted((r.id, r.k, r.v, r.n) for r in attach(rows, of, ["k"], limit, F.col("id")).collect())
        want = [(i, k, f"v{k}", 150 if k == 1 else 10) for i in range(200) if (k := 1 if i < 120 else i % 7) < 5]
        assert found == want


def test_run_with_null_and_repeated_ids(spark, tmp_path):
    """All stages; without labels of both classes nothing is toxic, and texts here repeat no passage."""
    rows = [(i, t) for i, t in texts(random.Random(3), 15) if i is not None or t != ""]
    base = f"{tmp_path}/in"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    found = corpus_pipeline.run(spark, base).collect()
    want, _ = brute_kept(rows)
    pieces = [(r.doc_id is None, r.doc_id or 0) for r in found if r.start == 0]
    assert sorted(pieces) == want


def test_pairs_by_simhash_are_verified(spark):
    """With minima that meet nowhere SimHash alone finds the copy with one other word in a long text; a pair that is not similar is no link."""
    from paperloom.llm import simhash
    from paperloom.llm.shared import Scratch

    words = [f"w{k * k}" for k in range(900)]
    said = {4: words, 5: [*words[:-1], "x"], 6: words[::-1]}
    fps = {i: simhash.fingerprint(" ".join(w).encode(), similar.SHINGLE) for i, w in said.items()}
    fps[6] = fps[4]  # as if their SimHashes met
    assert (fps[4] ^ fps[5]).bit_count() <= 2
    nodes = spark.createDataFrame([(i, fp - (1 << 64) if fp >> 63 else fp, [100 * i + k for k in range(similar.BANDS)]) for i, fp in fps.items()], "node long, fp long, bands array<long>")
    texts = spark.createDataFrame([(i, " ".join(w).encode()) for i, w in said.items()], "node long, text binary")
    scratch = Scratch(spark)
    pairs = similar.by_simhash(nodes.select("node", "fp"), scratch)
    assert sorted(tuple(sorted(r)) for r in pairs.collect()) == [(4, 5), (4, 6)]
    found = similar.links(nodes.select("node", "bands"), lambda wanted: texts.join(wanted, "node"), scratch, more=pairs)
    assert [tuple(sorted(r)) for r in found.collect()] == [(4, 5)]


def test_the_stage_takes_pairs_by_simhash(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(similar, "by_simhash", lambda *a, way=similar.by_simhash: asked.append(way(*a)) or asked[-1])
    rows = [(1, "a b c d e f g h"), (2, "A b c d e f g  h"), (3, "other words")]
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_group(spark, table, "").collect()) == [1, 3]
    assert len(asked) == 1


def test_the_stage_has_the_driver_collect_after_each_table(spark, monkeypatch):
    from paperloom.llm import shared

    calls, made = [], []
    monkeypatch.setattr(shared.gc, "collect", lambda: calls.append(1))
    monkeypatch.setattr(similar, "Scratch", lambda *a, **k: made.append(shared.Scratch(*a, **k)) or made[-1])
    similar.one_of_group(spark.createDataFrame([], DOCS))
    assert made[0].collect and calls
    calls.clear()
    shared.Scratch(spark).keep(spark.range(3), "small")
    assert not calls
