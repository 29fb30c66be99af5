import numpy as np
import pyarrow as pa

from paperloom.llm import toxicity

TEXTS = [b"aa bb cc", b"aa bb dd", b"cc aa bb", b"dd dd aa", b"ee bb", b"cc cc aa ee"]
TOXIC = np.array([1, 1, 1, 0, 0, 0])


def test_ratios_are_kneser_ney():
    """Against plain Python: document counts of bigrams, continuation counts of the class, those of both classes."""
    sample = toxicity.Sample(pa.array(TEXTS, pa.binary()), TOXIC)
    d, n = 0.25, len(sample.names)
    held = [set() for _ in TEXTS]
    for k, t in enumerate(TEXTS):
        stream = [None, *(x for w in t.split() for x in (("stem", w), w))]
        held[k] = set(zip(stream, stream[1:]))
    every = sorted({p for h in held for p in h}, key=str)

    def continued(pairs, w, below):
        kinds = len({c for _, c in pairs})
        return max(0, sum(c == w for _, c in pairs) - d) / len(pairs) + d * kinds / len(pairs) * below

    def p(docs, h, w):
        mine = {q for k in docs for q in held[k]}
        q = continued(mine, w, continued(every, w, 1 / (n + 1)))
        count = {x: sum(x in held[k] for k in docs) for x in mine if x[0] == h}
        total = sum(count.values())
        return max(0, count.get((h, w), 0) - d) / total + d * len(count) / total * q if total else q

    want = [np.log(p([0, 1, 2], *x) / p([3, 4, 5], *x)) for x in every]
    assert np.allclose(sorted(sample.smoothed(*sample.ratios(np.ones(6, bool), d), 0)[1]), sorted(want))


def test_rare_words_are_evidence():
    """A telling word that fewer than RARE documents hold moves the score."""
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "mat", "ran"], 30)) + (" vile" if k % 2 and k < 14 else "") for k in range(200)]
    model = toxicity.fit(pa.array([t.encode() for t in texts], pa.binary()), np.arange(200) % 2, 0.5)
    sums, _ = model.sums(pa.array([b"vile", b"unknown"], pa.binary()))
    assert sums[0] > 0.5 and sums[1] == 0


def test_score_is_that_of_the_models(spark):
    """The query's scores against plain Python on the learnt ratios; texts of any length, null ids, clashing columns."""
    rng = np.random.default_rng(3)
    said = [" ".join(rng.choice(["the", "cat", "sat", "mat", "ran"], 30)) + (" vile hound" if k % 2 else "") for k in range(80)]
    rows = [(k, t, "x") for k, t in enumerate(said)] + [(None, said[1], "x"), (None, None, "x"), (3, said[3], "x"), (900, "vile " * 300_000, "x"), (901, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(4, None), (None, 1)], "doc_id long, toxic int")
    found = toxicity.score(docs, labels).collect()
    body, share = toxicity.learn(docs, labels)
    model = toxicity.loaded(body)
    assert len(found) == len(rows) and share > 0.4
    known, singles = dict(zip(model.bigrams.tolist(), model.bigram_llr)), dict(zip(model.unigrams.tolist(), model.unigram_llr))
    want = []
    for _, t, _ in rows:
        stream, pairs, _, _ = toxicity.tokens(pa.array([(t or "").encode()], pa.binary()))
        total = sum(known.get(p, singles.get(x, 0.0)) for x, p in zip(stream.tolist(), pairs.tolist()))
        z = model.weights[0] + model.weights[1] * total / max(1, len(stream)) ** model.power
        want.append(1 / (1 + np.exp(-z)))
    assert np.allclose(sorted(r.score for r in found), sorted(want))
    assert all(r.predicted == (r.score >= 0.3) and (r.doc_id is not None or not r.held_out) for r in found)


def test_sample_is_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BYTES", 100)
    docs = spark.createDataFrame([(k, ("vile " if k % 2 else "fine ") * 12) for k in range(40)], "doc_id long, text string")
    body, _ = toxicity.learn(docs, spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int"))
    assert len(toxicity.loaded(body).unigrams) <= 4
