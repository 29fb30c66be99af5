import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash

from paperloom.llm import ann, bpe, blocks, licences, packing, pretokens, simhash, substrings, topk, toxicity, urls

DOCS = "doc_id long, text string, u string, fp long, component_id long"


def docs(spark, rows):
    """With extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS)


def sentence(rng, n, words=("the", "cat", "sat", "on", "a", "mat", "é", "dog", "ran", "far")):
    return " ".join(rng.choices(words, k=n))


# SimHash
def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("limit", [2, 64])
def test_simhash_groups(spark, limit):
    rng = random.Random(1)
    base = [sentence(rng, 200, [f"w{i}" for i in range(400)]) for _ in range(6)]
    rows = [(i, base[i % 6] if i % 3 else base[i % 6] + f" x{rng.randrange(9)}") for i in range(60)] + [(90, None), (91, ""), (92, " \t"), (93, "ONE two"), (94, "one TWO"), (None, "one two"), (5, base[5])]
    found = simhash.near_duplicates(docs(spark, rows), limit).collect()
    assert len(found) == len(rows)
    fp = sorted({brute_fingerprint(t) for _, t in rows})
    group = {f: f for f in fp}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    for a in fp:
        for b in fp:
            if a < b and (a ^ b).bit_count() <= 2:
                group[root(b)] = root(a)
    least = {}
    for i, t in rows:
        if i is not None:
            r = root(brute_fingerprint(t))
            least[r] = min(i, least.get(r, i))
    want = sorted((i if i is not None else -1, brute_fingerprint(t), least[root(brute_fingerprint(t))]) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fp % 2**64, r.component_id) for r in found) == want


def test_packing_codes_added_tokens_like_the_library(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, "a <|endoftext|> b"), (None, "plain é"), (3, "<|endoftext|>" * 3), (3, "repeated id")]
    found = packing.pack(docs(spark, rows), ids=True).collect()
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in found) == sorted([*model.encode(t, add_special_tokens=False).ids, 0] for _, t in rows)


def test_empty_tables(spark):
    none = docs(spark, [])
    assert simhash.near_duplicates(none).count() == 0
    assert substrings.remove_repeats(none).count() == 0
    assert packing.pack(none).count() == 0
    assert bpe.encode(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(none, labels).count() == 0
    assert licences.scan(none).count() == 0


# Substring dedup
def brute_repeats(rows, k):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for a in range(len(w) - k + 1):
            if i is not None:
                first[tuple(w[a : a + k])] = min(i, first.get(tuple(w[a : a + k]), i))
    out = []
    for i, w in words:
        gone = set()
        for a in range(len(w) - k + 1):
            if i is not None and first[tuple(w[a : a + k])] < i:
                gone.update(range(a, a + k))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 3])
def test_substrings(spark, batches):
    rng = random.Random(2)
    shared = [sentence(rng, rng.choice([9, 10, 11, 30]), [f"w{i}" for i in range(99)]) for _ in range(5)]
    rows = [(i, f"{sentence(rng, 12)}\n{rng.choice(shared)}  {sentence(rng, 5)}") for i in range(50)]
    rows += [(60, None), (61, ""), (7, rows[7][1]), (62, shared[0]), (63, shared[0]), (None, shared[1])]
    found = substrings.remove_repeats(docs(spark, rows), "u", batches=batches, window=10, anchor=5).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == brute_repeats(rows, 10)
    assert all(hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == r.kept_sha256 for r in found)


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n)), "".join("ba"[i.bit_count() & 1] for i in range(n))


def test_windows_are_verified_by_their_words(spark):
    """Polynomial hashes modulo 2**64 of these two words are equal, whatever the base."""
    one, two = thue_morse(1024)
    rows = [(i, " ".join([*(f"w{k}" for k in range(24)), odd, *(f"v{k}" for k in range(25))])) for i, odd in ((1, one), (2, two), (3, one))]
    found = substrings.remove_repeats(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in found) == [(1, 0), (2, 0), (3, 50)]


def test_index_is_compacted_and_opened_again(spark, tmp_path):
    rng = random.Random(12)
    passage = [sentence(rng, 12, [f"w{i}" for i in range(99)]) for _ in range(3)]
    rows = [(i, f"{sentence(rng, 15, [f'x{i}' for i in range(200)])} {rng.choice(passage)}") for i in range(40)] + [(40, "long " * 30_000)]
    folder, scratch = f"file://{tmp_path}/index", substrings.Scratch(spark)
    got = []
    for a, b in ((0, 15), (15, 30), (30, 41)):  # an index for each session
        index = substrings.FingerprintIndex(spark, folder, most_runs=1)
        assert len(index.runs) == (a > 0)
        batch = docs(spark, rows[a:b])
        got += scratch.keep(substrings.add_batch(index, batch, docs(spark, rows[:b]), scratch, 10, 5), "gone").where(f"doc_id >= {a}").collect()
        if a:
            plan = substrings.reduce(lambda x, y: x.union(y), [index.run(r) for r in index.runs]).groupBy("fp", "doc_id").count()._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan  # buckets are merged where they lie
        index.compact()
        assert len(index.runs) == 1
        index.close()
    want = {i: n for i, _, n, _ in brute_repeats(rows, 10) if n}
    removed = {r.doc_id: len({w for at in r.gone for w in range(at, at + 10)}) for r in got}
    assert removed == want


# Packing
def test_best_fit_is_best_fit():
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 65, 400))[::-1]
    sequence, offset = packing.best_fit(lengths, 64)
    rooms = []
    for n, s, o in zip(lengths, sequence, offset, strict=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            assert rooms[s] == min(fits)
        else:
            assert s == len(rooms)
            rooms.append(64)
        assert o == 64 - rooms[s]
        rooms[s] -= n


def test_packing_keeps_every_id(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    rows = [(i, sentence(rng, rng.choice([1, 30, 900, 3000]))) for i in range(40)] + [(50, None), (51, "")]
    found = packing.pack(docs(spark, rows), ids=True).collect()
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in rows:
        pieces = sorted((r for r in found if r.doc_id == i), key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist()
        assert ids == [*model.encode(t or "", add_special_tokens=False).ids, 0]
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


# BPE
def test_pretokens_and_bpe():
    rng = random.Random(5)
    letters = "ab'strevlmdREé²1½ \n\t\xa0\x85.,!-_Ωж中"
    texts = ["".join(rng.choices(letters[: rng.choice([14, 22, len(letters)])], k=rng.randrange(30))) for _ in range(3000)] + ["", "'s", "a's b'll", "  's", "é" * 300, "the" * 200]
    column = pa.array([t.encode() for t in texts], pa.binary())
    tokens, first = pretokens.pretokens(column)
    found, pattern = tokens.to_pylist(), regex.compile(public_tokenizers.PATTERN)
    model, code = bpe.model(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids, at = code(column)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=model.ranks, special_tokens={})
    for i, t in enumerate(texts):
        assert [x.decode() for x in found[first[i] : first[i + 1]]] == pattern.findall(t)
        assert ids[at[i] : at[i + 1]].tolist() == other.encode_ordinary(t)


def test_bpe_round_trip(spark):
    rows = [(1, "Hello, wörld"), (2, None), (3, ""), (4, "x" * 5000)]
    for r in bpe.encode(docs(spark, rows)).collect():
        assert bytes(r.decoded).decode() == (dict(rows)[r.doc_id] or "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()


# Searches
def vectors(spark, seed=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, 8))
    x[50:60] = x[50]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(400, None, 1), (420, [float("nan")] * 8, 1), (440, [None] * 8, 1), (460, [0.0] * 8, 1), (None, [1.0] * 8, 1)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")


def test_topk(spark):
    x, table = vectors(spark)
    q = np.floor(64 * np.vstack([x, np.zeros((1, 8))])).astype(int)
    ids = [*range(300), 460]
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(table).collect()}
    for i, own in zip(ids, q, strict=True):
        if i % 20 == 0:
            best = sorted(((-int(own @ v), j) for j, v in zip(ids, q, strict=True) if j != i))[:20]
            assert [found.pop((i, k + 1)) for k in range(20)] == [(j, -s) for s, j in best]
    assert not found


def test_nearest(spark):
    x, table = vectors(spark)
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.search(table).collect()}
    hits = 0
    for i in range(0, 300, 20):
        scores = (x * x[i]).sum(axis=1)
        best = sorted((-s, j) for j, s in enumerate(scores) if j != i)[:20]
        mine = [found[(i, k + 1)] for k in range(20)]
        assert all(abs(s - scores[j]) < 1e-12 for j, s in mine) and mine == sorted(mine, key=lambda m: (-m[1], m[0]))
        hits += len({j for j, _ in mine} & {j for _, j in best})
    assert len(found) == 300 and hits >= 0.9 * 300


def test_repeated_query_rows(spark):
    """Alike query rows are one query, unlike ones of an id two; no candidate comes twice for it."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(60, 4))
    rows = [(i, x[i].tolist(), 1) for i in range(60)] + [(20, x[20].tolist(), 1), (40, x[0].tolist(), 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)
    for search, score in ((topk.search, lambda a, b: int(np.floor(64 * np.array(a)).astype(int) @ np.floor(64 * np.array(b)).astype(int))), (ann.search, lambda a, b: float((np.array(a) * np.array(b)).sum()))):
        want = []
        for q, v in {(i, tuple(v)) for i, v, _ in rows if i % 20 == 0}:
            best = sorted((-score(v, w), j) for j, w, _ in rows if j != q)[:20]
            want += [(q, k + 1, j, round(-s, 9)) for k, (s, j) in enumerate(best)]
        assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in search(table).collect()) == sorted(want)


def test_nearest_behind_many_rows_of_the_query(spark):
    rows = [(20, [1.0, 0.5])] * 25 + [(21, [1.0, 0.5]), (22, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    assert [(r.rank, r.vec_id) for r in ann.search(table).collect()] == [(1, 21), (2, 22)]


def test_many_shards(spark):
    """Several shards, vectors of different lengths, and an empty table."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(900, 6))
    x[:, 4:][::3] = 0
    rows = [(i, v[:4].tolist() if i % 3 == 0 else v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for search in (lambda t: ann.search(t, shard_rows=200), topk.search):
        found, hits = {}, 0
        for r in search(table).collect():
            found.setdefault(r.query_id, []).append(r.vec_id)
        for q in range(0, 900, 20):
            scores = x @ x[q] if search is not topk.search else np.floor(64 * x) @ np.floor(64 * x[q])
            best = sorted((-s, j) for j, s in enumerate(scores) if j != q)[:20]
            hits += len({j for _, j in best} & set(found[q]))
        assert hits >= (0.9 if search is not topk.search else 1) * 45 * 20
        assert search(table.limit(0)).count() == 0


def test_scores_beyond_a_long(spark):
    table = spark.createDataFrame([(20, [1e300, 1.0]), (1, [1e300, 1.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.search(table).collect()] == [(1, (1 << 63) - 1), (2, -(1 << 63))]


def test_partition_selection():
    rng = np.random.default_rng(7)
    scores, ids = rng.integers(0, 5, 200), rng.permutation(200)
    assert ids[blocks.top_of(scores, ids, 20)].tolist() == [i for _, i in sorted(zip(-scores, ids, strict=True))[:20]]


# URLs
@pytest.mark.parametrize("inline", [0, 2000])
def test_urls(spark, inline):
    said = ["http://example.org/es/1", "https://A.Example.ORG/en/12?x=/es/", "ftp://example.org", "x://fr.com/fr/a#b", "http://b.com/de/", "no url", None, "http://org/x", "http://notexample.org/es/", "http://b.com/de/", ""]
    table = spark.createDataFrame([(i, u, "h") for i, u in enumerate(said)], "page_id long, url string, host string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(table, urls.CONTRACT, inline=inline).collect()}
    for i, u in enumerate(said):
        rest = u.partition("://")[2] if u and "://" in u else ""
        host = regex.match(r"[^/?#]*", rest)[0]
        path = regex.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fit = [r for r in urls.CONTRACT if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.text), default=None)
        assert found[i] == (host, path, best.text if best else None, best.verdict if best else "allow")


# Licences
def test_licences():
    text = "some words before\nReleased under the MIT License. More words, and then: Licensed under the Apache Licence, Version 2.0. end " + "filler " * 300 + "This work is licensed under the GNU General Public License, version 2. No licence here."
    found = licences.find(text, tuple(licences.TEMPLATES))
    assert [(x["licence"], " ".join(text.split()[x["first_word"] :][:2])) for x in found] == [("MIT", "Released under"), ("GPL-2.0", "This work")]
    assert licences.find("", tuple(licences.TEMPLATES)) == []


# Toxicity
def test_toxicity_learns_stems(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, 60) + (f" vile{rng.choice('abcdef')} foul" if i % 5 == 0 else "")) for i in range(600)] + [(700, None), (701, "")]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)] + [(601, 1, None)], "doc_id long, quality int, toxic int")
    found = toxicity.score(docs(spark, rows), labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    unseen = [r for r in found if r.held_out and r.doc_id < 600]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in unseen]) > 0.95
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs(spark, rows), none).collect()} == {0.0}


def test_notices_side_by_side():
    text = "Released under the MIT License. Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0."
    assert [(x["licence"], x["first_word"]) for x in licences.find(text, tuple(licences.TEMPLATES))] == [("MIT", 0), ("CC-BY-NC-4.0", 5), ("CC-BY-4.0", 10)]


@pytest.mark.parametrize("chunk", [200, 1 << 24])
def test_cross_entropy_difference(spark, monkeypatch, chunk):
    from paperloom.llm import lm

    rng = random.Random(9)
    monkeypatch.setattr(lm, "CHUNK", chunk)  # many chunks and ranges, or few
    monkeypatch.setattr(lm, "RANGE", chunk)
    rows = [(i, sentence(rng, 30, ["Good", "fine", "well", "é"] if i % 2 else ["bad", "poor", "ill", "é"])) for i in range(40)] + [(50, None), (51, ""), (52, "once"), (53, "good, good"), (3, "fine ill")]
    target = spark.createDataFrame([(i,) for i in [*range(1, 20, 2), 53]] * 2 + [(None,)], "doc_id long")
    found = lm.score(docs(spark, rows), target, "u").collect()
    assert len(found) == len(rows) and all(r.u == "x" for r in found)
    held = {i for i in [*range(1, 20, 2), 53]}
    said = [regex.findall(r"[\p{L}\d]+", (t or "").lower()) for _, t in rows]
    vocabulary = len({w for ws in said for w in ws})
    want = []
    for r, ws in enumerate(said):
        loss = []
        for kept in (lambda i: rows[i][0] in held, lambda i: True):  # all counts but the document's own
            other = [[None, *said[k]] for k in range(len(rows)) if k != r and kept(k)]
            words = [w for x in other for w in x[1:]]
            pairs, contexts = [p for x in other for p in zip(x, x[1:])], [c for x in other if x[1:] for c in x]
            total = 0.0
            for p in zip([None, *ws], ws):
                base = (words.count(p[1]) + lm.ADDED) / (len(words) + lm.ADDED * vocabulary)
                c1 = contexts.count(p[0])
                total -= np.log(lm.BIGRAM * pairs.count(p) / c1 + (1 - lm.BIGRAM) * base if c1 else base)
            loss.append(total / max(1, len(ws)))
        want.append((rows[r][0], len(ws), *loss))
    got = sorted((r.doc_id, r.n_words, r.target_loss, r.background_loss) for r in found)
    assert np.allclose(got, sorted(want), atol=1e-9)
    assert all((r.difference < 0) == bool(r.doc_id % 2) for r in found if r.doc_id < 40 and r.n_words == 30)
