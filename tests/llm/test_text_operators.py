"""Operators over whole texts against brute force on a small corpus with every hard case."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import jaccard_join, lm_score, mixing, quality, sharding, suffix_dedup, textcore, token_output
from tests.llm import corpus


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.frame(spark).persist()


def test_words_match_the_definition():
    texts = ["", "A b\tC\x0bd", "  x  ", "é É ß", "\x1cz"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    h, b = textcore.words(data, offsets)
    names = {}
    for i, t in enumerate(texts):
        own = corpus.words(t)
        assert b[i + 1] - b[i] == len(own)
        for w, x in zip(own, h[b[i] : b[i + 1]].tolist()):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


def test_long_text_in_blocks_equals_one_block():
    text = ("word" * 3 + " ") * 800_000
    data = np.frombuffer(text.encode(), np.uint8)
    h, b = textcore.words(data, np.array([0, len(data)]))
    assert len(h) == 800_000 and (h == h[0]).all() and b.tolist() == [0, 800_000]


def _groups(rows):
    sets = {}
    for r in rows:
        w = corpus.words(r[1])
        if r[0] is not None:
            sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {k: (len(s), root(k)) for k, s in sets.items()}


def test_jaccard_join(spark, docs):
    got = jaccard_join.link_documents(docs).collect()
    want = _groups(corpus.rows())
    assert len(got) == len(corpus.rows())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert jaccard_join.link_documents(corpus.empty(spark)).count() == 0


@pytest.mark.parametrize("nodes, rare", [(1024, 48), (4, 2)])
def test_jaccard_join_counts_every_link(spark, monkeypatch, nodes, rare):
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", nodes)
    monkeypatch.setattr(jaccard_join, "_RARE", rare)
    r = random.Random(6)
    base = [f"w{r.randrange(900)}" for _ in range(120)]
    rows = list(corpus.rows())
    for i in range(40):  # one group of near copies, some of them copied, whose outer members are not linked
        w = list(base)
        for k in r.sample(range(len(w)), r.randrange(6)):
            w[k] = f"c{i}"
        rows += [(1000 + 3 * i + c, " ".join(w), *rows[0][2:]) for c in range(1 + i % 3)]
    sets = {}
    for row in rows:
        w = corpus.words(row[1])
        if row[0] is not None:
            sets[row[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    want = {k: sum(1 for o, t in sets.items() if o != k and s and t and 100 * len(s & t) >= 75 * len(s | t)) for k, s in sets.items()}
    got = jaccard_join.link_documents(spark.createDataFrame(rows, corpus.SCHEMA)).collect()
    assert len(got) == len(rows)
    assert all(q.n_links == want.get(q.doc_id, 0) for q in got)
    assert len({v for k, v in want.items() if k >= 1000}) > 3


def test_parity_bitmaps_bound_the_overlap():
    r = np.random.default_rng(0)
    for n, m, both in ((40, 50, 30), (300, 310, 290), (1, 1, 0), (2000, 1500, 1400)):
        x = np.unique(r.integers(0, 2**63, n + m, dtype=np.int64)).astype(np.uint64)
        a, b = np.sort(x[:n]), np.sort(np.concatenate([x[:both], x[n : n + m - both]]))
        p, q = jaccard_join.parity_bitmap(a), jaccard_join.parity_bitmap(b)
        w = min(len(p), len(q))
        differ = int(np.bitwise_count(jaccard_join._fold(p, w) ^ jaccard_join._fold(q, w)).sum())
        assert (len(a) + len(b) - differ) // 2 >= len(np.intersect1d(a, b))


@pytest.mark.parametrize("rounds, tile", [(1, 1024), (0, 1024), (0, 2), (12, 3)])
def test_large_tiles_find_the_links_of_small_ones(spark, docs, monkeypatch, rounds, tile):
    monkeypatch.setattr(jaccard_join, "SMALL", 1)
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "TILE_NODES", tile)
    got = {(r.doc_id, r.component_id) for r in jaccard_join.link_documents(docs, count_links=False).where("doc_id is not null").collect()}
    assert got == {(k, v[1]) for k, v in _groups(corpus.rows()).items()}


def test_equal_doc_ids_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(5, a), (5, b), (3, b), (9, a), (4, "other words here"), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link_documents(df, count_links=False).collect())
    assert got == [(3, 26, 3), (4, 0, 4), (4, 1, 4), (5, 26, 3), (5, 26, 3), (9, 26, 3)]


def _cut(rows):
    first = {}
    for i, t in rows:
        if i is not None:
            for k in range(len(t) - 49):
                w = t[k : k + 50]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if i is not None and first[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, x[2]))


def test_suffix_dedup(spark, docs):
    rows = [(r[0], (r[1] or "").encode()) for r in corpus.rows()]
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=lambda x: (x[0] is None, x[0] or 0, x[2]))
    assert got == _cut(rows)
    assert suffix_dedup.remove_repeats(corpus.empty(spark)).count() == 0


def test_loser_tree_merges_with_prefix_table():
    r = np.random.default_rng(4)
    runs, lcps = [], []
    for n in (0, 1, 30, 200, 55):
        x = r.integers(97, 99, (n, suffix_dedup.SPAN)).astype(np.uint8)
        x[:, 6:] = 97
        x = x[np.lexsort(x.T[::-1])] if n else x
        runs.append(x)
        lcps.append(suffix_dedup._neighbour_lcp(x))
    which, at, lcp = suffix_dedup.merge_runs(runs, lcps)
    merged = np.stack([runs[w][i] for w, i in zip(which, at)])
    assert [m.tobytes() for m in merged] == sorted(x.tobytes() for run in runs for x in run)
    assert (lcp[1:] == suffix_dedup._neighbour_lcp(merged)[1:]).all()


def test_front_coding_round_trip():
    text = np.frombuffer(("abcdefgh" * 40).encode(), np.uint8)
    at = np.arange(0, 200, 3)
    e, _ = suffix_dedup.Entries.cut(text, np.zeros(len(at), np.int64), np.full(len(at), len(text)), at, at.copy(), at.copy()).sorted()
    back, _ = suffix_dedup.Entries.from_run(e.to_run())
    assert (back.right == e.right).all() and (back.left == e.left).all() and (back.pos == e.pos).all()


def test_lm_score(spark, docs):
    out = lm_score.score_documents(docs).collect()
    toks = [(r[0], corpus.words(r[1]) + ["\0"]) for r in corpus.rows()]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in toks if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((i if i is not None else -1, held(i), len(t), sum(w in c for w in t), round(sum(math.log10((c.get(w, 0) + 1) / (n + v + 1)) for w in t), 6)) for i, t in toks)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out)
    assert got == want and {r.train_tokens for r in out} == {n}
    assert all(r.score < 0 for r in out)
    assert lm_score.score_documents(corpus.empty(spark)).count() == 0


def test_lm_score_follows_the_model_token_by_token(spark, monkeypatch):
    """Scores recomputed word by word from the fitted parameters, with the softmax over all classes."""
    fitted = []
    monkeypatch.setattr(lm_score.LogBilinear, "load", lambda self, flat, load=lm_score.LogBilinear.load: fitted.append(load(self, flat)) or self)
    classes, rows = 24, corpus.rows(3, 40)
    got = lm_score.score_documents(corpus.frame(spark, 3, 40).select("doc_id", "text"), classes=classes).collect()
    m = fitted[-1]
    name = lambda w: int(lm_score.END) if w is None else int(textcore.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0])
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    toks = [(r[0], corpus.words(r[1]) + [None]) for r in rows]
    c = collections.Counter(w for i, t in toks if not held(i) for w in t)
    top = sorted((w for w in c if w is not None), key=lambda w: (-c[w], name(w)))[: classes - 2]
    place = {w: k for k, w in enumerate(top)} | {None: classes - 2}
    rest = {w: n for w, n in c.items() if w not in place}
    want = []
    for i, t in toks:
        before, total = [classes, classes], 0.0
        for w in t:
            k = place.get(w, classes - 1)
            z = m.output.astype(float) @ (m.context[before[0]] * m.position[0] + m.context[before[1]] * m.position[1]).astype(float) + m.bias
            total += (z[k] - np.log(np.exp(z).sum())) / np.log(10)
            if k == classes - 1:
                total += math.log10((rest.get(w, 0) + 1) / (sum(rest.values()) + len(rest) + 1))
            before = [before[1], k]
        want.append((i if i is not None else -1, len(t), total))
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.score) for r in got)
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3 * max(1, a[1]) ** 0.5 for a, b in zip(have, sorted(want)))


def test_log_bilinear_is_normalised_and_learns():
    r = np.random.default_rng(1)
    m = lm_score.LogBilinear(16, 4)
    m.start_training()
    cls = np.tile([1, 2, 3, 4], 4000)
    before = lm_score._contexts(cls, np.array([0, len(cls)]), 16)
    p = np.bincount(cls, minlength=16) + 1.0
    m.bias = np.log(p / p.sum()).astype(np.float32)
    for _ in range(60):
        m.train(before[:4096], cls[:4096], p / p.sum(), r, 0.1)
    every = np.arange(16)
    total = sum(np.exp(m.log_prob(before[10:11], every[k : k + 1])) for k in range(16))
    assert abs(float(total[0]) - 1) < 1e-5
    assert m.log_prob(before[100:200], cls[100:200]).mean() > np.log(0.5)


def test_token_output(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = spark.createDataFrame([(900, "  a  b\n\n  c \n d   \t e  "), (901, " x"), (902, "x   y <|endoftext|> z  w  q"), (903, "\n \n")], "doc_id long, text string")
    all_docs = docs.select("doc_id", "text").unionByName(odd)
    got = token_output.read_documents(token_output.write_blocks(all_docs, path, block_ids=500)).collect()
    t, start, want = Tokenizer.from_file(path), 0, []
    for r in sorted(all_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    key = lambda x: (x[1], x[2])
    assert sorted(map(tuple, got), key=key) == want
    assert token_output.read_documents(token_output.write_blocks(corpus.empty(spark), path)).count() == 0


@pytest.mark.parametrize("values", [[], [0], [0, 0, 5], [7] * 700, list(range(0, 90_000, 37)), [2**40, 2**40 + 1]])
def test_elias_fano(values):
    e = token_output.EliasFano.encode(np.array(values, np.int64), values[-1] if values else 0)
    back, _ = token_output.EliasFano.from_bytes(memoryview(e.to_bytes()))
    assert back.values().tolist() == values and [back.select(i) for i in range(len(values))] == values


def test_mixing(spark, docs):
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size = collections.Counter()
    for r in corpus.rows():
        size[r[2]] += len(corpus.words(r[1]))
    names = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * size[s] + 1e-9}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
        left -= sum(target[s] for s in over)
        free -= over
    target |= {s: left * weight[s] / total for s in free}
    taken = collections.Counter()
    for r in got:
        assert r.taken <= 2 * r["size"] and r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] += r.taken
    # In s3 one text holds most words: all others twice and it once is the nearest sum from below.
    assert all(abs(taken[s] - target[s]) <= 3 for s in names if s != "s3") and taken["s3"] == 2 * size["s3"] - 6000
    assert mixing.mix_sources(corpus.empty(spark)).count() == 0
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns


@pytest.mark.parametrize("lengths, counts, budget", [([3, 5], [4, 2], 11), ([2], [5], 7), ([7, 11, 13], [3, 3, 3], 40), ([1], [1], 0)])
def test_fit_counts_is_best(lengths, counts, budget):
    take = mixing.fit_counts(lengths, counts, budget, list(range(len(lengths))))
    got = sum(a * b for a, b in zip(lengths, take))
    best = max(s for x in itertools.product(*[range(c + 1) for c in counts]) if (s := sum(a * b for a, b in zip(lengths, x))) <= budget)
    assert got <= budget and all(0 <= t <= c for t, c in zip(take, counts)) and got >= best - max(lengths)


def test_sharding(spark, docs):
    got = sharding.assign_shards(docs, limit=2000).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard_id].append(r)
    assert len(got) == len(corpus.rows())
    for rows in by.values():
        assert sum(r.n_bytes for r in rows) == rows[0].shard_bytes and len(rows) == rows[0].shard_rows
        assert rows[0].shard_bytes <= 2000 or len(rows) == 1
    ids = sorted(by)
    assert not any(b.startswith(a) and a != b for a, b in zip(ids, ids[1:]))
    same = spark.createDataFrame([(1, "x" * 100)] * 50, "doc_id long, text string")
    assert max(r.shard_bytes for r in sharding.assign_shards(same, limit=500).collect()) <= 500
    assert sharding.assign_shards(corpus.empty(spark)).count() == 0


def test_quality(spark):
    docs, rows = corpus.frame(spark, 2, 500), corpus.rows(2, 500)
    ids = [r[0] for r in rows if r[0] is not None and r[1]]
    toxic = {i for i in ids if i % 5 == 0}
    marked = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" nasty"))).otherwise(F.col("text")))
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in ids if i % 2 == 0] + [(None, 1, 0), (ids[0], None, None)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(marked, labels).collect()
    assert len(got) == len(rows)
    right = [(r.p_toxic >= 0.5) == (r.doc_id in toxic) for r in got if r.doc_id in set(ids)]
    assert sum(right) >= 0.9 * len(right)
    none = quality.score_documents(docs, labels.limit(0))
    assert none.where("kept").count() == docs.count()
    assert quality.score_documents(corpus.empty(spark), labels).count() == 0


def test_fit_counts_reaches_the_best_sum_with_long_documents():
    def words(lengths, counts, budget):
        take = mixing.fit_counts(lengths, counts, budget, list(range(len(lengths)))[::-1])
        assert all(0 <= a <= b for a, b in zip(take, counts))
        return sum(a * b for a, b in zip(lengths, take))

    assert words([200, 60000], [100, 1], 70000) == 70000
    assert words([90000, 100000], [1, 1], 95000) == 90000
    r = np.random.default_rng(3)
    for _ in range(20):
        lengths, counts = np.unique(r.integers(5000, 60000, 6)).tolist(), r.integers(1, 3, 6).tolist()
        counts = counts[: len(lengths)]
        budget = int(r.integers(20000, 150000))
        sums = [sum(a * b for a, b in zip(lengths, t)) for t in itertools.product(*(range(c + 1) for c in counts))]
        assert words(lengths, counts, budget) == max(x for x in sums if x <= budget)
