"""Conversations, embeddings, decontamination, components and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import chat_format, components, decontaminate, durable, embed_dedup, quality
from tests.llm import corpus


def test_conversations_read_back(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "b"), (2, 0, None, None), (2, None, "assistant", "é\n<\\s>"),
        (3, 5, "assistant", "\\[INST] <\\\\/s> x"), (None, 0, "user", "z"), (4, 0, "assistant", ""), (4, 1, "system", "s" * 5000),
    ] + [(5, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(40)]
    df = spark.createDataFrame([r + ("clash",) for r in rows], "conv_id long, turn long, role string, text string, node string")
    got = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    for k, r in got.items():
        own = sorted((x for x in rows if x[0] == k), key=lambda x: (x[1] is None, x[1] or 0, x[2] or "", x[3] or ""))
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_reply_trees_rank_branches(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 2.0), ("t", 4, 2, "user", "c", 5.0), ("t", 5, 3, "user", "d", 1.0), ("u", 9, 7, "user", "orphan", None), ("v", 1, 2, "user", "x", 1.0), ("v", 2, 1, "user", "y", 1.0)]
    m = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    paths = chat_format.reply_paths(m, branches=2).orderBy("tree", "branch", "pos").collect()
    got = {}
    for p in paths:
        got.setdefault((p.tree, p.branch), []).append(p.text)
    assert got == {("t", 1): ["q", "a", "c"], ("t", 2): ["q", "b", "d"], ("u", 1): ["orphan"]}


def test_embeddings_against_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(120, 16))
    x = np.concatenate([base, base[:40] + r.normal(size=(40, 16)) * 0.15, np.repeat(base[:1], 6, axis=0)])
    odd = [(-1, None), (-2, [0.0] * 16), (-3, [float("nan")] * 16), (-4, [None] * 16), (-5, [1.0, 2.0]), (-6, [2.0, 4.0]), (None, [1.0] * 16)]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + odd
    df = spark.createDataFrame([(*a, 1, "x") for a in rows], "vec_id long, embedding array<float>, label int, raw string")
    got = {q.vec_id: q for q in embed_dedup.link_embeddings(df).collect()}
    f = np.array([rows[i][1] for i in range(len(x))])
    f /= np.linalg.norm(f, axis=1)[:, None]
    near = (f @ f.T >= 0.9) & ~np.eye(len(f), dtype=bool)
    found = sum(got[i].n_links for i in range(len(f)))
    assert 0.9 * near.sum() <= found <= near.sum()
    assert all(got[i].n_links <= near[i].sum() for i in range(len(f)))
    assert [got[i].n_links for i in (-1, -2, -3, -4, None)] == [0] * 5 and got[-5].n_links == 1 == got[-6].n_links
    assert all(q.kept == (q.vec_id == q.component_id) for q in got.values() if q.vec_id is not None)
    assert embed_dedup.link_embeddings(df.limit(0)).count() == 0


def test_hamming_limit_keeps_pairs_at_the_threshold():
    r = np.random.default_rng(7)
    a = r.normal(size=(20000, 48))
    other = r.normal(size=a.shape)
    a /= np.linalg.norm(a, axis=1)[:, None]
    other -= (other * a).sum(axis=1)[:, None] * a
    other /= np.linalg.norm(other, axis=1)[:, None]
    b = 0.9 * a + np.sqrt(1 - 0.81) * other  # cosine 0.9 exactly
    turn = embed_dedup.learn_rotation(a[:2000], 0)
    apart = np.bitwise_count(embed_dedup.head_codes(a, turn) ^ embed_dedup.head_codes(b, turn))
    assert (apart <= embed_dedup.hamming_limit(0.9)).mean() > 0.9999 and apart.mean() < embed_dedup.hamming_limit(0.9) / 2
    assert embed_dedup.table_shape(1 << 30, 0.9)[0] > embed_dedup.table_shape(1 << 20, 0.9)[0] > embed_dedup.table_shape(1 << 12, 0.9)[0]


def test_repeated_vec_ids_and_double_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 1.0, 1e-9]), (3, [-0.0, 0.0, 1.0]), (4, [0.0, -0.0, 2.0])]
    got = sorted((q.vec_id, q.n_links, q.component_id) for q in embed_dedup.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3)]


def test_tiles_of_a_hot_cell_count_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE", 8)
    r = np.random.default_rng(5)
    x = np.ones((60, 8)) + r.normal(size=(60, 8)) * 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = embed_dedup.link_embeddings(df).collect()
    assert {q.n_links for q in got} == {59} and {q.component_id for q in got} == {0}


def test_leaks_and_clean_documents(spark):
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(900)]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    items = [text(r.randint(15, 60)) for _ in range(20)]
    rows, want = [], {}
    for i in range(150):
        t = text(r.randint(10, 300))
        if i % 10 == 0:
            item = items[i // 10]
            if i % 20 == 0:  # a paraphrase: every seventh word differs
                item = " ".join("zzz" if k % 7 == 3 else w for k, w in enumerate(item.split()))
            t = t + " " + item.upper() + ", " + text(20)
            want[i] = i // 10
        rows.append((i, t))
    rows += [(200, None), (201, ""), (202, items[16]), (None, text(20))]
    want[202] = 16
    docs = spark.createDataFrame([(*x, "w") for x in rows], "doc_id long, text string, words string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(50, None), (51, ""), (None, "x")], "item_id long, text string")
    got = decontaminate.find_leaks(docs, bench).collect()
    assert len(got) == len(rows)
    assert {q.doc_id: q.item_id for q in got if q.contaminated} == want
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).where("contaminated").count() == 0


def test_leaks_of_short_and_changed_items_equal_brute_force(spark, monkeypatch):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(900)]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    ids = lambda t: decontaminate.word_ids(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0]
    items = [text(m) for m in (5, 5, 5, 8, 8, 8, 16, 16, 40, 40) * 3] + ["one", "the the the the", "the of the of the"]
    rows = []
    for i in range(120):
        w = items[i % len(items)].split()
        if i % 2:  # 28 % of the words differ
            for k in r.sample(range(len(w)), int(0.28 * len(w))):
                w[k] = f"zz{i}"
        rows.append((i, " ".join([text(r.randint(40, 400)), *w, text(r.randint(0, 90))])))
    bench = list(enumerate(items))

    def leaks(t):
        w = ids(t)
        for n, item in bench:
            if any(decontaminate._judge(w, at, ids(item), ids(item).tolist())[0] for at in range(0, len(w), decontaminate.HALF)):
                yield n

    want = {i: found for i, t in rows if (found := sorted(leaks(t)))}
    for block in (decontaminate.ITEM_BLOCK, 10):
        monkeypatch.setattr(decontaminate, "ITEM_BLOCK", block)
        got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
        assert {q.doc_id: q.item_ids for q in got.where("contaminated").collect()} == want and len(want) > 90


def test_lcs_length():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = np.random.default_rng(0)
    for _ in range(50):
        a, b = r.integers(0, 6, r.integers(1, 30)), r.integers(0, 6, r.integers(1, 40))
        assert decontaminate.lcs_length(a, b) == plain(a.tolist(), b.tolist())


@pytest.mark.parametrize("block", [500_000, 3])
def test_components(spark, monkeypatch, block):
    monkeypatch.setattr(components, "BLOCK", block)
    links = [(1, 2), (2, 3), (10, 9), (5, 5), (3, 7), (7, 1)] + [(20 + i, 21 + i) for i in range(15)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = {r.node: r.component for r in components.components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 9: 9, 10: 9} | {k: 20 for k in range(20, 36)}
    assert components.components(df.limit(0)).count() == 0


EXTRA = ["n_chars", "row", "Key", "lead", "cell", "depth", "fits", "ordinal", "times", "copy", "leaked", "quality_path", "evidence_quality", "site_host", "h9", "words", "component_id", "size"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    ids = [r[0] for r in corpus.rows() if r[0] is not None]
    spark.createDataFrame([(i, int(i % 9 != 1), 0) for i in ids[::2]] + [(None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, corpus.rows()[4][1] or "none"), (2, " ".join(f"leak{i}" for i in range(30))), (3, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def _stage_rows(spark):
    """Null ids of clean, copied and leaked texts, one id with two texts, repeated rows, and columns of clashing names."""
    leak = " ".join(f"leak{i}" for i in range(30))
    other = [f"other{i}" for i in range(40)]
    rows = [tuple(r[:4]) for r in corpus.rows()]
    rows += [(None, leak, "s1", "en"), (None, " ".join(other), "s1", "en"), (None, " ".join(other[:39]), "s1", "en"), (900, leak + " x", "s1", "en")]
    rows += [(901, " ".join(f"p{i}" for i in range(30)), None, None), (901, " ".join(f"q{i}" for i in range(30)), None, None), (902, "Same row", "s2", "en"), (902, "Same row", "s2", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    for i, c in enumerate(EXTRA):
        df = df.withColumn(c, F.lit(i))
    return df, rows


def test_every_stage_takes_hard_rows(spark, folder):
    import corpus_pipeline

    df, rows = _stage_rows(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, folder)
        assert out.columns[: len(df.columns)] == df.columns and (k == 4 or out.columns == df.columns)
        assert {tuple(r[c] for c in EXTRA) for r in out.collect()} == {tuple(range(len(EXTRA)))}
        none = stage(spark, df.limit(0), folder)
        assert none.count() == 0 and none.columns == out.columns
    assert sorted(map(str, corpus_pipeline.shard(spark, df, folder).select("doc_id", "text").collect())) == sorted(map(str, df.select("doc_id", "text").collect()))


def test_near_duplicates_keep_one_row_of_each_group(spark, folder):
    import corpus_pipeline

    df, rows = _stage_rows(spark)
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, df, folder).select("doc_id", "text").collect()]
    sets = []
    for r in rows:
        w = corpus.words(r[1])
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for g, r in zip(group, rows):
        best[g] = min(best.get(g, (True, float("inf"))), (r[0] is None, r[0] if r[0] is not None else 0))
    assert sorted(str(None if n else i) for n, i in best.values()) == sorted(str(r[0]) for r in got)
    assert sorted(str(r) for r in got if r[0] == 901) == sorted(str(tuple(r[:2])) for r in rows if r[0] == 901)


def test_decontamination_drops_leaked_rows_alone(spark, folder):
    import corpus_pipeline

    df, rows = _stage_rows(spark)
    got = sorted(str(tuple(r)) for r in corpus_pipeline.decontamination(spark, df, folder).select("doc_id", "text").collect())
    item = corpus.rows()[4][1]
    want = sorted(str(tuple(r[:2])) for r in rows if not (r[1] or "").startswith("leak0") and r[1] != item)
    assert got == want and sum(r.startswith("(None") for r in got) == sum(r[0] is None for r in rows) - 1


def test_classifier_without_toxic_labels_keeps_new_sites(spark):
    ids = list(range(60))
    text = lambda i: ("good plain words here " if i % 2 else "buy buy now !!! ") * 6
    docs = spark.createDataFrame([(i, text(i), "s0", "en") for i in ids] + [(100, None, "new", "fr"), (101, "", None, None)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in ids] + [(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_documents(docs, labels).collect()}
    assert got[100].p_toxic < 0.01 and got[101].p_toxic < 0.01
    assert all(got[i].kept == bool(i % 2) for i in ids)


def test_site_rates_equal_the_formula(spark):
    r = random.Random(4)
    rows = [(r.choice("abc"), r.choice(["x", "y", None]), r.choice([0, 1, 1, None]), r.choice([0, 0, 1])) for _ in range(300)] + [(None, None, 1, 0), ("lone", "x", None, 0)]
    table, prior = quality.site_rates(spark.createDataFrame(rows, "host string, path string, quality int, toxic int"))
    got = {(t.host, t.path): t for t in table.collect()}
    for at, name in ((2, "quality"), (3, "toxic")):
        def rates(groups, base):
            n = {g: sum(1 for x in rows if groups(x) == g and x[at] is not None) for g in map(groups, rows)}
            k = {g: sum(x[at] for x in rows if groups(x) == g and x[at] is not None) for g in n}
            total = sum(n.values())
            spread = sum(n[g] * (k[g] / n[g] - base(g)) ** 2 for g in n if n[g]) / total
            between = spread - sum(base(g) * (1 - base(g)) for g in n if n[g]) / total
            s = min(max(sum(n[g] * base(g) * (1 - base(g)) for g in n) / total / between - 1, 1.0), 1e6) if between > 1e-12 else 1e6
            return {g: (k[g] + s * base(g)) / (n[g] + s) for g in n}

        known = [x[at] for x in rows if x[at] is not None]
        p = sum(known) / len(known)
        hosts = rates(lambda x: x[0], lambda g: p)
        paths = rates(lambda x: (x[0], x[1]), lambda g: hosts[g[0]])
        assert abs(prior[name] - p) < 1e-12 and set(got) == set(paths)
        for g, v in paths.items():
            assert abs(got[g][f"{name}_path"] - v) < 1e-9 and abs(got[g][f"{name}_host"] - hosts[g[0]]) < 1e-9


def test_verbatim_items_in_tiny_corpora(spark):
    items = [(1, "what is the capital of the small country by the sea"), (2, " ".join(f"w{i}" for i in range(200)))]
    docs = spark.createDataFrame([(1, items[0][1]), (2, "nothing of note stands here"), (3, "before " + items[1][1] + " after " + items[0][1])], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [got[i].item_ids for i in (1, 2, 3)] == [[1], [], [1, 2]]


def test_unbroken_head_of_an_item_counts_without_its_answer(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    item = [word() for _ in range(60)]
    rest = [word() for _ in range(80)]
    broken = [x for k, w in enumerate(item[:44]) for x in ([w, "zz"] if k % 3 == 0 else [w])]
    rows = [(1, " ".join(rest + item[:44] + rest)), (2, " ".join(rest + broken + rest)), (3, " ".join(rest + item[:30] + rest)), (1, " ".join(item)), (1, " ".join(rest))]
    bench = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, " ".join(item))], "item_id long, text string")
    got = sorted((q.doc_id, q.contaminated, q.item_id if q.contaminated else None, tuple(q.item_ids)) for q in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect())
    assert got == sorted([(1, True, 7, (7, 8)), (1, True, 7, (7, 8)), (1, False, None, ()), (2, False, None, ()), (3, False, None, ())], key=lambda x: (x[0], x[1]))


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k == 0:
            scored = quality.score_documents(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            assert out.count() == scored.where("kept").count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        docs = durable.durable(out, "test-stage")
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] > 0 and sizes[3] == sizes[4]
