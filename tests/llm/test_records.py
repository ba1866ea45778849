import re

import numpy as np

from estante.llm import neardup, ranking, vectors

WORD = re.compile(r"[^\W_]+")


def brute(rows, threshold, width):
    sets = {}
    for key, name, text in rows:
        w = WORD.findall(f"{name or ''} {text or ''}".lower())
        s = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
        if s:
            sets[key] = s
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for g in range(60):
        base = list(rng.choice(words, rng.integers(3, 160)))
        for k in range(rng.integers(1, 6)):
            t = list(base)
            for _ in range(rng.integers(0, 1 + len(t) // 8)):
                i = int(rng.integers(len(t)))
                t[i : i + 1] = [] if rng.random() < 0.4 else [str(rng.choice(words))]
            rows.append((f"k{g:02d}-{k}", None if k % 2 else "Nome", " ".join(t)))
    rows += [("n1", None, None), ("n2", "", "um dois"), ("same1", "x", "a b c d"), ("same2", "x", "a b c d"), ("same2", "x", "a b c d"), ("long", None, " ".join(words * 300))]
    df = spark.createDataFrame([(*r, "e") for r in rows], "chunk_id string, entity_name string, text string, grams string")
    got = [tuple(r) for r in neardup.near_duplicate_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.6, 3) and ("same1", "same2") in got
    assert neardup.near_duplicate_pairs(df.limit(0)).count() == 0


def test_extended_prefixes_always_meet():
    """Every two sets at the threshold share a signature, whatever the classes of their members."""
    rng = np.random.default_rng(0)
    counts = rng.choice([1, 5, 100, 5000], 4000)
    for _ in range(300):
        n = int(rng.integers(2, 90))
        x = rng.choice(4000, n, replace=False)
        y = x.copy()
        out = int(rng.integers(0, max(1, n // 4)))
        y[:out] = rng.choice(np.setdiff1d(np.arange(4000), x), out, replace=False)
        both = len(np.intersect1d(x, y))
        if both >= 0.6 * (2 * n - both):
            cx, cy = np.maximum(counts[x], 1 + np.isin(x, y)), np.maximum(counts[y], 1 + np.isin(y, x))
            shared = {int(t): max(2, int(counts[t])) for t in np.intersect1d(x, y)}
            cx, cy = np.array([shared.get(int(t), 1) for t in x]), np.array([shared.get(int(t), 1) for t in y])
            h = lambda v: v.astype(np.int64) * 0x9E3779B97F4A7
            assert set(neardup.signatures(h(x), cx, 0.6)) & set(neardup.signatures(h(y), cy, 0.6))


def test_one_hot_copy_group_and_five_word_default(spark):
    rows = [(f"c{i:03d}", "um dois três quatro cinco seis sete") for i in range(40)] + [("z", "um dois três quatro cinco seis oito"), ("y", "nada a ver com os outros aqui")]
    df = spark.createDataFrame(rows, "id string, text string")
    members, similar = neardup.near_duplicates(df, "id", df["text"])
    assert members.count() == 42 and members.select("sid").distinct().count() == 3 and similar.count() == 0


def vec_rows(rng, n):
    centres = rng.normal(size=(12, 64))
    x = centres[rng.integers(12, size=n)] + 0.3 * rng.normal(size=(n, 64))
    return [(f"v{i:04d}", [float(f) for f in v], "codex-vetor-2") for i, v in enumerate(x.astype(np.float32))]


def test_neighbours_reach_recall_and_keep_copies(spark):
    rng = np.random.default_rng(1)
    rows = vec_rows(rng, 1500)
    same = [(f"copy{i:03d}", rows[0][1], "codex-vetor-2") for i in range(30)]
    bad = [("null", None, "codex-vetor-2"), ("zero", [0.0] * 64, "codex-vetor-2"), ("short", [1.0] * 63, "codex-vetor-2"), ("old", rows[1][1], "codex-vetor-1"), ("nan", [float("nan")] * 64, "codex-vetor-2")]
    df = spark.createDataFrame([(*r, "e") for r in rows + same + bad + rows[:50]], "chunk_id string, vector array<float>, model string, ids string")
    got = {}
    for r in vectors.neighbours(df).collect():
        got.setdefault(r.chunk_id, []).append(r.neighbour)
    keep = rows + same
    ids = [r[0] for r in keep]
    x = np.array([r[1] for r in keep])
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -9)
    truth = {ids[i]: {ids[j] for j in np.argsort(-s[i], kind="stable")[:5]} for i in range(len(ids))}
    assert got.keys() == set(ids) and all(len(v) == 5 == len(set(v)) and k not in v for k, v in got.items())
    plain = [k for k in ids[1:1500]]
    assert np.mean([len(truth[k] & set(got[k])) / 5 for k in plain]) >= 0.9
    assert all(got[f"copy{i:03d}"] == [c for c in ("copy000", "copy001", "copy002", "copy003", "copy004", "copy005") if c != f"copy{i:03d}"][:5] for i in range(30))
    pairs = [tuple(r) for r in vectors.neighbours_found(df).collect()]
    assert all(a < b for a, b in pairs) and len(pairs) == len(set(pairs))


def test_hot_vectors_are_salted(spark):
    df = spark.createDataFrame([(f"h{i:04d}", [1.0] + [0.0] * 63, "codex-vetor-2") for i in range(500)] + [("o", [0.0, 1.0] + [0.0] * 62, "codex-vetor-2")], "chunk_id string, vector array<float>, model string")
    per_class, beyond = vectors.classes(vectors.current(df), 5, hot=100)
    assert sorted(len(r.ids) for r in per_class.collect()) == [1, 6] and beyond.select("chunk_id").distinct().count() >= 494
    assert vectors.neighbours(df.limit(0)).count() == 0 and vectors.neighbours(df.where("chunk_id = 'o'")).count() == 0


HITS = "query_id string, strategy string, chunk_id string, score double, rank int, contributions string"


def hits(spark, rows):
    return spark.createDataFrame([(*r, "e") for r in rows], HITS)


def test_heads_beyond_dispute(spark):
    lists = ("cosseno", "bm25", "reordenador")
    rows = []
    for q, places in {"a": (1, 1, 2), "b": (1, 1, 3), "c": (1, 2, 2), "d": (1, 1, 1)}.items():
        for s, p in zip(lists, places):
            for k in range(1, 7):
                chunk = "head" if k == p else f"o{k}{s[0]}" if k > 3 else f"o{k}"
                rows.append((q, s, chunk, None if q == "d" else 1e9 if (s, k) == ("bm25", 4) else -float(k), k))
    rows += [("e", "cosseno", "head", 1.0, 1), ("e", "bm25", "head", 1.0, 1), ("f", "rrf", "head", 1.0, 1)] + rows[:6] + [(None, "bm25", "x", 1.0, 1)]
    assert sorted(map(tuple, ranking.head_found(hits(spark, rows)).collect())) == [("a", "head"), ("d", "head")]
    r = ranking.one_ranking(hits(spark, rows)).collect()
    assert {x.query_id: x.chunk_id for x in r if x.position == 1}["a"] == "head"
    assert ranking.head_found(hits(spark, [])).count() == 0


def test_loadings_follow_the_declared_direction(spark):
    rng = np.random.default_rng(2)
    rows = []
    for q in range(40):
        true = rng.permutation(10)
        for s, noise in (("cosseno", 0.5), ("bm25", 1.0), ("reordenador", 30.0)):
            order = np.argsort(true + noise * rng.normal(size=10))
            rows += [(str(q), s, f"c{c}", float(-k) * 10**q, k + 1) for k, c in enumerate(order)]
    w = ranking.loadings(ranking.placed(hits(spark, rows)))
    assert all(x >= 0 for x in w) and abs(sum(w) - 1) < 1e-9 and w[0] > w[2] and w[1] > w[2]
