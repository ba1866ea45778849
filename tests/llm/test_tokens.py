import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from estante.llm import tokens as T

pytest.importorskip("tiktoken")
if not __import__("os").path.exists(f"{T.FOLDER}/{T.VOCABULARY}.tiktoken"):
    pytest.skip("no vocabulary files", allow_module_level=True)

SCHEMA = "doc_id bigint, text string, ids string, n_tokens int"
TEXTS = [None, "", "  ", "Olá, mundo! <|endoftext|>", "a", "palavra " * 3000, "x" * 6000, "日本語 🙂\r\n\r\nfim"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "extra", 1) for i, t in enumerate(texts)], SCHEMA)


def test_ids_equal_the_other_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{T.FOLDER}/{T.VOCABULARY}.json")
    t.encode_special_tokens = True
    got = {r.doc_id: r.ids for r in T.token_ids(docs(spark)).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == (t.encode(text, add_special_tokens=False).ids if text else [])
        assert T.decode(got[i]) == (text or "").encode()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1 \n\t'séç.,|<>", max_size=400))
def test_safe_parts_do_not_change_ids(text):
    parts = T.safe_parts(text, long=20, part=7)
    assert "".join(parts) == text
    e = T.encoding()
    assert [i for p in parts for i in e.encode_ordinary(p)] == e.encode_ordinary(text)


def test_containers_hold_every_token_once(spark):
    rng = np.random.default_rng(0)
    texts = TEXTS + ["palavra " * int(n) for n in rng.integers(1, 900, 300)] + ["igual"] * 20
    rows = T.fill_containers(docs(spark, texts), shard=120).collect()
    assert T.fill_containers(docs(spark, []), shard=120).count() == 0
    sizes = {i: len(T.encode(t)) for i, t in enumerate(texts)}
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
        by_bin.setdefault(r.container, []).append(r.n_tokens)
    assert by_doc.keys() == {i for i, n in sizes.items() if n}
    for i, parts in by_doc.items():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at == sizes[i] and (len(parts) == 1 or sizes[i] > T.CAPACITY)
    assert max(map(sum, by_bin.values())) <= T.CAPACITY and max(map(len, by_bin.values())) <= T.MOST_DOCUMENTS
    least = math.ceil(sum(sizes.values()) / T.CAPACITY)
    assert len(by_bin) <= least + 2 * math.ceil(len(rows) / 120) + 2


def test_best_fit_keeps_every_constraint():
    sizes = np.array([1000] * 5 + [10] * 50 + [2048])
    where = T.best_fit(sizes, 2048, most=4, attention=2.0 * 1024**2)
    for b in set(where):
        s = sizes[where == b]
        alone = len(s) == 1
        assert s.sum() <= 2048 and len(s) <= 4 and ((s**2).sum() <= 2.0 * 1024**2 or alone)
    assert len(T.best_fit(np.array([], dtype=int))) == 0


def test_pieces_overlap_and_rebuild(spark):
    prose = "\n\n".join(f"# TÍTULO {k}\nUma frase curta aqui. " + "Outra frase um pouco maior, com vírgula; e fim. " * (k % 9 + 1) for k in range(60))
    texts = [*TEXTS, prose, "🙂" * 900, "palavra " * 512, "palavra " * 511]
    rows = T.split_oversized(docs(spark, texts)).collect()
    found = {r.doc_id for r in T.oversized_found(docs(spark, texts)).collect()}
    assert found == {i for i, t in enumerate(texts) if len(T.encode(t)) > 512} and T.split_oversized(docs(spark, [])).count() == 0
    for i in found:
        ids = T.encode(texts[i])
        ps = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert ps[0].first_token == 0 and ps[-1].first_token + ps[-1].n_tokens == len(ids)
        assert all(p.n_tokens <= 512 for p in ps)
        assert all(b.first_token == a.first_token + a.n_tokens - 64 for a, b in zip(ps, ps[1:]))
        assert all(p.text.encode() == T.decode(ids[p.first_token : p.first_token + p.n_tokens]) for p in ps if "�" not in p.text)
    ends = [r.ends_at for r in rows if r.doc_id == len(TEXTS) and r.ends_at != "end"]
    assert ends and set(ends) <= {"heading", "paragraph", "line", "sentence"}


def test_cuts_are_the_cheapest():
    """Against every choice of boundaries, by brute force."""
    from itertools import combinations

    where, kinds = np.array([30, 44, 60, 75, 90, 110]), ["word", "sentence", "paragraph", "word", "sentence", "token"]
    n, limit, overlap = 130, 50, 10
    got = T.cut_positions(n, where, kinds, limit, overlap)
    number = max(1, -(-(n - overlap) // (limit - overlap)))
    ideal = (n - overlap) / number + overlap

    def price(ends):
        total, start = 0.0, 0
        for e in ends:
            size = e - start
            if size > limit or e <= overlap:
                return math.inf
            total += (0 if e == n else T.PENALTY[kinds[list(where).index(e)]]) + T.PER_PIECE + T.IMBALANCE * ((size - ideal) / limit) ** 2
            start = e - overlap
        return total

    best = min(price([*c, n]) for k in range(7) for c in combinations(where.tolist(), k))
    assert math.isclose(price([e for _, e, _ in got]), best)
