import random

import numpy as np

from estante.llm import encoding, markup, scanned
from estante.llm.boosting import BoostedTrees
from estante.llm.perceptron import Averaged, Editor, edit

CLEAN = ["ação necessária às três", "ATÉ QUE A AÇÃO", "não há limite", "São Luís; «aspas» – traço, 7º dia"]


def test_encodings_round_trip():
    for text in CLEAN[:3]:
        for wrong in ("cp1252", "mac_roman", "cp437"):
            try:
                bad = text.encode().decode(wrong)
            except UnicodeDecodeError:
                continue
            assert encoding.repair(bad)[0] == text
            assert encoding.repair("Início são: " + bad)[0] == "Início são: " + text
    twice = "ação".encode().decode("cp1252").encode().decode("cp1252")
    assert encoding.repair(twice)[::2] == ("ação", 2)
    assert encoding.repair("ação necessária".encode("cp1252").decode("mac_roman"))[0] == "ação necessária"


def test_right_text_is_left_alone():
    for text in [*CLEAN, "Ωμέγα", "«Врата»", "¿Y después?", "Preço: £ 5 ou € 4?", "Ver § 3, nota ª.", "7°", "ÇÃO", "AÇÕES", ""]:
        assert encoding.repair(text) == (text, 0, 0)


def test_garbled_fields(spark):
    rows = [(1, "aÃ§Ã£o", "certo", "x"), (1, "aÃ§Ã£o", "certo", "x"), (2, None, "n�o", "x"), (3, "", "ação", "x"), (4, "longa " * 20000 + "nÃ£o", None, "x")]
    df = spark.createDataFrame(rows, "line_no bigint, pergunta string, resposta_referencia string, campo string")
    assert sorted(map(tuple, encoding.garbled_found(df).collect())) == [(1, "pergunta"), (2, "resposta_referencia"), (4, "pergunta")]
    got = {(r.line_no, r.campo): r.restored for r in encoding.garbled(df).collect()}
    assert got[1, "pergunta"] == "ação" and got[2, "resposta_referencia"] is None
    assert encoding.garbled_found(df.limit(0)).count() == 0


def test_letters_lost_to_question_marks(spark):
    lost = ["Em qual p??gina est?? a descri????o", "N??o existe nos c??dices", "?? poss??vel", "PS??QUICO", "a p?gina", "no m??s, j??; fim", "??ncora", "Você n??o leu??", "aÃ§Ã£o n??o"]
    clean = ["Você leu??", "Você leu?? Sim.", "Quem? Onde?! Por quê???", "http://x.y/z?id=1", "(?)", "Leu ?? Sim", "leu???...", "?"]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(lost + clean)], "line_no bigint, pergunta string, resposta_referencia string")
    got = {r.line_no: r.restored for r in encoding.garbled(df).collect()}
    assert got == {i: None for i in range(len(lost))}
    assert all(encoding.cost(t) > 0 for t in lost) and not any(encoding.cost(t) for t in clean)


def test_perceptron_and_editor_on_held_out_words():
    assert edit("cscada", "escada") == (0, "c", "e") and edit("tumo", "turno") == (2, "m", "rn") and edit("abc", "xyz") is None
    rng = random.Random(1)
    words = ["".join(rng.choice("bdlmprt") + rng.choice("aeiou") for _ in range(4)) for _ in range(400)]
    noisy = [(w.replace("d", "cl", 1), w) for w in words if "d" in w] + [(w.replace("a", "@", 1), w) for w in words if "a" in w]
    rng.shuffle(noisy)
    cut = len(noisy) // 2
    model = Editor().train(noisy[:cut], words)
    assert model.operations == {"@": ["a"], "cl": ["d"]}
    right = sum(v in dict(model.proposals(u)) for u, v in noisy[cut:])
    assert right >= 0.95 * (len(noisy) - cut)
    a = Averaged().train([(["x"], "p"), (["y"], "q")] * 5)
    assert a.predict(["x"]) == "p" and a.predict(["y"]) == "q" and Editor().train([], []).proposals("abc") == []


PROSE = "o guarda atravessa a ponte de pedra enquanto a sentinela vigia o mercado coberto durante a noite"


def scanned_tables(spark, noisy_blocks, noisy_chunks=()):
    plain = [("p", i, "paragraph", 1, None, PROSE + ". " + PROSE.replace("guarda", "escudeiro") + ", mata-borrão.") for i in range(60)]
    b = spark.createDataFrame(plain + noisy_blocks, "doc_id string, block_idx int, kind string, page int, lines array<string>, text string")
    c = spark.createDataFrame(list(noisy_chunks), "chunk_id string, text string, page_start int, extra string")
    books = spark.createDataFrame([("vau", "Crônicas do Vau, tomo II"), ("x", None)], "book string, titulo string")
    return b, c, books


def test_lines_below_a_broken_compound_join_nothing(spark):
    text = "com guarda-\nchuva azul o guarda\nchaves vermelho\nsozinho a mata-\nPág. 8\nborrão"
    b, c, books = scanned_tables(spark, [("d", 0, "paragraph", 7, None, text), ("d", 1, "paragraph", 7, None, "o guar-\n— 7 —\nPág. 8\nda vigia"), ("d", 2, "paragraph", 7, None, "guarda-chuva, guarda-chuva, chuva chaves"), ("d", 3, "paragraph", 7, None, "um xe-\nbrete novo")])
    got = {tuple(r)[1:] for r in scanned.noise_found(b, c, books).collect() if r.ruido == "hifen"}
    assert got == {("d#1", "hifen")}  # "xebrete" stands nowhere unbroken
    halves = {(r.a, r.b) for r in scanned.hyphen_breaks(scanned.page_rows(scanned.texts(b, c)), spark.createDataFrame([], "tabela string, chave string, i int")).collect()}
    assert halves == {("guarda", "chuva"), ("mata", "pág"), ("guar", "7"), ("xe", "brete")}


def test_the_editor_joins_lines_and_closes_blanks_by_what_it_learnt():
    rng = random.Random(2)
    words = {"".join(rng.choice("bdlmprt") + rng.choice("aeiou") for _ in range(4)): rng.randint(2, 900) for _ in range(300)}
    words |= {f"{a}-{b}": rng.randint(5, 500) for a, b in zip(list(words)[:30], list(words)[30:60])}
    editor = Editor().train([], [w for w in words if "-" not in w], scanned.broken_words(words, rng), [list(words)[i : i + 2] for i in range(200, 290)])
    assert editor.joins("bala", "made", 40, 0) and not editor.joins("bala", "made", 0, 40)
    assert editor.joins("bala", "made", 400, 2) and not editor.joins("bala", "made", 2, 400)
    assert sum(editor.closing("balamade")) > 0


def test_noise_of_scanned_pages(spark):
    rows = [
        ("d", 0, "paragraph", 7, None, "o guarda atra-\nvessa a ponte"), ("d", 1, "paragraph", 7, None, "com mata-\nborrão a senti­\nnela"),
        ("d", 2, "paragraph", 7, None, "o guarda na ponte\nCRÔNICAS DO VAU, TOMO II 8\nde pedra"), ("d", 3, "paragraph", 7, None, "a p o n t e de pedra"), ("d", 4, "paragraph", 7, None, "com mata-\nborrão"),
        ("d", 5, "paragraph", 7, None, "NOME EM CAPITAIS\n2d6 + 3"), ("d", 5, "paragraph", 7, None, "NOME EM CAPITAIS\n2d6 + 3"), ("d", 6, "table", 7, None, "a-\nb"), ("d", 7, "paragraph", None, None, ""), ("d", 8, "paragraph", 7, None, "o mer¬\nPág. 9\ncado coberto"),
    ]
    ocr = [("c%d" % i, f"a {w} vigia", None, "x") for i, w in enumerate(["p0nte", "mercad0", "c0berto", "guard@", "pedr@", "@travessa"])]
    b, c, books = scanned_tables(spark, rows, [*ocr, ("n", None, None, "x")])
    got = {tuple(r) for r in scanned.noise_found(b, c, books).collect()}
    want = {("blocos", "d#0", "hifen"), ("blocos", "d#1", "hifen"), ("blocos", "d#2", "mobilia"), ("blocos", "d#3", "ocr"), ("blocos", "d#8", "hifen"), ("blocos", "d#8", "mobilia")}
    assert {g for g in got if g[0] == "blocos"} == want
    assert {g[1] for g in got if g[0] == "chunks"} >= {"c0", "c1", "c2"}
    fixed = {r.chave: r.texto for r in scanned.repaired(b, c, books).collect()}
    assert fixed["d#0"] == "o guarda atravessa a ponte" and fixed["d#8"] == "o mercado coberto" and fixed["d#1"] == "com mata-borrão a sentinela" and fixed["d#3"] == "a ponte de pedra"
    assert "CRÔNICAS" not in fixed["d#2"] and fixed["c0"] == "a ponte vigia"


def test_letters_apart_beside_other_words(spark):
    known = {"guarda": 60, "atravessa": 60, "vigia": 60, "senha": 1, "do": 9, "sol": 9, "lar": 2}
    for letters, words in {"eaguarda": ["guarda"], "guardaatravessaa": ["guarda", "atravessa"], "asenhao": ["senha"], "dosol": ["do", "sol"], "sguardas": ["guarda"], "aoe": [], "abcd": [], "olar": [], "xsol": [], "": []}.items():
        assert scanned.segment(letters, known) == words
    texts = ["se a g u a r d a e a noite", "p o n t e p e d r a", "o m e r c a d o a gu@rda", "fica e a p o n\n— 7 —\nt e coberta", "s e n t i n e l a e o", "a e o"]
    rows = [("d", i, "paragraph", 7, None, t) for i, t in enumerate(texts)]
    b, c, books = scanned_tables(spark, rows)
    got = {r.chave for r in scanned.noise_found(b, c, books).collect() if r.ruido == "ocr"}
    assert got >= {f"d#{i}" for i in range(5)} and "d#5" not in got
    fixed = {r.chave: r.texto for r in scanned.repaired(b, c, books).collect()}
    assert fixed["d#1"] == "ponte pedra" and fixed["d#4"] == "sentinela e o" and "ponte" in fixed["d#3"]


def test_misread_words_that_mostly_stand_capitalised(spark):
    plain = {"ponte": 600, "mercado": 600, "coberto": 600, "torneio": 600, "p0nte": 1, "mercad0": 1, "c0berto": 1, "t0rneio": 1}
    rows = [(w, n, n) for w, n in plain.items()] + [("tempo", 2700, 450), ("temp0", 3, 3), ("vellio", 2700, 4), ("velli0", 3, 3)]
    got = {r.form: r.repaired for r in scanned.misread(spark.createDataFrame(rows, "form string, n bigint, low bigint")).collect()}
    assert got == {"p0nte": "ponte", "mercad0": "mercado", "c0berto": "coberto", "t0rneio": "torneio", "temp0": "tempo"}


def test_scanned_of_nothing(spark):
    b, c, books = scanned_tables(spark, [], [])
    assert scanned.noise_found(b.limit(0), c, books).count() == 0


def test_boosting_separates_held_out_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = BoostedTrees().fit(x[:1000], y[:1000])
    assert (((m.log_odds(x[1000:]) > 0) == y[1000:]).mean()) > 0.95


MARKED = {
    "a": ("<p>Um <b>texto</b>&nbsp;com</p>", {"html"}), "b": ("# TÍTULO\n\n- um item\n- outro item", {"markdown"}), "c": ("== NOME ==\n[[Categoria:Regras]]", {"wiki"}),
    "d": ("\\section{Nome}\n\\[ x = \\frac{a}{b} \\]", {"latex"}), "e": ("Brasa & Cinza, CA<14 e CA>9, item #12, Força 9*, R$ 5 em ouro e R$ 7 [3].", set()),
    "f": ("<table><tr><td>**3d8**</td><td>um</td></tr><tr><td", {"html", "markdown"}), "g": ("texto simples sem nada", set()), "h": (None, set()), "i": ("", set()), "j": ("palavra " * 30000 + "<b>fim</b>", {"html"}),
}


def marked(spark):
    plain = [(f"p{i}", f"{PROSE} e a {w} recolhe um livro de contas.\nDurante o eclipse, {PROSE}.", "x") for i, w in enumerate(["criatura", "vidreira", "domadora", "capitã", "armeira"] * 20)]
    c = spark.createDataFrame(plain + [(k, t, "x") for k, (t, _) in MARKED.items()] + [("a", MARKED["a"][0], "x")], "chunk_id string, text string, marcacao string")
    b = spark.createDataFrame([("d", 0, "table", "{| class=wikitable\n! a !! b\n|-\n| 1 || 2\n|}"), ("d", 1, "paragraph", "<b>x</b>"), ("d", 2, "table", "a\tb\n1\t2")], "doc_id string, block_idx int, kind string, text string")
    return c, b


def test_markup_found_and_cleaned(spark):
    c, b = marked(spark)
    got = {}
    for r in markup.markup_found(c, b).collect():
        got.setdefault(r.chave, set()).add(r.marcacao)
    assert got.pop("d#0") == {"wiki"} and got == {k: n for k, (_, n) in MARKED.items() if n}
    text = {r.chave: r.limpo for r in markup.cleaned(c, b).collect()}
    assert text["a"] == "Um texto com" and text["b"] == MARKED["b"][0] and text["c"].startswith("# NOME") and text["d"].startswith("# Nome") and "\\frac{a}{b}" in text["d"]
    assert text["e"] == MARKED["e"][0] and text["h"] is None and text["d#2"] == "a\tb\n1\t2" and "3d8 | um" in text["f"]
    assert markup.markup_found(c.limit(0), b.limit(0)).count() == 0


def test_ancestors_and_descendants_never_contradict():
    text = "<!-- **forte** --> e `<b>x</b>`"
    found = markup.nodes(text)
    parent, _ = markup.tree(text, found)
    kinds = [markup.KINDS[k] for _, _, k in found]
    yes = markup.decode(found, parent, np.ones(len(found)) * 2)
    assert yes[kinds.index("html.comment")] and not yes[kinds.index("markdown.strong")]
    accepted = {k for k, y in zip(kinds, yes) if y}
    assert ("markdown.code" in accepted) != ("html.tag" in accepted)
