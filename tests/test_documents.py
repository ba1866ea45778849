from pyspark.sql import functions as F

from estante.functions import text as T
from estante.operators import chunking, preprocess
from estante.operators.chunking import CREATURE, ITEM, SPELL, Block, pack, segment, tokens_of

MARKDOWN = "\n".join([
    '<!-- PageHeader="Um livro" -->', "Primeira linha <b>forte</b>", "segunda linha", "", '<!-- PageNumber="4" -->', "<!-- PageBreak -->",
    '<!-- PageHeader="Um cabeçalho longo" -->', "Antes <table", "<table>", '<tr><td><b>x</b></td></tr> <!-- PageNumber="9" -->', "</table> depois", "<figure>", "some", "</figure>",
    "<figure>fica</figure>", "<!-- PageBreak -->", "fim", "<table>", "sem fim",
])


def test_blocks_of_page_marked_markdown():
    got = preprocess.parse(MARKDOWN)
    assert got == [
        ("paragraph", 4, ["Primeira linha forte", "segunda linha"], "Primeira linha forte\nsegunda linha"),
        ("paragraph", 9, ["Um cabeçalho longo", "Antes <table"], "Um cabeçalho longo\nAntes <table"),
        ("table", 9, [], "<table>\n<tr><td><b>x</b></td></tr>\n</table> depois"),
        ("paragraph", 9, ["fica"], "fica"),
        ("paragraph", 10, ["fim"], "fim"),
        ("table", 10, [], "<table>\nsem fim"),
    ]


def test_pages_by_window_equal_pages_in_memory(spark):
    docs = {"a": MARKDOWN, "b": "x\n<!-- PageBreak -->\ny", "c": "", "d": "x\r\n<!-- PageNumber=\"2\" -->\r<!-- PageBreak -->\ny\n<!-- PageBreak -->\nz"}
    lines = preprocess.line_slice(spark.createDataFrame(list(docs.items()), "doc_id string, text string"), "text", 1)
    got = {}
    for r in preprocess.page_of_lines(lines).collect():
        got.setdefault(r.doc_id, {})[r.line_no] = r.page
    for k, t in docs.items():
        split = t.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        assert [got[k][i + 1] for i in range(len(split))] == preprocess.pages(split)


def test_blocks_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", " \n ")], "doc_id string, text string")
    assert preprocess.blocks(df).count() == 0


def test_clean_line_equals_memory(spark):
    lines = MARKDOWN.split("\n")
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    assert [r.c for r in df.orderBy("i").select(preprocess.clean_line(F.col("line")).alias("c")).collect()] == [preprocess.cleaned(x) for x in lines]


def test_chunk_id_is_a_mixed_endian_guid(spark):
    import hashlib
    import uuid

    book, text = "vau", "ação\nlinha"
    want = str(uuid.UUID(bytes_le=hashlib.sha256(f"{book}\n{text}".encode()).digest()[:16]))
    assert spark.range(1).select(T.chunk_id(F.lit(book), F.lit(text))).first()[0] == want


def test_names_in_columns_equal_names_in_memory(spark):
    lines = ["## FOGO-FÁTUO DA NÉVOA E DO SAL", "MíMICO", "Nome Comum", "AÇÕES", "### AÇÕES LENDÁRIAS", "## Variante: X", "# OROG", "  ", "DE", "GUIA DO MESTRE.", "RÓTULO SOLTO AQUI", "Ab CD EF", "A 1 B"]
    df = spark.createDataFrame([(x,) for x in lines], "s string")
    c = F.col("s")
    for r in df.select("s", T.is_caps_name(c).alias("caps"), T.is_boundary_heading(c).alias("b"), T.title_case(T.clean_name(c)).alias("t"), T.is_loose_label(c).alias("l")).collect():
        assert (r.caps, r.b, r.t, r.l) == (chunking.caps_name(r.s), chunking.boundary_heading(r.s), chunking.titled(chunking.clean_name(r.s)), chunking.loose_label(r.s))
    assert chunking.titled("FOGO-FÁTUO DA NÉVOA") == "Fogo-Fátuo da Névoa"


def test_pack_keeps_budget_and_order():
    lines = [(f"palavra{i} " * (5 + i % 40), i // 10) for i in range(200)] + [("x" * 9000, 21)]
    pieces = pack(lines, 100, 16)
    assert all(tokens_of(t) <= 100 for t, *_ in pieces)
    words = [w for t, _ in lines for w in t.split()]
    at = 0
    for t, *_ in pieces:  # every word is covered, in order
        for w in t.split():
            if at < len(words) and w == words[at]:
                at += 1
    assert at >= len(words) - 1
    assert pack([], 100, 16) == []


def para(*lines, page=None):
    return Block("paragraph", page, list(lines), "\n".join(lines))


STATS = ("Classe de Armadura 15 (escudo)", "Pontos de Vida 22 (4d8 + 4)")


def test_creatures_by_every_header():
    blocks = [
        para("texto de abertura", page=1),
        para("URSO DO SAL", "Besta Média, neutro", page=2), para(*STATS, page=2),
        para("Ele ruge.", page=2),
        para("## AÇÕES", "Ataque.", page=3),
        para("BANSHEE", page=3), para("Morto-vivo Médio, caótico e mau", page=3), para(*STATS, page=4),
        para("## BRUXA DO MAR Fada Média, caótico e mau", page=5), para(STATS[0], page=5), para(STATS[1], page=5),
    ]
    got = [(name, fallback, a, b) for _, name, a, b, _, fallback in segment(blocks, CREATURE)]
    assert got == [(None, True, 1, 1), ("Urso do Sal", False, 2, 3), ("Banshee", False, 3, 4), ("Bruxa do Mar", False, 5, 5)]


def test_spells_and_items_in_their_sections():
    blocks = [para("antes"), para("# DESCRIÇÕES DAS MAGIAS"), para("RAIO AZUL", "Truque de evocação", "Tempo de Conjuração: 1 ação"), para("VÉU"), para("3º nível de ilusão (ritual)", "Tempo de Conjuração: 1 hora"), para("# APÊNDICE"), para("fim")]
    got = segment(blocks, SPELL)
    assert [(r[1], r[5]) for r in got] == [(None, True), ("Raio Azul", False), ("Véu", False), (None, True)]
    items = [para("ANEL DE CINZA", "Anel, raro (requer sintonização)"), para("texto"), para("## COROA Item maravilhoso, lendário"), para("mais")]
    assert [r[1] for r in segment(items, ITEM)] == ["Anel de Cinza", "Coroa"]


def test_oversized_entity_keeps_its_name_and_no_anchor_falls_back():
    got = segment([para("URSO", "Besta Média, neutro"), para(*STATS, *["palavra " * 60] * 80)], CREATURE)
    assert len(got) > 1 and {r[1] for r in got} == {"Urso"} and {r[4] for r in got} == {"entity-aware/monstro"} and not any(r[5] for r in got)
    assert all(r[5] and r[4] == "paragraph-token" for r in segment([para("a"), Block("table", 1, [], "<table></table>")], CREATURE))
    assert segment([], CREATURE) == []


def test_chunks_of_duplicate_blocks(spark):
    rows = [("d", 0, "paragraph", 1, ["um"], "um"), ("d", 1, "table", None, [], "<table>"), ("d", 1, "table", None, [], "<table>")]
    df = spark.createDataFrame(rows, "doc_id string, block_idx int, kind string, page int, lines array<string>, text string")
    got = chunking.with_ids(chunking.chunk_blocks(df), F.lit("vau")).orderBy("ordinal").collect()
    assert [(r.text, r.is_fallback, r.page_start) for r in got] == [("um", True, 1), ("<table>", True, None)]


def test_header_stops_at_another_entity_and_reaches_a_chapter():
    far = [para(f"texto {i}") for i in range(20)]
    chapter = [para("## OROGS", "Vivem longe."), para("texto"), para("OROG CHEFE", "Humanoide Médio, neutro e mau"), para(*STATS)]
    got = [(name, fallback) for _, name, _, _, _, fallback in segment([para("abertura"), *chapter], CREATURE)]
    assert got == [(None, True), ("Orog Chefe", False)]
    first = chunking._creature_headers([para("abertura"), *chapter])
    assert first(4) == 1  # the chapter's heading, three blocks above the type line
    assert chunking._creature_headers([para("## OROGS"), *far, *chapter[2:]])(22) == 21  # the chapter is out of reach
    assert chunking._creature_headers([para("## OROGS"), para("## AÇÕES"), *chapter[2:]])(3) == 2  # a sub-heading lies between
    assert chunking._creature_headers([para("## OROGS"), para(*STATS), *chapter[2:]])(3) == 2  # another anchor lies between
    assert chunking._creature_headers([*far[:6], para(*STATS)])(6) == 5 and chunking._creature_headers([para(*STATS)])(0) == -1


def test_names_of_creatures_in_their_order():
    two = [para("DRAGÃO DE", "COBRE ANCIÃO", "Dragão Enorme, caótico e bom"), para(*STATS)]
    assert [r[1] for r in segment(two, CREATURE)] == ["Dragão de Cobre Ancião"]
    before = [para("texto", "LESMA DO SAL"), para("Besta Média, imparcial"), para(*STATS)]
    assert [r[1] for r in segment(before, CREATURE)] == ["Lesma do Sal"]
    heading = [para("## LESMAS"), para("Besta Média, imparcial"), para(*STATS)]
    assert [r[1] for r in segment(heading, CREATURE)] == ["Lesmas"]
    assert [r[1] for r in segment([para("Besta Média, imparcial"), para(*STATS)], CREATURE)] == [None]


def test_pages_of_pieces_by_their_words():
    lines = [("um dois três", 1), ("um dois três", 2), ("quatro cinco", None), ("seis sete", 4)]
    assert chunking.pages_of_pieces(["um dois três", "três um dois três quatro", "cinco seis", "nada disso"], lines) == [(1, 1), (1, 2), (4, 4), (1, 4)]
    assert chunking.pages_of_pieces([""], lines) == [(1, 4)] and chunking.pages_of_pieces([], []) == [] and chunking.pages_of_pieces(["x"], []) == [(None, None)]


def test_how_a_whole_text_ends(spark):
    whole = ["Fim.", "Fim!  \n", "AÇÕES", "as ações", "9 m", "<td>", "x\n· item solto", "ele disse ”’", "(nota)"]
    cut_off = ["o guarda e a", "REAÇÕES LENTAS", "", "reações"]
    df = spark.createDataFrame([(t,) for t in whole + cut_off], "t string")
    assert [r.e for r in df.select(chunking.ends_whole(F.col("t")).alias("e")).collect()] == [True] * len(whole) + [False] * len(cut_off)
