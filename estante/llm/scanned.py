"""Noise in text from scanned pages: words cut at line ends, misread characters, running headers and page numbers.

One averaged-perceptron character editor (keep, replace, delete, insert, join lines, close up letters that stand apart) is trained
on pairs mined from the corpus itself: a rare form and a far more frequent one that differ in one place; words and compounds broken
at a line end by rule, with their counts; words whose letters are read apart. It edits distinct word forms, never whole texts. What it proposes
counts if the corpus holds it: a repaired form must be at least `RATIO` times as frequent, a joined word must stand unbroken elsewhere
(occurrences at a line end are no evidence), and letters that stand apart must make known words.

Furniture is decided per line template by a perceptron on the line's shape, its place in the block and between its neighbours (does it
part a sentence?), its page number, and whether it names a book. Its labels come from how a template recurs over the corpus.

Counts cover all texts. Training reads bounded samples: `TRAIN_FREQUENT` forms by falling frequency, `TRAIN_RARE` others and `TRAIN_LINES` line templates of either label, each chosen by hash.

Defined cases: null and empty texts have no noise; repeated rows count once; compounds that break at their own hyphen, forms in
capitals, numbers and dice formulas are left alone; texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estante.llm.perceptron import Averaged, Editor, edit
from estante.runtime import cut, fits, greatest, lowest_by_hash, maybe_broadcast, merged

RATIO, SURE_RATIO, TRAIN_RATIO, TRAIN_FREQUENT, TRAIN_RARE, TRAIN_LINES = 12, 3, 30, 20_000, 6_000, 2_000
_HYPHEN = "[-\\u00AD\\u00AC\\u2010]"
_AT_LINE_END = _HYPHEN + r"[ \t]*[\r\n]"
_BREAK = _HYPHEN + r"(?<=[\p{L}@|].)[ \t]*(?:\r?\n[ \t]*)+(?=[\p{L}\p{N}@|])"
_FORM = r"[\p{L}\p{N}@|]++(?:-[\p{L}\p{N}@|]++)*+"
_CUT_FORM = _FORM + _HYPHEN + r"[ \t]*(?:\r?\n[ \t]*)+" + _FORM
_LOW = "[" + "".join(c for c in map(chr, range(0x530)) if unicodedata.category(c) == "Ll") + "]"
_SPACED = re.compile(rf"(?<![^\W_])(?<![@|-])(?:{_LOW}[ \n]{{1,2}}){{2,}}{_LOW}(?![^\W_]|[@|])")
_MAYBE_SPACED = re.compile(rf"[ \n]{_LOW}[ \n]{{1,2}}{_LOW}(?![^\W_])")
#: A line that ends in a single letter and, up to three lines on, one that begins with a single letter: letters may stand apart around furniture.
_AROUND = re.compile(rf"(?<![^\W_])(?<!-){_LOW}[ \t]*\n(?:[^\n]*\n){{1,3}}[ \t]*{_LOW}(?![^\W_])")
ROWS = "tabela string, chave string, texto string, pagina int"


def texts(blocos: DataFrame, chunks: DataFrame) -> DataFrame:
    """(tabela, chave, texto, pagina) of paragraph blocks and chunks."""
    b = blocos.where("kind = 'paragraph'").select(F.lit("blocos").alias("tabela"), F.concat_ws("#", "doc_id", "block_idx").alias("chave"), F.coalesce("text", F.array_join("lines", "\n")).alias("texto"), F.col("page").alias("pagina"))
    c = chunks.select(F.lit("chunks").alias("tabela"), F.col("chunk_id").alias("chave"), F.col("text").alias("texto"), F.col("page_start").alias("pagina"))
    return b.unionByName(c).where("texto is not null")


def forms(text: Column, broken: str | None = None) -> Column:
    """The word forms of a text as they are written; those cut at a line end are joined, or left out if `broken` is "out"."""
    mended = F.regexp_replace(text, _CUT_FORM, " ") if broken == "out" else F.regexp_replace(text, _BREAK, "")
    return F.regexp_extract_all(F.when(text.rlike(_AT_LINE_END), mended).otherwise(text), F.lit(_FORM), F.lit(0))


def written_forms(rows: DataFrame) -> DataFrame:
    """(written, n): how often each form occurs in all texts, line ends left out. Case and alphabet are looked at per distinct form, not per word of the corpus; forms without a small letter are left out."""
    return rows.select(F.explode(forms(F.col("texto"), "out")).alias("written")).groupBy("written").agg(F.count("*").alias("n")).where(F.col("written").rlike(r"\p{Ll}"))


def vocabulary(written: DataFrame) -> DataFrame:
    """(form, n, low): forms in small letters, how often each occurs, and how often without a capital; names are hardly ever without."""
    low = F.when(F.lower("written") == F.col("written"), F.col("n")).otherwise(0)
    return written.groupBy(F.lower("written").alias("form")).agg(F.sum("n").alias("n"), F.sum(low).alias("low"))


# --- misread characters ---------------------------------------------------------------------------------------------------


def mined_pairs(frequent: dict[str, int], rare: dict[str, int], ratio: int = TRAIN_RATIO) -> list[tuple[str, str]]:
    """(rare form, far more frequent form) differing in one place, found by a common first or last half."""
    by: dict[tuple[str, str], list[str]] = defaultdict(list)
    for v in frequent:
        if len(v) >= 4 and v.isalpha():
            by["a", v[: len(v) // 2]].append(v)
            by["z", v[-(len(v) // 2) :]].append(v)
    out = []
    for u, n in rare.items():
        if len(u) < 4:
            continue
        near = {v for k in range(2, len(u) + 1) for v in (*by.get(("a", u[:k]), ()), *by.get(("z", u[-k:]), ())) if abs(len(v) - len(u)) <= 1}
        good = [v for v in near if v != u and frequent[v] >= ratio * n and edit(u, v) is not None]
        if len(good) == 1:
            out.append((u, good[0]))
    return out


def train_editor(words: DataFrame, seed: int = 1) -> Editor:
    common = words.where(F.col("low") >= 0.3 * F.col("n"))
    top = greatest(common.where(F.length("form") >= 3), TRAIN_FREQUENT, "n", "form").toPandas()
    frequent = dict(zip(top["form"], top["n"]))
    some = lowest_by_hash(common.where(F.length("form") >= 4), TRAIN_RARE, "form").toPandas()
    pairs = mined_pairs(frequent, dict(zip(some["form"], some["n"])))
    # an operation is learnt from correct words too: those to which no mined pair points as misread
    wrong = {u for u, _ in pairs}
    known = [w for w in list(frequent)[: TRAIN_FREQUENT // 5] if w not in wrong and w.isalpha()]
    sample = lowest_by_hash(words.where(F.col("n") >= 2), TRAIN_RARE, "form").toPandas()
    rng = random.Random(seed)
    apart = [rng.choices(known, k=rng.randint(1, 3)) for _ in range(min(400, 5 * len(known)))] if known else []
    return Editor().train(pairs, known, broken_words(dict(zip(sample["form"], sample["n"])), rng), apart)


def broken_words(counts: dict[str, int], rng: random.Random) -> list[tuple[str, str, int, int, str]]:
    """Known words and compounds, broken at a line end: a word within, to be joined, a compound at its hyphen, which it keeps. Beside a form's own
    count stands that of the other writing: as the corpus has it, or a small share of its own, as slips write it."""
    out = []
    most = max((n for w, n in counts.items() if "-" not in w), default=1)
    for w, n in counts.items():
        if "-" in w.strip("-"):
            for _ in range(20):
                a, b = w.rsplit("-", 1)
                m = min(most, n * rng.choice((1, 1, 3, 10)))
                out.append((a, b, max(counts.get(a + b, 0), m // rng.choice((10, 40, 10**12))), m, "-"))
        elif len(w) >= 4 and w.isalpha():
            k = rng.randint(2, len(w) - 2)
            out.append((w[:k], w[k:], n, max(counts.get(f"{w[:k]}-{w[k:]}", 0), n // rng.choice((10, 40, 10**12, 10**12))), ""))
    return [x for x in out if x[2] != x[3] and (x[2] > x[3]) == (x[4] == "")]


def misread(words: DataFrame, editor: Editor | None = None, ratio: int = RATIO) -> DataFrame:
    """(form, repaired, all, low): forms that the editor turns into a form at least `ratio` times as frequent. That form must stand without a capital in
    30 % of its occurrences, or, if the misread one holds a digit or sign, `ratio` times as often as the misread one occurs."""
    editor = editor or train_editor(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(u, n, k, v, s) for u, n, k in zip(b["form"], b["n"], b["low"]) if not u.isdigit() and not re.fullmatch(r"\d+d\d+|[a-z]?\d+[a-zºª°]?", u) for v, s in editor.proposals(u)]
            yield pd.DataFrame(rows, columns=["form", "n", "k", "repaired", "score"])

    proposed = words.where(F.length("form").between(3, 40) | (F.length("form") == 2) & F.col("form").rlike(r"[^\p{L}]")).mapInPandas(run, "form string, n bigint, k bigint, repaired string, score double")
    against = words.where((F.col("low") > 0) & F.col("form").rlike(r"^[\p{L}-]+$")).select(F.col("form").alias("repaired"), F.col("n").alias("m"), "low")
    signs = F.col("form").rlike(r"[^\p{L}-]")
    ordinary = F.col("low") >= 0.3 * F.col("m")
    kept = merged(proposed).join(against, "repaired").where(F.when(signs, ordinary & (F.col("m") >= SURE_RATIO * F.col("n")) | (F.col("low") >= ratio * F.col("n"))).otherwise(ordinary & (F.col("m") >= ratio * F.col("n"))))
    return kept.groupBy("form").agg(F.max_by("repaired", F.struct(F.col("score"), F.col("m"), F.col("repaired"))).alias("repaired"), F.max("n").alias("all"), F.max("k").alias("low"))


def ocr_words(rows: DataFrame, written: DataFrame, words: DataFrame, bad: DataFrame, pages: DataFrame, lines: DataFrame, editor: Editor) -> DataFrame:
    """(tabela, chave, wrong, right) of every misread form of a text, and of every word whose letters stand apart."""
    # a form that is mostly written with a capital is a name that happens to look like a misreading: only its small occurrences count
    named = (F.col("written") != F.col("form")) & (2 * F.col("low") < F.col("all")) & (F.col("all") - F.col("low") > 2)
    misread_as = written.withColumn("form", F.lower("written")).join(maybe_broadcast(bad), "form").where(~named).select("written", F.col("repaired").alias("right"))
    each = rows.select("tabela", "chave", F.explode(forms(F.col("texto"))).alias("written"))
    wrong = each.join(maybe_broadcast(cut(misread_as)), "written").select("tabela", "chave", F.col("written").alias("wrong"), "right")
    spaced = pages.select("tabela", "chave", F.explode("letras").alias("letras"))
    return wrong.unionByName(apart_words(spaced.unionByName(spaced_around(pages, lines)), words, editor))


def kept_lines(pages: DataFrame, lines: DataFrame, kind: str) -> DataFrame:
    """(tabela, chave, kept): the lines of each text that are neither blank nor furniture."""
    by = ["tabela", "chave"]
    moved = lines.groupBy(*by).agg(F.collect_set("i").alias("moveis"))
    inside = lambda x, i: (x != "") & ~F.coalesce(F.array_contains("moveis", i), F.lit(False))
    return pages.select(*by, "l").join(merged(moved), by, kind).select(*by, F.filter("l", inside).alias("kept"))


def spaced_around(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(tabela, chave, letras): letters that stand apart around a line of furniture."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(t, k, x) for t, k, kept in zip(b["tabela"], b["chave"], b["kept"]) for x in _SPACED.findall("\n".join(kept))]
            yield pd.DataFrame(out, columns=["tabela", "chave", "letras"])

    return kept_lines(pages.where("em_volta"), lines, "inner").mapInPandas(run, "tabela string, chave string, letras string")


_ONE_LETTER = frozenset("aoeéàó")


def segment(letters: str, known: dict[str, int], closing: list[float] | None = None) -> list[str]:
    """The words of letters that stand apart: all of them known words or words of one letter, but for one letter at either end that may
    belong to what stands beside. Fewest words win, then the editor's gains of closing the blanks within them, then longest; at least one has three letters (seen five times) or more. Else none."""
    n = len(letters)
    gain = [0.0, *(closing or [0.0] * (n - 1))]
    best: list[tuple[int, float, int, list[str], int] | None] = [(0, 0.0, 0, [], 0)] + [None] * n
    longest = max(map(len, known), default=0)
    for i in range(n):
        if (held := best[i]) is None:
            continue
        alone = letters[i] in _ONE_LETTER
        ways = [(i + 1, 1 if alone else 3, [])] if alone or i in (0, n - 1) else []
        for j in range(i + 2, min(n, i + longest) + 1):
            w = letters[i:j]
            if known.get(w, 0) >= (1 if len(w) >= 4 else 5):
                ways.append((j, 1 if len(w) >= 3 else 2, [w]))
        for j, c, w in ways:
            new = (held[0] + c, held[1] - sum(gain[i + 1 : j]), held[2] - (j - i) ** 2, held[3] + w, held[4] + (c == 3))
            if best[j] is None or new < best[j]:
                best[j] = new
    *_, found, strange = best[n] or ([], 0)
    return found if any(len(w) >= (4 if strange else 3) for w in found) else []


def apart_words(runs: DataFrame, words: DataFrame, editor: Editor) -> DataFrame:
    """(tabela, chave, wrong, right): every word of the runs of letters that stand apart. Each distinct run meets, by join, the words that it can hold."""
    runs = cut(runs.withColumn("j", F.regexp_replace("letras", r"\s", "")))
    pieces = F.expr("flatten(transform(sequence(1, length(j) - 1), i -> transform(sequence(2, least(40, length(j) - i + 1)), k -> substring(j, i, k))))")
    tried = runs.select("j").distinct().select("j", F.explode(F.array_distinct(pieces)).alias("form"))
    held = words.select("form", "n").join(maybe_broadcast(cut(tried)), "form").groupBy("j").agg(F.collect_list(F.struct("form", "n")).alias("known"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(j, w) for j, known in zip(b["j"], b["known"]) for w in dict.fromkeys(segment(j, {x["form"]: x["n"] for x in known}, editor.closing(j)))]
            yield pd.DataFrame(rows, columns=["j", "right"])

    return runs.join(merged(held.mapInPandas(run, "j string, right string")), "j").select("tabela", "chave", F.col("letras").alias("wrong"), "right")


# --- furniture ------------------------------------------------------------------------------------------------------------

#: Words that stand beside a page or chapter number or a title (fixed values).
_TITLE_WORDS = ("p", "pág", "pag", "página", "pagina", "de", "cap", "capítulo", "capitulo")


#: Bare page marks, those that name a book (True), and lines that are neither (None), for corpora too small for any to recur.
_MARKS = {None: ("NOME EM CAPITAIS", "NOME", "Nome", "Um rótulo de seção", "9º grau", "9d9 + 9", "Alcance: 9 metros"), False: ("9", "— 9 —", "p. 9 de 9", "Pág. 9", "·9· Capítulo 9"), True: ("TITULO DO LIVRO", "Titulo do Livro 9", "9 | TITULO DO LIVRO", "CAPÍTULO 9: TITULO DO LIVRO", "T I T U L O   D O   L I V R O")}


_PAGE_MARK, _MARKUP, _NUMBER = re.compile(r"p(?:\. ?\d|ág)"), re.compile(r"[<>{}\\`*#=]"), re.compile(r"\d+")
_LINE_END = re.compile("[-\u00ad\u00ac\u2010][ \t]*\n")
PAGES = (
    "tabela string, chave string, moveis array<struct<i:int,template:string,edge:string,on_page:string,flow:string>>, l array<string>, cortada boolean, em_volta boolean, letras array<string>"
)


def lines_of(text: str) -> list[str]:
    """The trimmed lines of a text without blanks at its ends; the place of a line among them is its number everywhere here."""
    return [x.strip(" \t\xa0") for x in text.strip(" \t\r\n\xa0").replace("\r\n", "\n").replace("\r", "\n").split("\n")]


def furniture_lines(lines: list[str], page: int | None) -> list[tuple[int, str, str, str, str]]:
    """(number, template, edge, page number, flow) of the lines that can be furniture: short, not ending as a sentence does, starting with no small
    letter but of "p." or "pág.". flow: "cut" if the line stands within a sentence, "low" if only the next line goes on with a small
    letter, "open" if only the line before does not end a sentence."""
    out, last = [], len(lines) - 1
    for i, x in enumerate(lines):
        if not x or len(x) > 90 or x[-1] in ".,;:!?|" or x[0] == "|" or (x[0].islower() and not _PAGE_MARK.match(x)) or _MARKUP.search(x):
            continue
        after = (lines[i + 1] or (lines[i + 2] if i + 1 < last else "")) if i < last else ""
        before = (lines[i - 1] or (lines[i - 2] if i > 1 else "")) if i else ""
        goes_on, is_open = after[:1].islower(), before != "" and before[-1] not in ".!?:;"
        number = _NUMBER.search(x)
        on_page = "none" if not number else "page" if page is not None and abs(int(number[0][:9]) - page) <= 2 else "other"
        edge, flow = "first" if i == 0 else "last" if i == last else "inside", ("cut" if is_open else "low") if goes_on else "open" if is_open else "none"
        out.append((i, _NUMBER.sub("9", x.replace("\t", " ").replace("\xa0", " ")), edge, on_page, flow))
    return out


def page_rows(rows: DataFrame) -> DataFrame:
    """One row for each text that has a line that can be furniture, a word cut at a line end or letters that stand apart; its lines go along only if
    a word is cut or letters stand apart around a line. All of it is read in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for table, key, text, page in zip(*(b.column(k).to_pylist() for k in range(4))):
                lines = lines_of(text)
                whole = "\n".join(lines)
                found = furniture_lines(lines, page)
                broken = _LINE_END.search(whole) is not None
                around = any(x[-1:].islower() and (len(x) == 1 or x[-2] in " \t") for x in lines) and _AROUND.search(whole) is not None
                letters = _SPACED.findall(whole) if whole[1:2].isspace() or _MAYBE_SPACED.search(whole) else []
                if found or broken or around or letters:
                    out.append((table, key, [dict(zip(("i", "template", "edge", "on_page", "flow"), f)) for f in found], lines if broken or around else None, broken, around, letters))
            columns = list(zip(*out)) or [[]] * len(_PAGES)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PAGES)], schema=_PAGES)

    return rows.select("tabela", "chave", "texto", "pagina").mapInArrow(run, PAGES)


_PAGES = pa.schema([
    ("tabela", pa.string()), ("chave", pa.string()), ("moveis", pa.list_(pa.struct([("i", pa.int32()), *((c, pa.string()) for c in ("template", "edge", "on_page", "flow"))]))),
    ("l", pa.list_(pa.string())), ("cortada", pa.bool_()), ("em_volta", pa.bool_()), ("letras", pa.list_(pa.string())),
])


def line_rows(pages: DataFrame) -> DataFrame:
    """(tabela, chave, i, template, edge, on_page, flow) of the lines that can be furniture."""
    return pages.select("tabela", "chave", F.inline("moveis"))


def _whole_and_rest(text: str) -> tuple[Column, Column]:
    """The letters of a line, and those of its words that are no mark of page or chapter."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    return F.array_join(words, "").alias("whole"), F.array_join(F.filter(words, lambda w: ~w.isin(*_TITLE_WORDS)), "").alias("rest")


def templates_of(lines: DataFrame, livros: DataFrame | None) -> DataFrame:
    """(template, title, worded, total, cuts, lows, apart, paged, places): one row for each template, its places (at most 3 edges, 3 kinds of page number, 4 flows) counted."""
    counted = lines.groupBy("template", "edge", "on_page", "flow").agg(F.count("*").alias("k"))
    share = lambda c, name: F.sum(F.when(c, F.col("k")).otherwise(0)).alias(name)
    per = counted.groupBy("template").agg(
        F.sum("k").alias("total"), share(F.col("flow") == "cut", "cuts"), share(F.col("flow").isin("cut", "low"), "lows"), share(F.col("flow") == "none", "apart"),
        share(F.col("on_page") == "page", "paged"), F.collect_list(F.struct("edge", "on_page", "flow")).alias("places"),
    )
    per = per.select("*", *_whole_and_rest("template")).withColumn("worded", F.col("rest") != "")
    if livros is None:
        return per.withColumn("title", F.lit(False)).drop("whole", "rest")
    titles = livros.where("titulo is not null").select(F.explode(F.array(*[F.struct(F.lit(c).alias("of"), x.alias("name")) for c, x in zip(("whole", "rest"), _whole_and_rest("titulo"))])).alias("x"))
    titles = cut(titles.select("x.of", "x.name").where("name <> ''").distinct())
    side = F.broadcast if fits(titles) else merged
    for c in ("whole", "rest"):
        per = per.join(side(titles.where(F.col("of") == c).select(F.col("name").alias(c), F.lit(True).alias(f"is_{c}"))), c, "left")
    return per.withColumn("title", F.coalesce("is_whole", "is_rest", F.lit(False))).drop("whole", "rest", "is_whole", "is_rest")


def line_features(template: str, edge: str, on_page: str, flow: str, total: int, title: bool) -> list[str]:
    words = re.findall(r"[^\W\d_]+", template)
    rest = any(w.lower() not in _TITLE_WORDS for w in words)
    single = len(words) > 3 and all(len(w) == 1 for w in words)
    case = "none" if not words else "upper" if template.upper() == template else "lower" if template.lower() == template else "mixed"
    mask = re.sub(r"[^\W\d_]+", "a", template)
    mask = re.sub(r"(?:a ?)+", "a", mask)[:16]
    digits, mark = "9" in template, "9d" in template or "+" in template
    place = [f"edge={edge}", f"flow={flow}", f"page={on_page}", f"edge={edge}&flow={flow}"]
    return [*place, "bias", f"case={case}", f"single={single}", f"title={title}", f"rest={rest}", f"digits={digits}", f"n={min(total.bit_length() // 3, 5)}", f"title={title}&digits={digits}", f"title={title}&rest={rest}", f"rest={rest}&digits={digits}&mark={mark}", f"is={title}{rest}{digits}{mark}", f"mask={mask}", f"w={min(len(words), 9)}"]


def labelled(templates: DataFrame) -> DataFrame:
    """Templates whose nature shows in how they recur. Furniture is put between any two lines: it parts sentences, but also stands where none is
    parted; or it bears its own page's number most times. Text that recurs either never parts a sentence or always goes on in the next line; and a line that has a word of its own, names no book and
    bears no number of its page is text if it stands alone in the corpus or always at one place of its block."""
    parts = (F.col("cuts") >= 2) & (F.col("cuts") >= 0.1 * F.col("total")) & (F.col("apart") >= 2) & (F.col("lows") <= 0.85 * F.col("total"))
    paged = (F.col("total") >= 4) & (F.col("paged") >= 0.6 * F.col("total")) & (F.col("apart") > 0)
    steady = (F.col("total") >= 8) & ((F.col("cuts") <= 0.02 * F.col("total")) & (F.col("apart") + F.col("lows") < 0.5 * F.col("total")) | (F.col("cuts") == 0) & (F.col("total") >= 40))
    goes_on = (F.col("total") >= 4) & (F.col("lows") >= 0.9 * F.col("total"))
    unnamed = F.col("worded") & ~F.col("title") & (F.col("paged") == 0)
    alone = (F.col("total") == 1) & unnamed
    in_place = (F.col("total") >= 4) & (F.size("places") == 1) & unnamed
    return templates.withColumn("label", F.when(parts | paged, "furniture").when(steady | goes_on | alone | in_place, "text")).where("label is not null")


def furniture(lines: DataFrame, livros: DataFrame | None) -> DataFrame:
    """(template, edge, on_page, flow) of the lines that are furniture."""
    templates = cut(templates_of(lines, livros))
    known, alone = labelled(templates), F.col("total") == 1
    data, seen = [], set()
    parts = [lowest_by_hash(known.where((F.col("label") == label) & some), TRAIN_LINES, "template") for label, some in (("furniture", F.lit(True)), ("text", alone), ("text", ~alone))]
    for t in reduce(DataFrame.unionByName, parts).toPandas().itertuples(index=False):
        seen |= {t.title} if t.label == "furniture" else set()
        data += [(line_features(t.template, *p, t.total, t.title), t.label) for p in t.places]
    if seen != {True, False}:
        for title, marks in _MARKS.items():
            if title not in seen:
                data += [(line_features(t, e, p, f, 4, title is True), "text" if title is None else "furniture") for t in marks for e in ("first", "last", "inside") for p in ("none", "page", "other") for f in ("cut", "none")]
    model = Averaged().train(data, rounds=max(8, min(40, 60_000 // max(len(data), 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(t, *p.values()) for t, n, title, places in zip(b["template"], b["total"], b["title"], b["places"]) for p in places if model.predict(line_features(t, *p.values(), n, title)) == "furniture"]
            yield pd.DataFrame(out, columns=["template", "edge", "on_page", "flow"])

    return templates.select("template", "total", "title", "places").mapInPandas(run, "template string, edge string, on_page string, flow string")


# --- words cut at line ends -----------------------------------------------------------------------------------------------


def hyphen_breaks(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(tabela, chave, a, b): the halves of every word that is cut at a line end, in small letters; b stands at the start of the next line that is not furniture."""
    ends = r"([\p{L}@|][\p{L}\p{N}@|-]*|[\p{N}@|][\p{L}\p{N}@|-]*\p{L}[\p{L}\p{N}@|]*)" + _HYPHEN + "$"
    starts = r"^[^\p{L}\p{N}@|]{0,2}([\p{L}\p{N}@|]+(?:-[\p{L}\p{N}@|]+)*)"
    held = kept_lines(pages.where("cortada"), lines, "left")
    pairs = F.filter(F.transform("kept", lambda x, i: F.struct(x.alias("x"), F.get("kept", i + 1).alias("y"))), lambda s: s["x"].rlike(ends) & s["y"].isNotNull())
    cuts = held.select("tabela", "chave", F.explode(pairs).alias("s"))
    halves = cuts.select("tabela", "chave", F.lower(F.regexp_extract("s.x", ends, 1)).alias("a"), F.lower(F.regexp_extract("s.y", starts, 1)).alias("b"))
    return halves.where("b <> ''")


def hyphen_rows(breaks: DataFrame, words: DataFrame, editor: Editor) -> DataFrame:
    """(tabela, chave, joined) of the words that the editor joins and that stand unbroken elsewhere."""
    breaks = cut(breaks)
    ways = F.array(F.struct(F.concat("a", "b").alias("form"), F.lit(True).alias("one")), F.struct(F.concat_ws("-", "a", "b").alias("form"), F.lit(False).alias("one")))
    asked = cut(breaks.select("a", "b").distinct().select("a", "b", F.inline(ways)))
    n = lambda one: F.coalesce(F.max(F.when(F.col("one") == one, F.col("n"))), F.lit(0))
    counted = words.select("form", "n").join(maybe_broadcast(asked), "form").groupBy("a", "b").agg(n(True).alias("nj"), n(False).alias("nh")).where("nj > 0")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[editor.joins(*x) for x in b[["a", "b", "nj", "nh"]].itertuples(index=False)], ["a", "b"]]

    return breaks.join(maybe_broadcast(cut(counted.mapInPandas(run, "a string, b string"))), ["a", "b"], "left_semi").select("tabela", "chave", F.concat("a", "b").alias("joined"))


# --- together -------------------------------------------------------------------------------------------------------------


class Found:
    """What is known of a corpus's noise, each part a table written once: lines of furniture, misread words, words to join."""

    def __init__(self, rows: DataFrame, livros: DataFrame | None) -> None:
        written = cut(written_forms(rows))
        words = cut(vocabulary(written))
        pages = cut(page_rows(rows))
        lines = line_rows(pages)
        editor = train_editor(words)
        bad = cut(misread(words, editor))
        self.lines = lines.join(maybe_broadcast(cut(furniture(lines, livros))), ["template", "edge", "on_page", "flow"], "left_semi")
        self.words = ocr_words(rows, written, words, bad, pages, self.lines, editor)
        self.joined = hyphen_rows(hyphen_breaks(pages, self.lines), words, editor)


def noise_found(blocos: DataFrame, chunks: DataFrame, livros: DataFrame | None = None) -> DataFrame:
    """(tabela, chave, ruido): one row for each text and kind of noise in it."""
    found = Found(texts(blocos, chunks), livros)
    kinds = {"hifen": found.joined, "ocr": found.words, "mobilia": found.lines}
    return reduce(DataFrame.unionByName, [d.select("tabela", "chave", F.lit(k).alias("ruido")) for k, d in kinds.items()]).distinct()


_LINE_HYPHEN = re.compile(r"(\w+(?:-\w+)*)[-\u00ad\u00ac\u2010][ \t]*\n[ \t]*(\w+)")


def repair_text(text: str, moved: set[int], wrong: list[tuple[str, str]], joins: set[str]) -> str:
    """A text without furniture, its words repaired and joined, its lines run together to paragraphs."""
    kept = [x for i, x in enumerate(lines_of(text)) if i not in moved]
    out = "\n".join(kept)
    for a, b in sorted(wrong, key=lambda w: -len(w[0])):
        if " " in a or "\n" in a:  # the letters of a word, apart; one-letter words beside it stay
            letters = [re.escape(c) for c in b]
            out = re.sub(r"(?<!\w)" + r"[ \n]{1,2}".join(letters) + r"(?!\w)", b, out)
    if _LINE_END.search(out):
        out = _LINE_HYPHEN.sub(lambda m: m[1] + m[2] if (m[1] + m[2]).lower() in joins else f"{m[1]}-{m[2]}", out)
    for a, b in wrong:
        if " " not in a and "\n" not in a:
            cased = b.capitalize() if a[:1].isupper() else b
            out = re.sub(rf"(?<![\w@|]){re.escape(a)}(?![\w@|])", cased, out)
    paragraphs = []
    width = max((len(x) for x in kept), default=0)
    for block in re.split(r"\n[ \t]*\n", out):
        done, held, last = [], "", ""
        for line in filter(None, (x.strip() for x in block.split("\n"))):
            # a line was broken for want of room if the next word would not have fitted
            full = len(last) + 1 + len(line.split(" ", 1)[0]) > width
            if held and not last.isupper() and (full or line[0].islower()):
                held = f"{held} {line}"
            else:
                done += [held] if held else []
                held = line
            last = line
        if held:
            paragraphs.append("\n".join([*done, held]))
    return "\n\n".join(paragraphs)


def repaired(blocos: DataFrame, chunks: DataFrame, livros: DataFrame | None = None) -> DataFrame:
    """(tabela, chave, texto): every text as continuous paragraphs. Each text meets only its own repairs, by join; no table of all repairs travels."""
    rows = texts(blocos, chunks)
    found = Found(rows, livros)
    by = ["tabela", "chave"]
    once = rows.groupBy(*by).agg(F.min("texto").alias("texto"))
    # the repairs of all kinds in one table, so that texts meet them in one join
    none = {"i": "int", "palavra": "struct<wrong:string,right:string>", "junta": "string"}
    own = [found.lines.select(*by, "i"), found.words.select(*by, F.struct("wrong", "right").alias("palavra")), found.joined.select(*by, F.col("joined").alias("junta"))]
    every = reduce(DataFrame.unionByName, [d.select(*by, *[F.col(c) if c in d.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()]) for d in own])
    repairs = every.groupBy(*by).agg(F.collect_set("i").alias("moveis"), F.collect_set("palavra").alias("palavras"), F.collect_set("junta").alias("juntas"))
    noisy = once.join(merged(repairs), by, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            some = lambda v: [] if v is None else list(v)
            done = [repair_text(t, set(some(m)), [(w["wrong"], w["right"]) for w in some(p)], set(some(j))) for t, m, p, j in zip(b["texto"], b["moveis"], b["palavras"], b["juntas"])]
            yield b[by].assign(texto=done)

    return noisy.mapInPandas(run, "tabela string, chave string, texto string")
