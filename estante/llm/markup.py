"""Markup residue in text: HTML, Markdown, wiki and LaTeX, found and turned into clean text that keeps structure.

A lenient reader makes a tree of every place that could be markup, in all four notations at once, signs used as such included.
Boosted trees judge each node by its subtree density, attribute tokens, depth, siblings and surroundings. Decoding goes from
the root down: where a verbatim node (comment, code, formula) and nodes inside it would both be accepted, the side with
the greater log-odds wins, so no ancestor and descendant contradict each other.

The trees are fitted on a bounded sample of the corpus's own texts without any markup character (`TRAIN_TEXTS`), into which markup
and plain signs are written by rule, so every label is known.

Defined cases: null and empty texts hold no markup; cut-off tables and unclosed marks still count, as markup of their notation;
texts are read whole; repeated rows count once; an empty table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estante.llm.boosting import BoostedTrees
from estante.runtime import cut, lowest_by_hash, spread

NOTATIONS = ("html", "markdown", "wiki", "latex")
TRAIN_TEXTS, AMONG, SEED = 700, 32, 11
#: Java pattern of a text that could hold markup; the others never leave the JVM.
COULD = r"[<>&`\\{}\[\]|$#*=]|''|__|(?<![\p{L}\p{N}_])_(?=[^\s_])|(?m)^[ \t]*[-+][ \t]+\S|^[ \t]*-{3,}[ \t]*$"

_PARAGRAPH = re.compile(r"\n[ \t]*\n")


class Span:
    __slots__ = ("a", "b")

    def __init__(self, a: int, b: int) -> None:
        self.a, self.b = a, b

    def start(self) -> int:
        return self.a

    def end(self) -> int:
        return self.b


class Paired:
    """Spans from an opening mark to the next closing one of its sort, found from the sorted places of both: of any length, in linear time.
    `sign`: a character without which there is none; `inline`: an empty line ends the search."""

    def __init__(self, sign: str, sorts: list[tuple[str, str]], inline: bool = True) -> None:
        self.sign, self.inline = sign, inline
        self.sorts = [(re.compile(a), re.compile(b)) for a, b in sorts]

    def finditer(self, text: str) -> Iterator[Span]:
        if self.sign not in text:
            return
        opened = sorted((m.start(), m.end(), k) for k, (p, _) in enumerate(self.sorts) for m in p.finditer(text))
        if not opened:
            return
        closed = [[(m.start(), m.end()) for m in p.finditer(text)] for _, p in self.sorts]
        starts = [[a for a, _ in c] for c in closed]
        ends = [m.start() for m in _PARAGRAPH.finditer(text)] if self.inline else []
        last = 0
        for a, e, k in opened:
            i = bisect_left(starts[k], e + 1)
            if a < last or i == len(starts[k]):
                continue
            if ends and (j := bisect_left(ends, e)) < len(ends) and ends[j] < starts[k][i]:
                continue
            last = closed[k][i][1]
            yield Span(a, last)


_READERS: list[tuple[str, str, re.Pattern | Paired]] = [
    ("html", "comment", re.compile(r"<!--[\s\S]*?(?:-->|$)")),
    ("html", "tag", re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>")),
    ("html", "cut", re.compile(r"</?[A-Za-z!][^<>]*\Z|<(?=\Z)")),
    ("html", "entity", re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")),
    ("html", "sign", re.compile(r"[<>](?=[ =]?\d)|(?<![<>])<(?=\s)|&(?=\s)|&(?=[A-Za-z]+(?![;\w]))")),
    ("markdown", "heading", re.compile(r"^#{1,6}[ \t]+\S.*$", re.M)),
    ("markdown", "bullet", re.compile(r"^[ \t]*[-*+][ \t]+(?=\S)", re.M)),
    ("markdown", "quote", re.compile(r"^[ \t]*>[ \t]*(?=[^\s\d=])", re.M)),
    ("markdown", "fence", re.compile(r"^[ \t]*```.*$", re.M)),
    ("markdown", "strong", Paired("*", [(r"\*\*(?=[^\s*_])", r"(?<=\S)\*\*")])),
    ("markdown", "strong", Paired("__", [(r"__(?=[^\s*_])", r"(?<=\S)__")])),
    ("markdown", "emphasis", Paired("*", [(r"(?<![\w*\\])\*(?=[^\s*])", r"(?<=[^\s*])\*(?![\w*])")])),
    ("markdown", "emphasis", Paired("_", [(r"(?<![\w_])_(?=[^\s_])", r"(?<=[^\s_])_(?![\w_])")])),
    ("markdown", "code", Paired("`", [(r"(?<!`)`(?!`)", r"(?<!`)`(?!`)")])),
    ("markdown", "link", re.compile(r"!?\[(?![\[\]])(?:(?!\n[ \t]*\n)[^\[\]])+\]\([^()\s]*\)")),
    ("markdown", "row", re.compile(r"^[ \t]*\|(?![-}+|]*$)(?!-\s)[^\n]*\|[ \t]*$|^[ \t]*\|(?:[ \t]*:?-{2,}:?[ \t]*\|)+[ \t]*$", re.M)),
    ("markdown", "rule", re.compile(r"^[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*$", re.M)),
    ("markdown", "sign", re.compile(r"(?<=\w)\*(?![\w*])|#(?=\d)|\[\d{1,3}\](?!\()")),
    ("wiki", "heading", re.compile(r"^={2,6}[ \t]*[^=\s]|(?<=[^=\s])[ \t]*={2,6}[ \t]*$", re.M)),
    ("wiki", "quotes", Paired("''", [(rf"(?<!')'{{{k}}}(?=[^'\s])", rf"(?<=[^'\s])'{{{k}}}(?!')") for k in (2, 3, 4, 5)])),
    ("wiki", "link", re.compile(r"\[\[(?:(?!\n[ \t]*\n)[^\[\]])+\]\]")),
    ("wiki", "template", re.compile(r"\{\{[^{}]+\}\}")),
    ("wiki", "table", re.compile(r"^[ \t]*\{\|.*$|^[ \t]*\|[-}+].*$|^!.*$", re.M)),
    ("wiki", "sign", re.compile(r"(?<=\s)=(?=\s)|(?<=\w)''(?=\s)")),
    ("latex", "display", Paired("\\", [(r"\\\[", r"\\\]"), (r"\\\(", r"\\\)")], inline=False)),
    ("latex", "display", Paired("$$", [(r"\$\$", r"\$\$")], inline=False)),
    ("latex", "command", re.compile(r"\\[A-Za-z]+\*?")),
    ("latex", "formula", re.compile(r"(?<![\\$\w])\$(?![\s$])[^$\n]+?(?<![\s\\])\$(?![\w$])")),
    ("latex", "break", re.compile(r"\\\\(?=\s|$)", re.M)),
    ("latex", "sign", re.compile(r"(?<=[A-Z])\$(?=[ \d])|(?<!\w)\$(?=\d)|\\(?![A-Za-z\\\[\]()$%&#_{}])")),
]
KINDS = [f"{n}.{k}" for n, k, _ in _READERS]
_TAG, _HTML_SIGN, _COMMAND = (KINDS.index(k) for k in ("html.tag", "html.sign", "latex.command"))
_ORDER = [NOTATIONS.index(n) for n, _, _ in _READERS]
_SIGN = [int(k == "sign") for _, k, _ in _READERS]
_VERBATIM = {"html.comment", "markdown.code", "latex.display", "latex.formula"}
_TAGS = set("p br hr b i u em strong span div a ul ol li table thead tbody tr td th h1 h2 h3 h4 h5 h6 sup sub code pre img figure figcaption font center small big blockquote dl dt dd caption body html head section".split())
_FEATURES = 22


def nodes(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of everything that could be markup, outer before inner."""
    out = [(m.start(), m.end(), k) for k, (_, _, p) in enumerate(_READERS) for m in p.finditer(text)]
    tags = {b for _, b, k in out if k == _TAG}  # the ">" of a tag is no sign
    out = [s for s in out if not (s[2] == _HTML_SIGN and s[1] in tags)]
    out.sort(key=lambda s: (s[0], -s[1], s[2]))
    return out


def _shape(c: str) -> int:
    return 0 if not c or c == "\n" else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


def _own(k: int, body: str) -> tuple[float, float, int, float, int, str]:
    """What a node's own text tells: shares of letters, digits and blanks, lines, and its attribute tokens: a known name or not."""
    known, name, kind, size = 0, "", KINDS[k], len(body)
    if k == _TAG:
        name = body.strip("</>").split(" ", 1)[0].split("\n", 1)[0].rstrip("/").lower()
        known = 1 if name in _TAGS else -1
    elif kind == "html.entity":
        known = 1 if html.unescape(body) != body else -1
    elif k == _COMMAND:
        known = min(size, 12)
    elif kind == "latex.formula":
        known = 1 if re.search(r"[\\^_={}+]", body) else -1
    return sum(map(str.isalpha, body)) / size, sum(map(str.isdigit, body)) / size, body.count("\n"), body.count(" ") / size, known, name


def tree(text: str, found: list[tuple[int, int, int]]) -> tuple[list[int], np.ndarray]:
    """The parent of each node (-1 at the top), and the nodes' features."""
    n = len(text)
    parent, stack = [], []
    inside = [0] * len(found)
    for i, (a, b, _) in enumerate(found):
        while stack and (found[stack[-1]][1] < b or found[stack[-1]][1] <= a):
            stack.pop()
        parent.append(stack[-1] if stack else -1)
        for s in stack:
            inside[s] += 1
        stack.append(i)
    depth = []
    for p in parent:
        depth.append(depth[p] + 1 if p >= 0 else 0)
    kinds = Counter(k for _, _, k in found)
    notation = Counter(KINDS[k].split(".")[0] for k, c in kinds.items() for _ in range(c) if not KINDS[k].endswith("sign"))
    siblings = Counter((p, k) for p, (_, _, k) in zip(parent, found))
    opened = Counter(text[a + 1 : b].split()[0].rstrip("/>").lower() for a, b, k in found if KINDS[k] == "html.tag" and b > a + 2 and text[a + 1] != "/")
    rows, own = [], {}
    for i, (a, b, k) in enumerate(found):
        body = text[a:b]
        if (k, body) not in own:
            own[k, body] = _own(k, body)
        letters, digits, lines, blanks, known, name = own[k, body]
        up = parent[i]
        pair = (1 if opened[name] else 0) if k == _TAG else (1 if text[b : b + 1] in ("{", "[") else 0) if k == _COMMAND else 0
        number, count = notation[_READERS[k][0]], siblings[up, k]
        rows.append((
            _ORDER[k], k, b - a, letters, digits,
            _shape(text[a - 1 : a]), _shape(text[b : b + 1]), _shape(body[1:2]), _shape(body[-1:]),
            depth[i], count, kinds[k], number, inside[i], inside[i] / (b - a), known, pair, (b - a) / n, lines,
            blanks, k if up < 0 else found[up][2] + 100, _SIGN[k],
        ))
    x = np.array(rows, dtype=np.float32).reshape(len(found), _FEATURES)
    return parent, x


def decode(found: list[tuple[int, int, int]], parent: list[int], odds: np.ndarray) -> list[bool]:
    """Accepted nodes: positive log-odds, but never a verbatim node together with what lies in it."""
    yes = [o > 0 for o in odds]
    children: dict[int, list[int]] = {}
    for i, p in enumerate(parent):
        children.setdefault(p, []).append(i)

    def below(i: int) -> list[int]:
        out, todo = [], list(children.get(i, ()))
        while todo:
            j = todo.pop()
            out.append(j)
            todo += children.get(j, ())
        return out

    for i, (_, _, k) in enumerate(found):  # outer nodes come first
        if not yes[i] or KINDS[k] not in _VERBATIM:
            continue
        under = [j for j in below(i) if yes[j]]
        other = [j for j in under if _READERS[found[j][2]][0] != _READERS[k][0]]
        if other and sum(odds[j] for j in other) > odds[i]:
            yes[i] = False
        else:
            for j in under:
                yes[j] = False
    return yes


# --- training by writing markup into clean texts ----------------------------------------------------------------------------


def _write(text: str, rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A text with markup and plain signs written into it, and where: (start, end, notation or "sign")."""
    words = text.split(" ")
    spans: list[tuple[int, int, str]] = []

    def some(k: int = 4) -> str:
        i = rng.randrange(max(1, len(words) - k))
        return " ".join(words[i : i + rng.randint(1, k)]).replace("\n", " ") or "texto"

    n = lambda: str(rng.randint(1, 900))
    plain = lambda: rng.choice([some(3), n(), f"{n()} po", "—", f"{rng.randint(1, 9)}d8"])
    w = lambda k=4: plain() if rng.random() < 0.15 else some(k)
    nested: list[tuple[str, str]] = []

    def cell() -> str:
        if rng.random() > 0.08:
            return plain()
        c = rng.choice(NOTATIONS)
        nested.append((c, inline[c]()))
        return nested[-1][1]

    inline = {
        "html": lambda: rng.choice([f"<{(t := rng.choice(['b', 'i', 'em', 'strong', 'span', 'sup', 'sub', 'SPAN', 'u']))}>{w()}</{t}>", f'<a href="{w(1)}">{w()}</a>', f'<span class="{w(1)}">{w()}</span>', "<br>", "<br/>", "<BR />", "&nbsp;", "&amp;", "&ccedil;", "&#9;", "&#231;", "&mdash;", "<hr/>", f"<!-- {w()} -->"]),
        "markdown": lambda: rng.choice([f"**{w()}**", f"__{w()}__", f"*{w()}*", f"_{w()}_", f"`{w()}`", f"[{w()}](#{n()})", f"[{w()}](http://x.y/{n()})", f"![{w()}]({n()}.png)"]),
        "wiki": lambda: rng.choice([f"'''{w()}'''", f"''{w()}''", f"[[{w()}]]", f"[[{w(2)}|{w()}]]", f"{{{{nota|{w()}}}}}", f"{{{{ficha|ca={n()}|pv={n()}}}}}"]),
        "latex": lambda: rng.choice([f"\\textbf{{{w()}}}", f"\\emph{{{w()}}}", f"\\textit{{{w()}}}", f"$\\frac{{{n()}}}{{{n()}}}$", f"$x_{{{n()}}} = {n()}$", f"\\({n()} + x\\)"]),
        "sign": lambda: rng.choice([f"CA<{n()}", f"é <{n()}", f"CA>{n()}", f"x > {n()}", f"{w(1)} & {w(1)}", f"{w(1)} {n()}*", f"item #{n()}", f"R$ {n()} em {w()}; custa R$ {n()}", f"US$ {n()}", f"US$ 5 ou R$ {n()}", f"[{rng.randint(1, 99)}].", f"({w(1)}*)", f"a = {n()}", f"{n()} - {n()}", f"<{n()} ou >{n()}", f"{n()}* e {n()}*", f"P&D"]),
    }
    rows, columns = rng.randint(2, 6), rng.randint(2, 4)
    grid = lambda a, b, c: "\n".join(a + b.join(cell() for _ in range(columns)) + c for _ in range(rows))
    tag = rng.choice(["td", "TD"])
    table_html = lambda: "<table>" + "".join("<tr>" + "".join(f"<{tag}>{cell()}</{tag}>" for _ in range(columns)) + "</tr>" for _ in range(rows)) + "</table>"
    whole_html = ""
    block = {
        "html": lambda: rng.choice([f"<h{rng.randint(1, 6)}>{w()}</h2>", f"<p>{w(9)}</p>", f"<ul><li>{w()}</li><li>{w()}</li></ul>", whole_html, whole_html[: rng.randint(10, len(whole_html))], f'<div class="a">{w(8)}</div>', '<!-- PageNumber="3" -->', "<hr/>"]),
        "markdown": lambda: rng.choice([f"{'#' * rng.randint(1, 6)} {w()}", "\n".join(f"{(b := rng.choice('-*+'))} {w()}" for _ in range(rng.randint(2, 5))), f"> {w(8)}", f"```\n{w()}\n```", grid("| ", " | ", " |"), "| a | b |\n|---|:---:|\n" + "| 1 | 2d4 |"]),
        "wiki": lambda: rng.choice([f"== {w()} ==", f"=== {w(3)} ===", "{| class=wikitable\n! a !! b\n|-\n" + grid("| ", " || ", "\n|-") + "\n|}", "[[Categoria:Regras]]", f"{{{{caixa|{w()}}}}}"]),
        "latex": lambda: rng.choice([f"\\section{{{w()}}}", f"\\subsection*{{{w(8)}}}", f"\\begin{{itemize}}\n\\item {w()}\n\\item {w()}\n\\end{{itemize}}", "\\[ x = \\frac{a}{b} \\]", f"\\begin{{tabular}}{{ll}}\na & b \\\\ \\hline\n{grid('', ' & ', ' ' + chr(92) * 2)}\n\\end{{tabular}}"]),
        "sign": lambda: rng.choice([f"R$ {n()} em {w()}", "— — —", f"– {w()}", f"{n()} – {w()}", f"Preço #{n()}"]),
    }
    chosen = rng.sample(NOTATIONS, rng.choice([0, 1, 1, 1, 2])) + ["sign"] * rng.randint(0, 2)
    places: list[tuple[int, str, str, list]] = []
    for c in chosen:
        for _ in range(rng.randint(1, 3)):
            if rng.random() < 0.55:
                places.append((rng.randrange(len(words) + 1), c, inline[c](), []))
            else:
                nested.clear()
                whole_html = table_html()
                places.append((rng.randrange(len(words) + 1), c, "\n" + block[c]() + "\n", list(nested)))
    out, size, last = [], 0, 0
    for at, c, piece, within in sorted(places, key=lambda p: p[0]):
        before = " ".join(words[last:at])
        out += [before, " "] if before else []
        size += len(before) + (1 if before else 0)
        spans.append((size, size + len(piece), c))
        for other, inner in within:
            k = piece.find(inner)
            if k >= 0:
                spans.append((size + k, size + k + len(inner), other))
        out += [piece, " "]
        size += len(piece) + 1
        last = at
    return "".join(out) + " ".join(words[last:]), spans


def train(samples: list[str]) -> BoostedTrees:
    rng = random.Random(SEED)
    xs, ys = [], []
    for text in samples:
        for _ in range(3):
            made, spans = _write(text, rng)
            found = nodes(made)
            if not found:
                continue
            _, x = tree(made, found)
            xs.append(x)
            ys.append([float(any(a < e and s < b and _READERS[k][0] == c for s, e, c in spans)) and not KINDS[k].endswith("sign") for a, b, k in found])
    if not xs:
        xs, ys = [np.zeros((2, _FEATURES), dtype=np.float32)], [[0.0, 1.0]]
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


# --- operators --------------------------------------------------------------------------------------------------------------


def texts(chunks: DataFrame, blocos: DataFrame) -> DataFrame:
    c = chunks.select(F.lit("chunks").alias("tabela"), F.col("chunk_id").alias("chave"), F.col("text").alias("texto"))
    b = blocos.where("kind = 'table'").select(F.lit("blocos").alias("tabela"), F.concat_ws("#", "doc_id", "block_idx").alias("chave"), F.col("text").alias("texto"))
    return c.unionByName(b)


def fitted(rows: DataFrame) -> BoostedTrees:
    """Trees fitted on at most `TRAIN_TEXTS` clean texts, chosen by hash of the key among the `AMONG` times as many texts of the lowest hash."""
    plain = rows.where(F.col("texto").isNotNull() & ~F.col("texto").rlike(COULD) & (F.length("texto") > 60)).select("chave", "texto")
    some = lowest_by_hash(plain, TRAIN_TEXTS, "chave", of=rows.count(), spare=AMONG).toPandas()
    return train(list(some["texto"]) or ["texto de exemplo sem marcação alguma, para dados sem texto limpo"] * 50)


def _judged(text: list[str], model: BoostedTrees) -> Iterator[tuple[list, list[int], list[bool]]]:
    found = [nodes(t) for t in text]
    trees = [tree(t, f) if f else ([], np.zeros((0, _FEATURES), dtype=np.float32)) for t, f in zip(text, found)]
    odds = model.log_odds(np.concatenate([x for _, x in trees])) if trees else np.zeros(0)
    at = 0
    for f, (parent, x) in zip(found, trees):
        yield f, parent, decode(f, parent, odds[at : at + len(x)])
        at += len(x)


def markup_found(chunks: DataFrame, blocos: DataFrame) -> DataFrame:
    """(tabela, chave, marcacao): one row for each text and notation in it."""
    rows = texts(chunks, blocos)
    model = fitted(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for table, key, (found, _, yes) in zip(b["tabela"], b["chave"], _judged(list(b["texto"]), model)):
                out += [(table, key, n) for n in {_READERS[k][0] for (_, _, k), y in zip(found, yes) if y}]
            yield pd.DataFrame(out, columns=["tabela", "chave", "marcacao"])

    return rows.where(F.col("texto").rlike(COULD)).mapInPandas(run, "tabela string, chave string, marcacao string").distinct()


def clean(text: str, found: list[tuple[int, int, int]], yes: list[bool]) -> str:
    """The text with accepted markup turned into plain structure: headings on their own line after "# ", list items after "- ", table cells between " | ", code and formulas as they are written."""
    accepted = [(a, b, KINDS[k]) for (a, b, k), y in zip(found, yes) if y]
    edits: list[tuple[int, int, str]] = []
    for a, b, kind in accepted:
        body = text[a:b]
        if kind in ("html.comment", "html.cut", "markdown.rule", "wiki.template"):
            edits.append((a, b, body[2:-2].split("|")[-1] if kind == "wiki.template" and "=" not in body else ""))
        elif kind == "html.tag":
            name = body.strip("</>").split()[0].rstrip("/").lower() if body.strip("</> ") else ""
            closing = body.startswith("</")
            new = ""
            if re.fullmatch(r"h[1-6]", name):
                new = "\n" if closing else "\n# "
            elif name == "li":
                new = "" if closing else "\n- "
            elif name in ("td", "th"):
                new = " | " if closing else ""
            elif name in ("p", "div", "tr", "table", "ul", "ol", "br", "hr", "caption", "blockquote"):
                new = "\n"
            edits.append((a, b, new))
        elif kind == "html.entity":
            edits.append((a, b, html.unescape(body).replace("\xa0", " ")))
        elif kind == "markdown.heading":
            edits.append((a, a + len(body) - len(body.lstrip("#")), "#"))
        elif kind == "markdown.bullet":
            edits.append((a, b, "- "))
        elif kind == "markdown.quote":
            edits.append((a, b, ""))
        elif kind in ("markdown.strong", "markdown.emphasis", "wiki.quotes"):
            k = {"markdown.strong": 2, "markdown.emphasis": 1}.get(kind) or len(body) - len(body.lstrip("'"))
            edits += [(a, a + k, ""), (b - k, b, "")]
        elif kind == "markdown.link":
            end = body.rindex("](")
            edits += [(a, a + (2 if body[0] == "!" else 1), ""), (a + end, b, "")]
        elif kind == "markdown.row":
            if re.fullmatch(r"[ \t|:-]+", body):
                edits.append((a, b, ""))
        elif kind == "wiki.heading":
            edits.append((a, a + len(body) - len(body.lstrip("= \t")), "# ") if body.startswith("=") else (a, b, ""))
        elif kind == "wiki.link":
            bar = body.rfind("|")
            edits += [(a, a + (bar + 1 if bar > 0 else 2), ""), (b - 2, b, "")]
        elif kind == "wiki.table":
            edits.append((a, b, body.lstrip("! ").replace("!!", "|") if body.startswith("!") else ""))
        elif kind == "latex.command":
            name = body.rstrip("*")
            arg = re.compile(r"\{([^{}]*)\}").match(text, b)
            if name in ("\\begin", "\\end", "\\hline"):
                extra = re.compile(r"(?:\{[^{}]*\})*").match(text, b)
                edits.append((a, extra.end(), ""))
            elif name == "\\item":
                edits.append((a, b, "- "))
            elif arg:
                edits += [(a, b + 1, "# " if "section" in name or "chapter" in name else ""), (arg.end() - 1, arg.end(), "")]
        elif kind == "latex.break":
            edits.append((a, b, ""))
    out, last = [], 0
    for a, b, new in sorted(edits):
        if a < last:
            continue
        out += [text[last:a], new]
        last = b
    cleaned = "".join(out) + text[last:]
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", cleaned)).strip()


def cleaned(chunks: DataFrame, blocos: DataFrame) -> DataFrame:
    """(tabela, chave, limpo): every text once, clean; texts without markup characters pass unchanged within the JVM. Of a key delivered with several texts the least counts."""
    rows = cut(texts(chunks, blocos).groupBy("tabela", "chave").agg(F.min("texto").alias("texto")))
    model = fitted(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = list(b["texto"])
            yield pd.DataFrame({"tabela": b["tabela"], "chave": b["chave"], "limpo": [clean(t, f, y) for t, (f, _, y) in zip(text, _judged(text, model))]})

    could = F.coalesce(F.col("texto").rlike(COULD), F.lit(False))
    judged = spread(rows.where(could)).mapInPandas(run, "tabela string, chave string, limpo string")
    return judged.unionByName(rows.where(~could).select("tabela", "chave", F.col("texto").alias("limpo")))
