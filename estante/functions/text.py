"""Text functions as Columns: normalising, tokenising, headings, names in capitals, ids and page labels.

All of them give null for null; none is a Python function per row.
"""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------------------------------------
CONNECTIVES = ["de", "do", "da", "dos", "das", "e", "ou", "a", "o", "the", "of"]
STAT_SUBHEADINGS = ["AÇÕES", "AÇOES", "REAÇÕES", "REAÇOES", "AÇÕES LENDÁRIAS", "AÇÕES LENDARIAS", "AÇÕES DE COVIL", "AÇÕES DE COVIL E EFEITOS REGIONAIS", "EFEITOS REGIONAIS", "AÇÕES ADICIONAIS", "AÇÕES BÔNUS"]
SIDEBARS = "VARIAÇÃO|VARIANTE|OPCIONAL|OPÇÃO"
DISPLAY_NAMES = {"monstro": "Manual dos Monstros", "jogador": "Livro do Jogador", "mestre": "Guia do Mestre"}
BOOK_ALIASES = {"monstros": "monstro", "manual": "monstro"}
#: Small Latin letters with marks, and the letter that each is without them, by Unicode's own decomposition.
ACCENTS = "".join(c for c in map(chr, (*range(0xE0, 0x250), *range(0x1E00, 0x1F00))) if c == c.lower() and unicodedata.decomposition(c)[:1] not in ("", "<") and unicodedata.normalize("NFD", c)[0] in string.ascii_lowercase)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in ACCENTS)
HEADING = r"^#{1,6}\s+\S"
CLEAN_NAME = r"^[\p{Lu}0-9][\p{Lu}0-9 ,'/()+\-\.À-ſ]{1,58}$"


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def norm(text: Column) -> Column:
    """Trimmed, lower case, without accents: for equality and containment tests."""
    return fold(F.lower(F.trim(text)))


def fold(text: Column) -> Column:
    """Without accents: the letters of `ACCENTS` are replaced and combining marks left out."""
    return F.regexp_replace(F.translate(text, ACCENTS, PLAIN), r"\p{Mn}+", "")


def tokens(text: Column) -> Column:
    """Index terms: maximal runs of letters and digits, lower case, without accents; no stemming, no stop words."""
    return F.filter(F.split(F.translate(F.lower(text), ACCENTS, PLAIN), r"[^\p{L}\p{Nd}]+"), lambda t: t != "")


def searchable(query: Column) -> Column:
    return query.rlike(r"[\p{L}\p{Nd}]")


def chunk_id(book: Column, text: Column) -> Column:
    """Content identity: the first 16 bytes of SHA-256 over book, newline, text, printed as a mixed-endian GUID."""
    h = F.sha2(F.concat(book, F.lit("\n"), text), 256)
    part = lambda *places: F.concat(*[F.substring(h, p, 2) for p in places])
    return F.concat_ws("-", part(7, 5, 3, 1), part(11, 9), part(15, 13), F.substring(h, 17, 4), F.substring(h, 21, 12))


def token_estimate(text: Column) -> Column:
    """A token for every four characters."""
    return F.floor(F.length(text) / 4).cast("bigint")


def is_heading(line: Column) -> Column:
    return line.rlike(HEADING)


def strip_heading(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"^#{1,6}\s+", ""))


def is_boundary_heading(line: Column) -> Column:
    """A heading that can open an entity: not long, no sentence, no sidebar, no sub-heading of a stat block."""
    text = strip_heading(line)
    bare = F.upper(F.trim(F.regexp_replace(text, r"[.:]+$", "")))
    return is_heading(line) & (F.length(text) <= 55) & ~text.contains(". ") & ~bare.rlike(f"^({SIDEBARS})") & ~bare.isin(STAT_SUBHEADINGS)


def is_caps_name(line: Column) -> Column:
    """A name in capitals: at most 80 characters, at most one small letter a word, connectives as they like."""
    s = strip_heading(line)
    words = F.filter(F.transform(F.split(s, r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}]", "")), lambda w: F.length(w) >= 2)
    capital = F.forall(words, lambda w: F.lower(w).isin(CONNECTIVES) | (F.length(F.regexp_replace(w, r"[^\p{Ll}]", "")) <= 1))
    return F.length(s).between(1, 80) & (F.size(words) > 0) & capital


def clean_name(raw: Column) -> Column:
    s = F.trim(F.regexp_replace(strip_heading(raw), r"\s+", " "))
    return F.trim(F.regexp_replace(s, r"^[.,:;·\-—*]+|[.,:;·\-—*]+$", ""))


def title_case(name: Column) -> Column:
    """Words and hyphenated parts capitalised; connectives small except at the start."""
    capital = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))
    words = F.filter(F.split(F.lower(name), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(CONNECTIVES), w).otherwise(F.array_join(F.transform(F.split(w, "-"), capital), "-"))), " ")


def is_loose_label(line: Column) -> Column:
    """A label in capitals standing alone: 4 to 48 characters, a space, no digit, three capitals or more, one small letter at most."""
    s = F.trim(line)
    count = lambda c: F.length(F.regexp_replace(s, rf"[^\p{{{c}}}]", ""))
    return F.length(s).between(4, 48) & s.contains(" ") & ~s.rlike(r"\p{Nd}") & (count("Lu") >= 3) & (count("Ll") <= 1)


def is_clean_name(name: Column) -> Column:
    n = F.trim(name)
    return F.length(n).between(2, 60) & F.upper(n).rlike(CLEAN_NAME) & ~n.contains("  ")


def display_name(book: Column) -> Column:
    return F.coalesce(_map(DISPLAY_NAMES)[book], book)


def canonical_book(book: Column) -> Column:
    b = F.lower(F.trim(book))
    return F.coalesce(_map(BOOK_ALIASES)[b], b)


def page_label(start: Column, end: Column, prefix: str = "p. ") -> Column:
    """"p. 3", "p. 3–5", or null without a page."""
    return F.when(start.isNull(), None).when(end.isNull() | (end == start), F.concat(F.lit(prefix), start.cast("string"))).otherwise(F.concat(F.lit(prefix), start.cast("string"), F.lit("–"), end.cast("string")))


def preview(text: Column, width: int = 160) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, width)
