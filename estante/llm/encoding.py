"""Garbled text from a wrong character encoding: found and, where possible, restored.

Round-trip repair: the text, or its tail from some point on, is re-encoded under a candidate legacy encoding, strictly
decoded as the intended encoding, and the step is repeated for nested layers while a garbling cost drops.

Defined cases: null and empty text is not garbled, nor is ASCII text without question marks in place of letters; a replacement
character, a stray control byte or question marks that stand for letters make a text garbled though not restorable (`restored`
is then null); question marks after a word, before a blank or the end, are punctuation; rightly written foreign scripts, capitals and signs stay as they
are; repeated rows give repeated results; any length is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (encoding that was wrongly used, encoding that was meant). Western European text; all pairs are tried at every layer.
PAIRS = [(w, "utf-8") for w in ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250")] + [(w, "cp1252") for w in ("mac_roman", "cp1251", "cp437", "cp850", "cp1250", "cp1253")]
LAYERS = 3
#: Java patterns of text worth a look (either of _SIGNS and _ASKED): any sign outside ASCII and ordinary Portuguese letters, an accented capital after a small letter, a lone capital A with tilde.
_SIGNS = "[^\\x00-\\x7FáàâãéêíóôõúüçÁÀÂÃÉÊÍÓÔÕÚÜÇºª–—]|\\p{Ll}[À-Þ]|(?<!\\p{L})Ã(?!\\p{L})"
#: Question marks that stand for lost letters, in Java and Python alike: inside a word, at its start, at its end before a comma or the like, or for a word before a small letter.
_ASKED = r"(?<=[A-Za-zÀ-ÿ])\?+(?!\w*=)(?=[a-zß-ÿ])|(?<=[A-ZÀ-Þ])\?+(?=[A-ZÀ-Þ])|(?<![^\s(\['-])\?+(?=[A-Za-zÀ-ÿ])|(?<=[A-Za-zÀ-ÿ0-9])\?{2,}(?=[,;:])|(?<!\S)\?{2,}(?=\s+[a-zß-ÿ])"
#: What every text with such a question mark has: one that no blank follows.
_MAYBE_ASKED = r"\?\S"

_FOREIGN = "ƒıŒœŸŽžŠšþÞðÐßøØåÅæÆÌÈÙÛÒËÏìîïûëòùäÄÿÝýʼ˙ˆ˜ĂăÎŞşŢţŁłĐđŐőŰűŔŕěĚřŘťŤůŮńŃ"
_BAD = [
    (3, re.compile(r"[\x80-\x9f�]")),
    (1, re.compile(r"\w[^\w\s\x00-\x7f’‘‐‑–—](?=\w)")),
    (1, re.compile(r"[^\W\d_][«¡¿√├┬┴┼│┤╡╢║╗╝╣─═░▒▓█└┘┐┌„‚‡†˙∫¬£§©®¢¥¤¦±µ¶´¨¸¯¼½¾≠≤≥∞∂∑∏π◊≈∆⌐Ωﬁﬂ₧‹€\xa0\xad]")),
    (2, re.compile(r"[^\W\d_A-ZÀ-Þ][À-Þ]")),
    (1, re.compile(rf"(?<=[A-Za-z])[{_FOREIGN}]|[{_FOREIGN}](?=[A-Za-z])")),
    (2, re.compile(r"[A-Za-zÀ-ÿ][Ͱ-ϿЀ-ӿ]|[Ͱ-ϿЀ-ӿ][A-Za-zÀ-ÿ]")),
    (2, re.compile(r"[ÃÂ√├┬╬][^\w\s\x00-\x7f]|Ãƒ|[√├┬]\w|â€|в[Ђ„‚€]|Г[Ј§©]")),
    (1, re.compile(r"(?<!\w)Ã(?!\w)|\dÂ(?!\w)")),
    (1, re.compile(r"(?<!\w)[·‚„‡È˙](?=\s)|(?<!\S)¿(?=\s)|\d[∫™є║](?!\w)")),
]
_NO_LETTER = re.compile(_ASKED)
#: Signs that no repair removes: the original byte is gone.
_LOST = re.compile(r"�|[\x80-\x9f]")


def cost(text: str) -> int:
    """How garbled a text looks: 0 for clean text."""
    return sum(w * len(p.findall(text)) for w, p in _BAD) + len(_NO_LETTER.findall(text))


def _first_bad(text: str) -> int:
    return min((m.start() for _, p in _BAD if (m := p.search(text))), default=-1)


def _bytes(text: str, encoding: str) -> bytes:
    if encoding != "cp1252":
        return text.encode(encoding)
    out = bytearray()  # undefined bytes of cp1252 pass as control characters
    for ch in text:
        try:
            out += ch.encode("cp1252")
        except UnicodeEncodeError:
            out += ch.encode("latin-1")
    return bytes(out)


def _round_trip(text: str, wrong: str, meant: str) -> str | None:
    try:
        raw = _bytes(text, wrong)
        if meant == "utf-8":  # a text cut inside a character keeps all but that character
            for k in range(min(4, len(raw))):
                if k == 0 or raw[-k] & 0xC0:
                    try:
                        return (raw[:-k] if k else raw).decode("utf-8")
                    except UnicodeDecodeError as e:
                        if e.end < len(raw) - 3:
                            return None
            return None
        return raw.decode(meant)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None


def _starts(text: str) -> list[int]:
    """Where the garbled part may begin: the text's start, and the non-ASCII characters up to the first bad place."""
    bad = _first_bad(text)
    out, i = {0}, bad + 1
    while i >= 0 and i > bad - 2:
        out.add(max(i, 0))
        i -= 1
    if 0 <= bad:
        run = bad
        while run > 0 and ord(text[run - 1]) > 127:
            run -= 1
        out.add(run)
    return sorted(out)


def repair(text: str, layers: int = LAYERS) -> tuple[str, int, int]:
    """(best text, its cost, layers undone). A strict UTF-8 reading may need a further layer before the cost drops; readings in a one-byte encoding always succeed, so they must pay at once and end the search."""
    best = (cost(text), 0, text)
    if best[0] == 0 or layers == 0:
        return text, best[0], 0
    for p in _starts(text):
        head, tail = text[:p], text[p:]
        for wrong, meant in PAIRS:
            t = _round_trip(tail, wrong, meant)
            if t is None or t == tail:
                continue
            if meant == "utf-8":
                t, c, n = repair(head + t, layers - 1)
                best = min(best, (c, n + 1, t))
            else:
                best = min(best, (cost(head + t), 1, head + t))
    return (best[2], best[0], best[1]) if best[1] else (text, best[0], 0)


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for key, field, text in zip(b["line_no"], b["campo"], b["texto"]):
            lost = bool(_LOST.search(text) or _NO_LETTER.search(text))
            best, c, layers = repair(text)
            if layers or lost or c:
                rows.append((key, field, text, best if c == 0 and not _LOST.search(best) and not _NO_LETTER.search(text) else None, layers))
        yield pd.DataFrame(rows, columns=["line_no", "campo", "texto", "restored", "layers"])


def garbled(df: DataFrame, key: str = "line_no", fields: tuple[str, ...] = ("pergunta", "resposta_referencia")) -> DataFrame:
    """(line_no, campo, texto, restored, layers) of every garbled field; `restored` is null where the original is lost. Only suspect texts leave the JVM."""
    pairs = F.array(*[F.struct(F.lit(f).alias("campo"), F.col(f).cast("string").alias("texto")) for f in fields])
    long = df.select(F.col(key).cast("bigint").alias("line_no"), F.explode(pairs).alias("p")).select("line_no", "p.campo", "p.texto")
    suspect = F.col("texto").rlike(_SIGNS) | (F.col("texto").rlike(_MAYBE_ASKED) & F.col("texto").rlike(_ASKED))
    return long.where(suspect).mapInPandas(_judge, "line_no bigint, campo string, texto string, restored string, layers int")


def garbled_found(df: DataFrame) -> DataFrame:
    return garbled(df).select("line_no", "campo").distinct()
