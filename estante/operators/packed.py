"""Several values packed in one field, split into one row per value with its position.

Ordinary characters are masked to a delimiter skeleton (`a` a run of letters, `9` a run of digits, `U` a UUID, everything
else as it is). A splitting rule is resolved once per distinct skeleton, and the rules are joined back (broadcast while few and small, else by a salted join)
and applied by position to the field's own tokens.

Defined cases: a null, empty or value-less field gives no rows; a quoted part is one value whatever it contains, its doubled
quotes standing for one; an unclosed quote is a delimiter; empty places are skipped; repeated values are kept; very long
fields are treated as short ones; rows repeated under one key give repeated output unless `distinct_keys`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estante.runtime import cut, fits, merged

#: A token of a field: a UUID, a run of letters, a run of digits, or one other character.
TOKEN = r"(?s)[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[\p{L}\p{M}]+|\p{Nd}+|."
#: What a field without any quote can hold as one value; with blanks only inside a name that starts after a delimiter.
_BARE = re.compile(r"U|[ae](?:[ae9.&_'-]| (?=[ae])(?!e ))*: ?9(?: ?[-–—] ?9)?")
_PLAIN = re.compile(r"\s*(?:U|\S.*:\s*9(?:\s*[-–—]\s*9)?)\s*", re.S)
_AFTER = re.compile(r"[^\w]|$")
#: Tasks over which the rows of a skeleton are dealt if the rules are too many to be broadcast.
SALTS = 16
RULE = "skeleton string, parts array<struct<first:int,length:int,quote:string>>"


def tokens(field: Column) -> Column:
    return F.regexp_extract_all(field, F.lit(TOKEN), F.lit(0))


def skeleton(parts: Column) -> Column:
    """One character per token, so a place in the skeleton is a place among the tokens."""

    def mask(t: Column) -> Column:
        return (
            F.when(F.length(t) == 36, F.lit("U"))
            .when(t == "e", F.lit("e"))
            .when(t.rlike(r"^[\p{L}\p{M}]+$"), F.lit("a"))
            .when(t.rlike(r"^\p{Nd}+$"), F.lit("9"))
            .otherwise(t)
        )

    return F.array_join(F.transform(parts, mask), "")


def resolve(s: str) -> list[tuple[int, int, str]]:
    """The values of a skeleton as (first token from 1, number of tokens, quote sign or '')."""
    found, i, n = [], 0, len(s)
    while i < n:
        c = s[i]
        if c in "\"'" and (i == 0 or s[i - 1] not in "ae9U"):
            j = i + 1
            while j < n and not (s[j] == c and not (j + 1 < n and s[j + 1] == c)):
                j += 2 if s[j] == c else 1
            if j < n and _PLAIN.fullmatch(s, i + 1, j):
                a, b = i + 1, j
                while s[a].isspace():
                    a += 1
                while s[b - 1].isspace():
                    b -= 1
                found.append((a + 1, b - a, c))
                i = j + 1
                continue
            i += 1
            continue
        if c == "e" and i + 1 < n and s[i + 1].isspace():
            i += 1
            continue
        if m := _BARE.match(s, i):
            found.append((i + 1, m.end() - i, ""))
            i = m.end()
            continue
        i += 1
    return found


def _resolve_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"skeleton": b["skeleton"], "parts": [[{"first": f, "length": k, "quote": q} for f, k, q in resolve(s)] for s in b["skeleton"]]})


def split_packed(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, campo, posicao, valor, n) for every value of every field; n is the number of values in that field."""
    pairs = F.array(*[F.struct(F.lit(f).alias("campo"), F.col(f).cast("string").alias("campo_texto")) for f in fields])
    long = (
        df.select(F.col(key).alias("chave_linha"), F.explode(pairs).alias("p"))
        .select("chave_linha", "p.campo", tokens(F.col("p.campo_texto")).alias("partes"))
        .where(F.size("partes") > 0)
        .withColumn("skeleton", skeleton(F.col("partes")))
    )
    rules = cut(long.select("skeleton").distinct().mapInPandas(_resolve_all, RULE).where(F.size("parts") > 0))
    if fits(rules):
        held = long.join(F.broadcast(rules), "skeleton")
    else:  # the commonest skeleton is dealt over `SALTS` tasks
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        held = long.withColumn("salt", F.pmod(F.xxhash64("chave_linha"), F.lit(SALTS)).cast("int")).join(merged(salted), ["skeleton", "salt"])
    placed = held.select("chave_linha", "campo", "partes", F.size("parts").cast("bigint").alias("n"), F.posexplode("parts").alias("i", "r"))
    raw = F.array_join(F.slice("partes", F.col("r.first"), F.col("r.length")), "")
    value = F.when(F.col("r.quote") == "", raw).otherwise(F.replace(raw, F.concat("r.quote", "r.quote"), F.col("r.quote")))
    return placed.select(F.col("chave_linha").alias(key), "campo", (F.col("i") + 1).cast("bigint").alias("posicao"), value.alias("valor"), "n")


def packed_found(perguntas: DataFrame) -> DataFrame:
    """One row for each value of a reference field that holds at least two."""
    out = split_packed(perguntas, "line_no", ["paginas_referencia", "chunks_referencia"])
    return out.where("n >= 2").dropDuplicates(["line_no", "campo", "posicao"]).select("line_no", "campo", "posicao", "valor")
