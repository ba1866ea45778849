"""Token ids of the whole corpus by a public tokenizer, containers of fixed capacity, and pieces of oversized texts.

The vocabulary is a local rank file on every machine, its folder a parameter; each Python worker loads it once. Long texts
are split, before encoding, where white space follows a visible character: the tokenizer's own pre-splitting always starts a
new word there, so the ids are those of the whole text. Ids and pieces go back to text by joining raw bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estante.runtime import cut, spread

FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k"
#: The pre-splitting pattern published with this vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
LONG, PART = 100_000, 50_000
_SAFE = re.compile(r"(?<=\S)(?=[ \n\t\r])")


@lru_cache(maxsize=4)
def encoding(folder: str = FOLDER, name: str = VOCABULARY) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(folder, f"{name}.tiktoken").read_bytes().splitlines())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(folder: str = FOLDER, name: str = VOCABULARY) -> list[bytes]:
    e = encoding(folder, name)
    return [e.decode_single_token_bytes(i) for i in range(e.n_vocab)]


@lru_cache(maxsize=4)
def _token_lengths(folder: str, name: str) -> np.ndarray:
    return np.array([len(b) for b in token_bytes(folder, name)], dtype=np.int64)


def safe_parts(text: str, long: int = LONG, part: int = PART) -> list[str]:
    """The text, or if it is longer than `long` characters its parts of about `part`, cut only where a pre-splitting match must begin."""
    if len(text) <= long:
        return [text]
    out, start = [], 0
    while len(text) - start > part:
        m = _SAFE.search(text, start + part)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def encode(text: str | None, folder: str = FOLDER, name: str = VOCABULARY) -> list[int]:
    """Ids without special tokens; null and empty give []. Strings that look like special tokens are ordinary text."""
    if not text:
        return []
    e = encoding(folder, name)
    parts = safe_parts(text)
    return e.encode_ordinary(parts[0]) if len(parts) == 1 else [i for p in parts for i in e.encode_ordinary(p)]


def decode(ids: list[int], folder: str = FOLDER, name: str = VOCABULARY) -> bytes:
    t = token_bytes(folder, name)
    return b"".join(t[i] for i in ids)


def token_ids(documents: DataFrame, folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids). Rows repeated under one doc_id each give their row; extra columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [encode(t, folder, name) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(each) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in each], out=offsets[1:])
            flat = np.fromiter((i for x in each for i in x), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(encode(t, folder, name)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, n_tokens bigint")


# --- containers -----------------------------------------------------------------------------------------------------------

CAPACITY, MOST_DOCUMENTS, SHARD = 2048, 512, 20_000
#: The attention capacity of a container, as a share of the square of its tokens; beyond it a container that a long text all but fills takes no more.
ATTENTION = 0.9
#: Weights of the residual norm: tokens, places for documents, attention cost.
WEIGHTS = (1.0, 0.02, 0.05)


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY, most: int = MOST_DOCUMENTS, attention: float | None = None, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The container of every item, by vector best fit: largest first, each into the container whose weighted residual norm over tokens, places and attention cost is least after it, among those where every residual stays at 0 or more. An item's attention cost is the square of its size, but never more than a container's capacity: an item
    over that is alone in its container."""
    attention = ATTENTION * capacity**2 if attention is None else float(attention)
    order = np.argsort(-sizes, kind="stable")
    cap = np.array([capacity, most, attention], dtype=float)
    w = (np.array(weights) / cap**2)[:, None]
    left = np.empty((3, max(len(sizes), 1)))
    ids = np.empty(max(len(sizes), 1), dtype=np.int64)
    where = np.empty(len(sizes), dtype=np.int64)
    opened = live = 0
    smallest = int(sizes.min()) if len(sizes) else 0
    for i in order:
        s = float(sizes[i])
        need = np.array([s, 1.0, min(s * s, attention)])[:, None]
        after = left[:, :live] - need
        fits = (after >= 0).all(axis=0)
        if fits.any():
            k = int(np.argmin(np.where(fits, (w * after * after).sum(axis=0), np.inf)))
        else:
            k = live
            left[:, k] = cap
            ids[k] = opened
            opened, live = opened + 1, live + 1
        left[:, k] -= need[:, 0]
        where[i] = ids[k]
        if left[0, k] < smallest or left[1, k] < 1 or left[2, k] < min(smallest**2, attention):  # nothing fits any more
            live -= 1
            left[:, k], ids[k] = left[:, live], ids[live]
    return where


def fill_containers(documents: DataFrame, capacity: int = CAPACITY, most: int = MOST_DOCUMENTS, attention: float | None = None, shard: int = SHARD, folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, part, first_token, n_tokens, container): every token of every text in exactly one container.

    A text is divided only if it alone exceeds the capacity, into full parts and a rest; null and empty texts give no rows; a
    text of exactly the capacity fills one container; repeated rows are items of their own. Items are dealt by hash into
    shards of about `shard` items, whatever their number, and each shard is packed on its own, so no group grows with the data.
    """
    sizes = cut(token_counts(documents, folder, name).where("n_tokens > 0"))
    parts = sizes.select(
        "doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / capacity).cast("int")), lambda k: F.struct((k * capacity).cast("bigint").alias("a"), F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - k * capacity).alias("n")))).alias("part", "x")
    ).select("doc_id", "part", F.col("x.a").alias("first_token"), F.col("x.n").alias("n_tokens"))
    full, rest = parts.where(F.col("n_tokens") == capacity), parts.where(F.col("n_tokens") < capacity)
    shards = max(1, -(-sizes.count() // shard))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "part"], kind="stable")
        pdf["container"] = [f"{key[0]}-{c}" for c in best_fit(pdf["n_tokens"].to_numpy(), capacity, most, attention)]
        return pdf[["doc_id", "part", "first_token", "n_tokens", "container"]]

    schema = "doc_id bigint, part int, first_token bigint, n_tokens bigint, container string"
    packed = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards))).groupBy("shard").applyInPandas(run, schema)
    alone = full.select("*", F.concat_ws("-", F.lit("full"), "doc_id", "part").alias("container"))
    return packed.unionByName(alone)


def container_residuals(containers: DataFrame, capacity: int = CAPACITY, most: int = MOST_DOCUMENTS, attention: float | None = None) -> DataFrame:
    """(container, tokens_left, places_left, attention_left) of every container, full ones included: what is unused of each capacity."""
    limit = ATTENTION * capacity**2 if attention is None else float(attention)
    cost = F.least(F.col("n_tokens").cast("double") * F.col("n_tokens"), F.lit(limit))
    return containers.groupBy("container").agg((F.lit(capacity) - F.sum("n_tokens")).alias("tokens_left"), (F.lit(most) - F.count("*")).alias("places_left"), F.greatest(F.lit(0.0), F.lit(limit) - F.sum(cost)).alias("attention_left"))


# --- pieces ---------------------------------------------------------------------------------------------------------------

LIMIT, OVERLAP = 512, 64
#: Penalty of a cut, by the boundary it falls on, and the weight of unequal sizes.
PENALTY = {"heading": 0.0, "paragraph": 1.0, "line": 3.0, "sentence": 4.0, "word": 20.0, "token": 60.0}
PER_PIECE, IMBALANCE = 3.0, 12.0
_BOUNDARIES = [
    ("heading", re.compile(rb"(?<=\n)(?=#{1,6}[ \t]|={2,6}[^=\n]|\\(?:sub)*section|[A-Z\xc3][A-Z\xc3\x80-\x9f '-]{3,60}\n)")),
    ("paragraph", re.compile(rb"\r?\n[ \t]*\r?\n\s*|\n(?:[ \t]*\n)+")),
    ("line", re.compile(rb"\r\n|\n|\r|\xe2\x80\xa8|\xe2\x80\xa9")),
    ("sentence", re.compile(rb"[.!?;](?:[\"')\]]|\xe2\x80[\x9d\x99]|\xc2\xbb)*(?=\s)|\xe3\x80\x82")),
    ("word", re.compile(rb"(?<=\S)(?=[ \t\n])")),
]


def boundaries(raw: bytes, ends: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[np.ndarray, list[str]]:
    """Token positions where the text can be cut, with the best kind of boundary there; gaps wider than a third of what a piece adds are filled with words, then tokens that end a character. ends: byte position after each token."""
    n = len(ends)
    kind: dict[int, str] = {}

    def add(name: str, within: tuple[int, int] | None = None) -> None:
        pattern = next(p for k, p in _BOUNDARIES if k == name)
        lo, hi = (0, len(raw)) if within is None else (int(ends[within[0] - 1]) if within[0] else 0, int(ends[within[1] - 1]))
        at = np.array([m.end() for m in pattern.finditer(raw, lo, hi)], dtype=np.int64)
        i = np.searchsorted(ends, at)
        for p, a in zip(i, at):
            if p < n - 1 and ends[p] == a:
                kind.setdefault(int(p) + 1, name)

    for name in ("heading", "paragraph", "line", "sentence"):
        add(name)
    widest = max(1, (limit - overlap) // 3)
    for name in ("word", "token"):
        known = [0, *sorted(kind), n]
        for a, b in zip(known, known[1:]):
            if b - a <= widest:
                continue
            if name == "word":
                add("word", (a, b))
            else:
                for p in range(a + 1, b):
                    if ends[p - 1] < len(raw) and raw[ends[p - 1]] & 0xC0 != 0x80:
                        kind.setdefault(p, "token")
    known = [0, *sorted(kind), n]
    for a, b in zip(known, known[1:]):
        if b - a > widest:
            for p in range(a + 1, b):  # no character ends here: cut between bytes
                kind.setdefault(p, "token")
    where = np.array(sorted(kind), dtype=np.int64)
    return where, [kind[int(p)] for p in where]


def cut_positions(n: int, where: np.ndarray, kinds: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(first token, token after the last, kind of its end) of the pieces with the least sum of cut penalties and size imbalance."""
    ends = np.append(where, n)
    penalty = np.array([PENALTY[k] for k in kinds] + [0.0])
    step = limit - overlap
    number = max(1, -(-(n - overlap) // step))
    ideal = (n - overlap) / number + overlap
    best, back = np.full(len(ends), np.inf), np.full(len(ends), -1, dtype=np.int64)

    def uneven(length: np.ndarray) -> np.ndarray:
        return IMBALANCE * ((length - ideal) / limit) ** 2

    for j, e in enumerate(ends):
        if overlap < e <= limit:
            best[j] = penalty[j] + PER_PIECE + uneven(e)
        lo = int(np.searchsorted(ends, max(e - step, overlap + 1)))
        if lo < j:
            c = best[lo:j] + uneven(e - (ends[lo:j] - overlap))
            k = int(np.argmin(c))
            if c[k] + penalty[j] + PER_PIECE < best[j]:
                best[j], back[j] = c[k] + penalty[j] + PER_PIECE, lo + k
    out, j = [], len(ends) - 1
    names = [*kinds, "end"]
    while j >= 0:
        i = int(back[j])
        out.append((int(ends[i]) - overlap if i >= 0 else 0, int(ends[j]), names[j]))
        j = i
    return out[::-1]


def split_oversized(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, pieces, first_token, n_tokens, ends_at, text) of every text over `limit` tokens.

    Consecutive pieces share exactly `overlap` tokens; none exceeds `limit`. Null, empty and short texts give no rows, and a
    text without any boundary is cut between tokens. A piece's text is its tokens' bytes, decoded; a character divided between
    tokens at a piece's start is replaced by U+FFFD there, being whole in the piece before.
    """

    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        lengths = _token_lengths(folder, name)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(text, folder, name)
                if len(ids) <= limit:
                    continue
                ends = np.cumsum(lengths[np.array(ids)])
                raw = text.encode("utf-8", "replace")
                pieces = cut_positions(len(ids), *boundaries(raw, ends, limit, overlap), limit, overlap)
                for k, (s, e, kind) in enumerate(pieces):
                    rows.append((doc, k, len(pieces), s, e - s, kind, raw[ends[s - 1] if s else 0 : ends[e - 1]].decode("utf-8", "replace")))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["doc_id", "piece", "pieces", "first_token", "n_tokens", "ends_at", "text"]), schema=_PIECES, preserve_index=False)

    long = documents.select("doc_id", "text").where(F.octet_length("text") > limit)  # every token has a byte at least
    return spread(long).mapInArrow(run, "doc_id bigint, piece int, pieces int, first_token bigint, n_tokens bigint, ends_at string, text string")


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("ends_at", pa.string()), ("text", pa.string())])


def oversized_found(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    return split_oversized(documents, limit, overlap).where("piece = 0").select("doc_id")
