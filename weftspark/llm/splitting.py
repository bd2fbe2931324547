"""Oversized texts cut at natural boundaries, with overlap.

Where a text has topics, they show as valleys of lexical cohesion: the similarity of the word counts in a block
of units before a boundary and in a block after it, smoothed over neighbours. Of the boundaries that lie in the window of possible
cuts, the one in the deepest valley is taken; the head of a module, section, paragraph or line makes a valley deeper by a fixed amount.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from weftspark.util import cut as stored
from weftspark.util import spread

MAX_TOKENS, OVERLAP = 512, 64
#: Units on each side of a boundary whose words are compared.
BLOCK = 4
#: A cut lies in the last part of the window: a piece is at least so full, unless no boundary lies there.
FULL = 0.5
#: What a kind of boundary adds to the depth of its valley, strongest kind first; depths lie between 0 and 4, mostly under 1.
BONUS = {"module": 0.8, "section": 0.6, "blank": 0.4, "line": 0.2, "sentence": 0.0}

# Kinds of boundary, strongest first: module-like heads, section heads, blank lines, lines, sentences, words.
_MODULE = re.compile(r"(?m)^(?=[ \t]*(?:module|package|interface|class|proc|def|function|macro|MACRO|LAYER|endmodule)\b)")
_SECTION = re.compile(r"(?m)^(?=#{1,6} |---|===|\[(?:INFO|WARN|WARNING|ERROR|DEBUG)\]|\d{4}-\d\d-\d\d[ T]|Chapter |Section )")
_BLANK = re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)+")
_LINE = re.compile(r"\r\n|\r|\n")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=[\"'(\[]?[A-ZÀ-Þ0-9¿¡])|(?<=[。！？])")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")


def tokens(n_chars: int) -> int:
    return max(1, n_chars // 4)


def oversized(c: Column, max_tokens: int = MAX_TOKENS) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)) > max_tokens


def boundaries(text: str) -> list[dict[int, None]]:
    """Offsets at which a piece may begin, by kind of boundary, strongest first; each offset counts for its strongest kind."""
    n = len(text)
    blank = {m.end() for m in _BLANK.finditer(text)}
    # a log line's head is a section only where its lines aren't all such heads
    section = [m.start() for m in _SECTION.finditer(text)]
    lines = [m.end() for m in _LINE.finditer(text)]
    if len(section) * 2 > len(lines) + 1:
        section = [p for p in section if text.startswith(("#", "---", "==="), p)]
    kinds = [[m.start() for m in _MODULE.finditer(text)], section, sorted(blank), lines, [m.end() for m in _SENTENCE.finditer(text)]]
    seen: set[int] = {0, n}
    out = []
    for k in kinds:
        new = [p for p in k if p not in seen]
        seen.update(new)
        out.append(new)
    return out


def depths(text: str, cuts: list[int]) -> list[float]:
    """The depth of the valley at each cut: how far smoothed block similarity rises from there to the next peaks on both sides.

    Blocks are BLOCK units wide on each side and slide by one unit; the product and the norms of their word counts are kept up with each
    word that moves, so the work is in proportion to the text.
    """
    ends = [*cuts, len(text)]
    bags = [Counter(_WORD.findall(text[a:b].lower())) for a, b in zip([0, *cuts], ends, strict=True)]
    left, right = Counter(), Counter()
    dot = nl = nr = 0

    def move(bag: Counter, to_left: int, to_right: int) -> None:
        nonlocal dot, nl, nr
        for w, c in bag.items():
            x, y = left[w], right[w]
            p, q = x + to_left * c, y + to_right * c
            dot += p * q - x * y
            nl += p * p - x * x
            nr += q * q - y * y
            left[w], right[w] = p, q

    for b in bags[1 : BLOCK + 1]:
        move(b, 0, 1)
    sims = []
    for i in range(len(cuts)):
        if i:
            move(bags[i], 0, -1)
        move(bags[i], 1, 0)
        if i >= BLOCK:
            move(bags[i - BLOCK], -1, 0)
        if i and i + BLOCK < len(bags):
            move(bags[i + BLOCK], 0, 1)
        sims.append(dot / math.sqrt(nl * nr) if nl and nr else 0.0)
    s = [(x + 2 * y + z) / 4 for x, y, z in zip([sims[0], *sims[:-1]], sims, [*sims[1:], sims[-1]], strict=True)] if sims else []
    up_left, up_right = s[:], s[:]
    for i in range(1, len(s)):
        if s[i - 1] >= s[i]:
            up_left[i] = up_left[i - 1]
    for i in range(len(s) - 2, -1, -1):
        if s[i + 1] >= s[i]:
            up_right[i] = up_right[i + 1]
    return [a + b - 2 * x for a, b, x in zip(up_left, up_right, s, strict=True)]


def split(text: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(start, fresh, end, kind) of each piece: text[start:end] with at most max_tokens; text[start:fresh] repeats the end of the piece before.

    kind names the boundary the piece ends at: module, section, blank, line, sentence, word, hard or end. Fresh parts
    joined give the text. A text under the limit is one piece. The overlap begins at a line, sentence or word bound
    and has at most `overlap` tokens; where no such bound lies in reach, it has all of them.
    """
    n, cap = len(text), max_tokens * 4 + 3
    if n <= cap:
        return [(0, 0, n, "end")]
    kinds = boundaries(text)
    sorted_kinds = [sorted(k) for k in kinds]
    named = {p: name for name, k in zip(BONUS, kinds, strict=True) for p in k}
    cuts = sorted(named)
    deep = depths(text, cuts)
    pieces, start, fresh = [], 0, 0
    while n - start > cap:
        top = start + cap
        low = max(fresh + 1, start + int(cap * FULL))
        end, kind = 0, ""
        window = range(bisect_left(cuts, low), bisect_right(cuts, top))
        if window:
            end = cuts[max(window, key=lambda i: (deep[i] + BONUS[named[cuts[i]]], i))]
            kind = named[end]
        else:
            for name, k in zip(BONUS, sorted_kinds, strict=True):
                at = bisect_right(k, top) - 1
                if at >= 0 and k[at] > fresh:
                    end, kind = k[at], name
                    break
        if not end:
            space = [m.end() for m in _SPACE.finditer(text, fresh + 1, top)]
            end, kind = (space[-1], "word") if space else (top, "hard")
        pieces.append((start, fresh, end, kind))
        start = fresh = end
        least = max(pieces[-1][1], end - (overlap * 4 + 3)) if overlap else end
        for k in (sorted_kinds[3], sorted_kinds[4]):
            inside = k[bisect_left(k, least + (least > 0)) : bisect_left(k, end)]
            if inside:
                start = inside[0]
                break
        else:
            space = [m.end() for m in _SPACE.finditer(text, least, end)]
            start = space[0] if space and space[0] < end else least
        if start <= pieces[-1][0]:
            start = end
        # cut the overlap down to where the text is a character's start of its own, not half a line end
        if text[start - 1 : start + 1] == "\r\n":
            start += 1
    pieces.append((start, fresh, n, "end"))
    return pieces


_PIECES = T.ArrayType(T.StructType([T.StructField("piece_no", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("fresh", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("cut", T.StringType())]))


def _splitter(max_tokens: int, overlap: int):
    @F.pandas_udf(_PIECES)
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series([[(i, a, f, e, k) for i, (a, f, e, k) in enumerate(split(t, max_tokens, overlap))] for t in s])

    return run


def _split_rows(chunks: DataFrame, max_tokens: int, overlap: int) -> DataFrame:
    """(source_file, chunk_id, chunk_index, h, n, p): the offsets of each chunk's pieces, without its text; h is a hash of the text.

    Texts within the limit are one piece without leaving the JVM; only oversized ones go to Python.
    """
    c = spread(chunks.where("text is not null").select("source_file", "chunk_id", "chunk_index", "text"))
    whole = F.array(F.struct(F.lit(0).alias("piece_no"), F.lit(0).alias("start"), F.lit(0).alias("fresh"), F.length("text").alias("end"), F.lit("end").alias("cut")))
    large = c.where(oversized(F.col("text"), max_tokens)).withColumn("p", _splitter(max_tokens, overlap)("text"))
    small = c.where(~oversized(F.col("text"), max_tokens)).withColumn("p", whole)
    return small.unionByName(large).select("source_file", "chunk_id", "chunk_index", F.md5("text").alias("h"), "p")


def pieces(chunks: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, span: int = 256) -> DataFrame:
    """(source_file, chunk_id, chunk_index, piece_no, pieces, new_chunk_index, start, fresh, end, cut, text, token_count), once per chunk_id and text.

    new_chunk_index: 0, 1, ... within each source_file, by chunk_index, chunk_id and piece_no. Null texts give no piece; an empty text
    is one empty piece of one token. Null ids and files are kept as null; null files are one file.
    Texts are split once. What is stored, freed of repeated deliveries and numbered are offsets without texts; the texts are joined to
    them last. A file may hold a third of all rows, so no window spans a file's rows: pieces are counted per file and span of
    chunk indices, the counts are summed up, and chunks are ordered within their span.
    """
    keys = ["source_file", "chunk_id", "chunk_index", "h"]
    o = stored(_split_rows(chunks, max_tokens, overlap).groupBy(*keys).agg(F.first("p").alias("p")))
    o = o.withColumn("_span", F.coalesce(F.floor(F.col("chunk_index") / span), F.lit(-1))).withColumn("_file", F.coalesce("source_file", F.lit("")))
    per = o.groupBy("_file", "_span").agg(F.sum(F.size("p")).alias("n"))
    per = per.select("_file", "_span", F.coalesce(F.sum("n").over(W.partitionBy("_file").orderBy("_span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = W.partitionBy("_file", "_span").orderBy("chunk_index", "chunk_id", "h").rowsBetween(W.unboundedPreceding, -1)
    o = o.withColumn("_in", F.coalesce(F.sum(F.size("p")).over(w), F.lit(0))).join(per, ["_file", "_span"]).select(*keys, "p", (F.col("_before") + F.col("_in")).alias("_first"))
    texts = chunks.where("text is not null").select("source_file", "chunk_id", "chunk_index", F.md5("text").alias("h"), "text").groupBy(*keys).agg(F.first("text").alias("text"))
    renamed = o.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    got = texts.join(renamed, same).select("source_file", "chunk_id", "chunk_index", "text", F.size("p").alias("pieces"), "_first", F.explode("p").alias("x"))
    # offsets count characters as Python does; Spark's substring too
    text = F.expr("substring(text, x.start + 1, x.end - x.start)")
    got = got.select("source_file", "chunk_id", "chunk_index", "x.piece_no", "pieces", (F.col("_first") + F.col("x.piece_no")).cast("long").alias("new_chunk_index"), "x.start", "x.fresh", "x.end", "x.cut", text.alias("text"))
    return got.withColumn("token_count", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("int"))


def oversized_chunks(chunks: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id) of the chunks that are split into several pieces."""
    return _split_rows(chunks, max_tokens, overlap).where(F.size("p") > 1).select("chunk_id").distinct()
