"""Page cleaning, chunking, fragment ids and encoding.

Pages are ``doc, page, text``; fragments add ``n_in_page, id, chars``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from almenara.functions.numeric import pct, rounded
from almenara.functions.text import byte_words, nfkc, stretches
from almenara.operators.ordered import quantiles
from almenara.settings import CHUNK_SEPARATORS, HEADER_PATTERNS, TEXT

# Case-insensitive, per line, line feed as the only line end, Unicode character classes.
_FLAGS = "(?imdU)"


# ---------------------------------------------------------------- cleaning
_CONTROL = "".join(chr(i) for i in range(32) if chr(i) not in "\t\n\r")
_SOFT_HYPHEN = "\u00ad"
# Every character that counts as white space.
_SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(_SPACES))


def _without(col: Column, pattern: str) -> Column:
    return F.regexp_replace(col, _FLAGS + pattern, " ")


def clean_pages(pages: DataFrame, patterns: tuple[str, ...] = HEADER_PATTERNS) -> DataFrame:
    """Adds ``clean`` and whether enough text is left for the page to be useful.

    Headers out, broken words joined, ligatures and control characters normalised, spaces collapsed.
    """
    t = F.col("text")
    for p in patterns:
        t = _without(t, p)
    joined = pages.withColumn("clean", F.regexp_replace(t, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2"))
    df = joined.withColumn("clean", nfkc("clean"))
    t = F.translate(F.col("clean"), _CONTROL + _SOFT_HYPHEN, " " * len(_CONTROL))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r" *\n *", "\n")
    return df.withColumn("clean", strip(t)).withColumn("useful", F.length("clean") >= TEXT.min_chars)


def pattern_hits(pages: DataFrame, patterns: tuple[str, ...] = HEADER_PATTERNS) -> DataFrame:
    """Matches of each pattern on the text as the earlier patterns left it."""
    df, t = pages.select(F.col("text").alias("_t")), F.col("_t")
    for i, p in enumerate(patterns):
        df = df.withColumns({f"_h{i}": F.regexp_count(t, F.lit(_FLAGS + p)), "_t": _without(t, p)})
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(p).alias("pattern"), F.coalesce(F.sum(f"_h{i}"), F.lit(0)).alias("hits"))
        for i, p in enumerate(patterns)
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def extraction_quality(cleaned: DataFrame) -> DataFrame:
    """Per document: pages, useful pages, characters before and after, share removed."""
    before, after = F.sum(F.length("text")), F.sum(F.length("clean"))
    return cleaned.groupBy("doc").agg(
        F.count("*").alias("pages"), F.count_if("useful").alias("useful_pages"),
        F.count_if(~F.col("useful")).alias("dropped_pages"), before.alias("chars_before"), after.alias("chars_after"),
        pct(before - after, before).alias("pct_removed"), rounded(after / F.count("*"), 1).alias("chars_per_page"),
    )


def most_reduced_page(cleaned: DataFrame, min_chars: int = 500) -> DataFrame:
    """The page of each document that cleaning shortened most, among pages with enough text."""
    cut = F.round(1 - F.length("clean") / F.greatest(F.length("text"), F.lit(1)), 9)
    rows = cleaned.filter(F.length("text") > min_chars).withColumn("_cut", cut)
    best = F.max_by(F.struct("page", "_cut", "text", "clean"), F.struct(F.col("_cut"), -F.col("page")))
    return rows.groupBy("doc").agg(best.alias("b")).select(
        "doc", "b.page", rounded(100 * F.col("b._cut"), 1).alias("pct_removed"), "b.text", "b.clean"
    )


# ---------------------------------------------------------------- chunking
def _pieces(text: str, separator: str) -> list[str]:
    """Text cut before every separator, which stays at the start of the following piece."""
    parts = text.split(separator)
    kept = [parts[0]] + [separator + p for p in parts[1:]]
    return [p for p in kept if p]


def _pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Fill fragments up to ``size``; each starts with the tail of the one before, at most ``overlap``."""
    window: list[str] = []
    length = 0
    for piece in pieces:
        if window and length + len(piece) > size:
            yield "".join(window)
            drop = 0
            while length > overlap or (length > 0 and length + len(piece) > size):
                length -= len(window[drop])
                drop += 1
            window = window[drop:]
        window.append(piece)
        length += len(piece)
    if window:
        yield "".join(window)


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = CHUNK_SEPARATORS) -> list[str]:
    """Cut at the strongest separator present and cut pieces that are still too long at weaker ones."""
    level = next((i for i, s in enumerate(separators) if s in text), None)
    if level is None:
        return [text.strip()] if text.strip() else []
    weaker = separators[level + 1:]
    out: list[str] = []
    short: list[str] = []

    def flush() -> None:
        out.extend(f for f in (x.strip() for x in _pack(short, size, overlap)) if f)
        short.clear()

    for piece in _pieces(text, separators[level]):
        if len(piece) < size:
            short.append(piece)
            continue
        flush()
        out.extend(split_text(piece, size, overlap, weaker) if weaker else [piece.strip()])
    flush()
    return out


def fragment_id(doc: Column, page: Column, n: Column, text: Column) -> Column:
    """Position and content of a fragment in one stable id."""
    return F.format_string("%s::p%04d::c%03d::%s", doc.cast("string"), page, n, F.substring(F.sha1(text), 1, 10))


def _finish(raw: DataFrame, keep: list[str]) -> DataFrame:
    text = F.col("fragment")
    return raw.filter(F.length(text) >= TEXT.min_chars).select(
        *keep, "n_in_page", text.alias("text"), F.length(text).alias("chars"),
        fragment_id(F.col("doc"), F.col("page"), F.col("n_in_page"), text).alias("id"),
    )


def chunk_pages(
    pages: DataFrame, size: int = TEXT.chunk_size, overlap: int = TEXT.chunk_overlap,
    separators: tuple[str, ...] = CHUNK_SEPARATORS,
) -> DataFrame:
    """Fragments of each page by recursive separators; no fragment crosses a page.

    A page may carry its own ``size`` and ``overlap`` columns, which then take precedence.
    """
    own = {"size", "overlap"} <= set(pages.columns)
    keep = [c for c in pages.columns if c != "text"]
    schema = T.StructType([
        *[pages.schema[c] for c in keep], T.StructField("n_in_page", T.IntegerType()),
        T.StructField("fragment", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A batch has a number of rows, whatever their texts weigh; a stretch of it is bounded by bytes.
        for part in (part for rb in batches for part in stretches(rb)):
            sizes = part.column("size").to_pylist() if own else [size] * len(part)
            overlaps = part.column("overlap").to_pylist() if own else [overlap] * len(part)
            cut = [split_text(t or "", int(s), int(o), separators) for t, s, o in zip(part.column("text").to_pylist(), sizes, overlaps)]
            kept = part.select(keep).take(pa.array(np.repeat(np.arange(len(cut)), [len(c) for c in cut])))
            n_in_page = pa.array([i for c in cut for i in range(len(c))], pa.int32())
            yield pa.RecordBatch.from_arrays([*kept.columns, n_in_page, pa.array([f for c in cut for f in c], pa.string())], names=schema.names)

    return _finish(pages.select(*keep, "text").mapInArrow(run, schema), keep)


def fixed_windows(pages: DataFrame, size: int = TEXT.chunk_size, overlap: int = TEXT.chunk_overlap) -> DataFrame:
    """Fragments of a fixed length with a fixed overlap, entirely inside the JVM."""
    keep = [c for c in pages.columns if c != "text"]
    step = size - overlap
    last = F.greatest(F.ceil((F.length("text") - overlap) / F.lit(step)) - 1, F.lit(0))
    raw = pages.select(*keep, "text", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("n_in_page")).withColumn(
        "fragment", F.trim(F.substr(F.col("text"), F.col("n_in_page") * step + 1, F.lit(size)))
    )
    return _finish(raw, keep)


def fragment_summary(chunks: DataFrame) -> DataFrame:
    """Length distribution and pages covered per document, and whether the longest fits the encoder."""
    q = quantiles(chunks, ["doc"], "chars", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    sums = chunks.groupBy("doc").agg(
        F.count("*").alias("fragments"), F.min("chars").alias("chars_min"), F.max("chars").alias("chars_max"),
        rounded(F.avg("chars"), 1).alias("chars_mean"), F.countDistinct("page").alias("pages"),
    )
    return sums.join(q, "doc").select(
        *sums.columns, *[rounded(F.col(c), 0).alias(f"chars_{c}") for c in ("p25", "median", "p75")],
        (F.col("chars_max") / TEXT.chars_per_token > 0.9 * TEXT.token_limit).alias("near_token_limit"),
    )


# ---------------------------------------------------------------- encoding
Encoder = Callable[[list[str]], np.ndarray]

#: Slots of a hashed vector.
SLOTS = 384
#: What parts words: every ASCII character that is neither letter nor digit.
NO_WORD_CHARACTERS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


#: What stands before a text that is searched and before one that asks.
PASSAGE, QUERY = "passage: ", "query: "
#: Vectors that a task holds at a time.
VECTORS_AT_ONCE = 256
#: Words whose slot a task remembers (and those of one stretch more).
KNOWN_WORDS = 200_000


def _placer(slots: int) -> Callable[[pa.Array], np.ndarray]:
    """Slot and sign of each word (twice the slot, and one if the sign is negative); words are remembered."""
    known: dict[bytes, int] = {}

    def place(words: pa.Array) -> np.ndarray:
        if len(known) > KNOWN_WORDS:
            known.clear()
        listed = words.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in listed if w not in known]
        digests = np.frombuffer(b"".join([hashlib.md5(w).digest() for w in new]), np.uint8).reshape(-1, 16)
        at = (np.ascontiguousarray(digests[:, :4]).view(">u4")[:, 0] % slots).astype(np.int64) * 2 + (digests[:, 4] >> 7)
        known.update(zip(new, at.tolist()))
        return np.fromiter(map(known.__getitem__, listed), np.int64, len(listed))

    return place


def word_counts(slots: int = SLOTS) -> Callable[[pa.Array], Iterator[np.ndarray]]:
    """A function from prepared texts (:func:`prepared`) to their signed word counts by slot, some texts at a time."""
    place = _placer(slots)

    def counts(texts: pa.Array) -> Iterator[np.ndarray]:
        for part in stretches(texts):
            words, of_text = byte_words(part, NO_WORD_CHARACTERS)
            coded = words.dictionary_encode()
            at = place(coded.dictionary)[coded.indices.to_numpy()]
            ends = np.append(0, np.cumsum(of_text))
            for lo in range(0, len(part), VECTORS_AT_ONCE):
                hi = min(lo + VECTORS_AT_ONCE, len(part))
                text, here = np.repeat(np.arange(hi - lo, dtype=np.int64), of_text[lo:hi]), at[ends[lo] : ends[hi]]
                flat = np.bincount(text * slots + (here >> 1), weights=1 - 2 * (here & 1), minlength=(hi - lo) * slots)
                yield flat.reshape(hi - lo, slots).astype(np.float64, copy=False)

    return counts


def _word_vectors(unit: bool, slots: int) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """Lower-case texts to lists of signed word counts by slot, or to these divided by their length."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counted = word_counts(slots)

        def lists(counts: np.ndarray) -> pa.Array:
            if unit:
                norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
                counts = np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0)
            values = pa.array((counts if unit else counts.astype(np.int32)).ravel())
            return pa.ListArray.from_arrays(np.arange(len(counts) + 1, dtype=np.int32) * slots, values)

        for texts in batches:
            yield from map(lists, counted(texts))

    return run


def prepared(text: Column, prefix: str) -> Column:
    """What the words of a hashed vector are taken from."""
    return F.lower(F.concat(F.lit(prefix), F.coalesce(text, F.lit(""))))


def hashed(text: Column, prefix: str = "", unit: bool = True, slots: int = SLOTS) -> Column:
    """Signed word counts of a text as a unit vector, or as they are (``unit`` false: the same directions in less space).

    A word's MD5 sum gives its slot (first eight digits) and its sign (ninth). Each text is counted where it is read,
    so nothing is shuffled. The vector of a text without words is zero.
    """
    kind = T.ArrayType(T.DoubleType() if unit else T.IntegerType())
    return arrow_udf(_word_vectors(unit, slots), kind)(prepared(text, prefix))


def hashed_vectors(df: DataFrame, key: str, text: str, prefix: str = "", out: str = "embedding", slots: int = SLOTS) -> DataFrame:
    """``key`` and the :func:`hashed` unit vector of each row."""
    return df.select(key, hashed(F.col(text), prefix, slots=slots).alias(out))


def encode(df: DataFrame, text: str, make_encoder: Callable[[], Encoder], prefix: str = PASSAGE, out: str = "embedding") -> DataFrame:
    """Unit-length vectors of a model. The encoder is made once per task and sees one Arrow batch at a time."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_encoder()
        for s in batches:
            v = np.asarray(model([prefix + (t or "") for t in s]), dtype=np.float32)
            norms = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series(list(v / np.clip(norms, 1e-12, None)))

    return df.withColumn(out, run(F.col(text)))


def encode_passages(df: DataFrame, text: str = "text", make_encoder: Callable[[], Encoder] | None = None, unit: bool = True) -> DataFrame:
    """``df`` with ``embedding``: of a model, or hashed word counts where none is given (of unit length, or as counted)."""
    return _encoded(df, text, PASSAGE, make_encoder, unit)


def encode_queries(df: DataFrame, text: str = "text", make_encoder: Callable[[], Encoder] | None = None, unit: bool = True) -> DataFrame:
    return _encoded(df, text, QUERY, make_encoder, unit)


def _encoded(df: DataFrame, text: str, prefix: str, make_encoder: Callable[[], Encoder] | None, unit: bool) -> DataFrame:
    if make_encoder is not None:
        return encode(df, text, make_encoder, prefix)
    return df.withColumn("embedding", hashed(F.col(text), prefix, unit))
