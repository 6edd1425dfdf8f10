"""Text repair and canonical forms as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from almenara.settings import (
    CANONICAL_CATEGORIES, EMPTY_CATEGORY_WORDS, NO_CATEGORY, UNKNOWN_STATE,
)

# Fixed value: the signatures of UTF-8 text that was decoded as Latin-1.
MOJIBAKE = "Ã[\u0080-¿]|Â[\u0080-¿]|â€|ï»¿|�"

# Accented Latin letters and their base letter, for engines without Unicode decomposition.
ACCENTED = "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "AAAAAAEEEEIIIIOOOOOUUUUNCY"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_spaces(col: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(col), r"[\s\u0085 ]+", " "))


#: Bytes of texts that a Python task works on at a time.
STRETCH_BYTES = 1 << 20


def stretches(rows: pa.Array | pa.RecordBatch, most: int | None = None) -> Iterator[pa.Array | pa.RecordBatch]:
    """Arrow rows in stretches of about ``STRETCH_BYTES`` and at most ``most`` rows, without a copy."""
    step = max(1, len(rows) * STRETCH_BYTES // max(rows.nbytes, 1))
    step = min(step, most or step)
    for lo in range(0, len(rows), step):
        yield rows.slice(lo, step)


def byte_words(texts: pa.Array, parting: str) -> tuple[pa.Array, np.ndarray]:
    """Runs of characters that are not in ``parting`` (ASCII), as bytes, of all texts in their order, and how many each text has."""
    wide = texts.cast(pa.large_string())
    _, ends, data = wide.buffers()
    at = np.frombuffer(ends, np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    stretch = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    of_word = np.ones(256, bool)
    of_word[list(parting.encode("ascii"))] = False
    inside = of_word[stretch]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = at[:-1][at[:-1] < len(stretch)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first[inside])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, inside.sum()).astype(np.int64)), pa.py_buffer(stretch[inside])])
    return words, np.diff(np.searchsorted(np.flatnonzero(first), at))


def _normaliser(form: str, drop_marks: bool = False):
    def plain(text: str | None) -> str | None:
        if text is None:
            return None
        done = unicodedata.normalize(form, text)
        return "".join(c for c in done if unicodedata.category(c) != "Mn") if drop_marks else done

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in (part for texts in batches for part in stretches(texts)):
            yield pa.array([plain(t) for t in part.to_pylist()], pa.string())

    return arrow_udf(run, StringType())


_nfc = _normaliser("NFC")
_nfkc = _normaliser("NFKC")
_unmarked = _normaliser("NFD", drop_marks=True)
_ASCII = r"^[\x00-\x7f]*$"


def _only_where_needed(col: Column, udf) -> Column:
    """ASCII text is its own normal form; only the rest travels to Python."""
    return F.when(col.isNull() | col.rlike(_ASCII), col).otherwise(udf(F.when(~col.rlike(_ASCII), col)))


def nfc(col: Column | str) -> Column:
    return _only_where_needed(_col(col), _nfc)


def nfkc(col: Column | str) -> Column:
    return _only_where_needed(_col(col), _nfkc)


def has_mojibake(col: Column | str) -> Column:
    return F.coalesce(_col(col).rlike(MOJIBAKE), F.lit(False))


def repair_mojibake(col: Column | str) -> Column:
    """Undo a UTF-8 text read as Latin-1, where that is possible and removes every signature."""
    c = _col(col)
    latin = c.rlike("^[\u0000-ÿ]*$")
    raw = F.encode(F.when(latin, c), "ISO-8859-1")
    fixed = F.when(latin & F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    return F.when(fixed.isNotNull() & ~fixed.rlike(MOJIBAKE), fixed).otherwise(c)


def clean_text(col: Column | str) -> Column:
    """Single spaces and composed characters."""
    return nfc(collapse_spaces(col))


def canonical_category(col: Column | str) -> Column:
    """``<roman>-<level>`` if the cleaned text is a known category, else the no-category label."""
    word = F.upper(F.trim(_col(col)))
    dashed = F.regexp_replace(F.translate(word, "–—", "--"), r"[\s.]+", "-")
    dashed = F.trim(F.regexp_replace(dashed, "-{2,}", "-"))
    dashed = F.regexp_replace(dashed, "^-|-$", "")
    dashed = F.regexp_replace(dashed, "^(I{1,3})([12E])$", "$1-$2")
    known = ~word.isin(*EMPTY_CATEGORY_WORDS) & dashed.isin(*CANONICAL_CATEGORIES)
    return F.when(known, dashed).otherwise(NO_CATEGORY)


def canonical_state(col: Column | str) -> Column:
    state = collapse_spaces(F.upper(_col(col)))
    return F.coalesce(F.nullif(state, F.lit("")), F.lit(UNKNOWN_STATE))


def text_key(col: Column | str) -> Column:
    """Upper case without accents and spare spaces; NULL gives the empty text."""
    upper = F.coalesce(collapse_spaces(F.upper(_col(col))), F.lit(""))
    return collapse_spaces(_only_where_needed(upper, _unmarked))


def latin_key(col: Column | str) -> Column:
    """:func:`text_key` for Latin letters only, entirely inside the JVM."""
    return F.coalesce(collapse_spaces(F.translate(F.upper(_col(col)), ACCENTED, PLAIN)), F.lit(""))


def glued_words(col: Column | str) -> Column:
    """Number of long words in which a capital follows a lower-case letter."""
    return F.size(F.filter(
        words(col), lambda w: (F.length(w) > 6) & w.rlike(r"\p{Ll}\p{Lu}")
    ))


BLANKS = " \t\n\x0b\f\r"


def words(col: Column | str) -> Column:
    """Tokens between ASCII white space; none for blank text."""
    t = F.btrim(_col(col), F.lit(BLANKS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"[{BLANKS}]+"))
