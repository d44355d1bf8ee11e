"""Text normalisation as column expressions: accent folding and the six folds that names, titles and places need.

Spark has no Unicode normaliser, so a translation table of the single-character decompositions is generated once from
unicodedata; combining marks are then dropped.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that have no decomposition but an accepted plain spelling.
PLAIN_LETTERS = {"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ı": "i", "ħ": "h", "ŋ": "n"}
# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝкмтнвαεορτυχικνβ", "aeopcyxijshdqwkmthbaeoptuxiknb", strict=True))
# What code page 1252 shows for the bytes 0x80 to 0x9f.
_CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_CP1252_BYTES = "".join(chr(b.encode("cp1252")[0]) for b in _CP1252)


@lru_cache(maxsize=1)
def _table() -> tuple[str, str]:
    source, target = [], []
    for start, stop in ((0x00A0, 0x0250), (0x0370, 0x0400), (0x0400, 0x0530), (0x1E00, 0x2000)):
        for c in map(chr, range(start, stop)):
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if len(plain) == 1 and plain != c:
                source.append(c)
                target.append(plain)
    return "".join(source), "".join(target)


def strip_accents(c: Column) -> Column:
    """c without diacritics: letters that decompose lose their marks, others stay."""
    return F.regexp_replace(F.translate(c, *_table()), r"\p{M}+", "")


def plain_letters(c: Column) -> Column:
    """Replaces letters without a decomposition, such as ø and ß; for lower-case text."""
    single = {k: v for k, v in PLAIN_LETTERS.items() if len(v) == 1}
    c = F.translate(c, "".join(single), "".join(single.values()))
    for k, v in PLAIN_LETTERS.items():
        if len(v) > 1:
            c = F.replace(c, F.lit(k), F.lit(v))
    return c


def mend_encoding(c: Column) -> Column:
    """UTF-8 that was read as Latin-1 or code page 1252, put right; other text unchanged."""
    bytes_ = F.translate(c, _CP1252, _CP1252_BYTES)
    suspect = c.rlike("[Â-ô][\u0080-¿" + _CP1252 + "]") & bytes_.rlike("^[\\x{0}-\\x{ff}]*$")
    mended = F.try_validate_utf8(F.encode(bytes_, "ISO-8859-1").cast("string"))
    return F.when(suspect, F.coalesce(mended, c)).otherwise(c)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fold_words(c: Column) -> Column:
    """Lower-case words of plain letters and digits, one blank between them; for matching across spellings."""
    c = plain_letters(strip_accents(F.lower(mend_encoding(F.coalesce(c, F.lit(""))))))
    return squeeze(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))
