"""The few text functions without a built-in, in Arrow batches, and what rests on them."""

from __future__ import annotations

import difflib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts; null counts as ''."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


# Words that stand in most names of institutions and tell nothing.
TELL_NOTHING = (
    "university universite universitat universita universidad universiteit universitet universitetet uniwersytet univerzita egyetem panepistimio "
    "institute institut instituto istituto school schule hochschule college centre center centro zentrum research forschung recherche "
    "de of the and et und di der des fur for science sciences technology technologie tecnologia polytechnic national"
)


def name_agrees(wanted: Column, found: Column, city: Column, least: float = 0.65) -> Column:
    """Whether two folded institution names are of one institution; null counts as '', and an empty found never is.

    They are if they have a telling word in common, or telling words of six letters and more that begin alike, or if
    the first holds the second, or if they are similar as wholes. The words of the city tell nothing.
    """
    wanted, found, city = (F.coalesce(c, F.lit("")) for c in (wanted, found, city))
    dull = F.array_union(F.split(F.lit(TELL_NOTHING), " "), F.split(city, " "))
    words = lambda c: F.filter(F.array_except(F.split(c, " "), dull), lambda w: F.length(w) > 2)
    heads = lambda c: F.transform(F.filter(words(c), lambda w: F.length(w) > 5), lambda w: F.substring(w, 1, 6))
    plain = F.arrays_overlap(words(wanted), words(found)) | F.arrays_overlap(heads(wanted), heads(found)) | F.contains(wanted, found)
    # Where the words decide nothing is left to compare: the texts go to Python empty.
    left = lambda c: F.when(~plain, c)
    return (found != "") & (plain | (sequence_ratio(left(wanted), left(found)) >= least))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & masks.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def _letters(texts: list[str]) -> np.ndarray:
    """How often each letter stands in each text; signs that share a bin only raise what two texts can have in common."""
    out = np.zeros((len(texts), 64), dtype=np.int16)
    for i, t in enumerate(texts):
        for c in t:
            out[i, ord(c) % 64] += 1
    return out


def best_partners(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """(id, c, d, s, k): for each row of left the best row of right that shares a word with it, if any.

    left has id, text, country, host and words, right key, text, country, host and words. Equal country comes first (c:
    1 equal, 0 other, -1 unknown), then a host that ends with the other's (d), then the Ratcliff-Obershelp similarity
    (s), then the least key (k). What matches is a common subsequence of a common multiset of letters, so neither
    length falls below it: rows that can't reach the best by these are not compared, and no result changes.
    """
    texts, keys, countries = right["text"].tolist(), right["key"].to_numpy(dtype=np.int64), right["country"].tolist()
    by_word, by_host = defaultdict(list), defaultdict(list)
    for i, (words, host) in enumerate(zip(right["words"], right["host"], strict=True)):
        for w in words:
            by_word[w].append(i)
        if host:
            by_host[host].append(i)
    by_word = {w: np.array(x) for w, x in by_word.items()}
    letters, lengths = _letters(texts), np.array([len(t) for t in texts])
    known = np.array([bool(pd.notna(x)) for x in countries])
    of = np.array([x if k else "" for x, k in zip(countries, known, strict=True)], dtype=object)
    matchers: dict[int, difflib.SequenceMatcher] = {}
    out = []
    for id_, text, country, host, words in left[["id", "text", "country", "host", "words"]].itertuples(index=False):
        met = [by_word[w] for w in words if w in by_word]
        if not met:
            continue
        at = np.unique(np.concatenate(met))
        c = np.where(known[at], (of[at] == country).astype(int), -1) if pd.notna(country) else np.full(len(at), -1)
        at, c = at[c == c.max()], int(c.max())
        ends = [i for j in range(len(host)) for i in by_host.get(host[j:], ())] if isinstance(host, str) else []
        same = at[np.isin(at, ends)]
        d = len(same) > 0
        at = same if d else at
        most = np.minimum(letters[at], _letters([text])[0]).sum(axis=1)
        most = 2.0 * most / np.maximum(1, lengths[at] + len(text))
        s, k = -1.0, 0
        for j in np.lexsort((keys[at], -most)):
            i = int(at[j])
            key, total = int(keys[i]), len(text) + len(texts[i])
            if most[j] < s:
                break
            if (most[j], -key) < (s, -k) or (2.0 * common_length(text, texts[i]) / total, -key) < (s, -k):
                continue
            m = matchers.get(i)
            if m is None:
                m = matchers[i] = difflib.SequenceMatcher(None, "", texts[i])
            m.set_seq1(text)
            s, k = max((s, k), (m.ratio(), key), key=lambda x: (x[0], -x[1]))
        out.append((id_, c, int(d), s, k))
    return pd.DataFrame(out, columns=["id", "c", "d", "s", "k"])
