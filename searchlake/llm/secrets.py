"""Secret scans by sliding-window entropy."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts, words

#: PART: windows of a long span that are counted one after the other.
MIN_LENGTH, WINDOW, PART = 20, 20, 1024
#: Bits per character that some window must reach, by class of characters.
LIMITS = {"hex": 2.8, "base64": 3.9}
#: The same for pieces of a run that is not reported whole; random keys of 20 characters reach them.
PIECES = {"hex": 2.8, "alnum": 3.3, "base64": 3.6}
#: Candidates that are no secrets: whole matches of any of these.
ALLOW = (
    r"\d+",
    r"[A-Za-z]+",
    r"[A-Za-z]+([_\-/.=+][A-Za-z]+)+",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(0123456789)?(abcdefghijklmnopqrstuvwxyz|ABCDEFGHIJKLMNOPQRSTUVWXYZ)+(0123456789)?",
    r"(deadbeef|DEADBEEF|0123456789abcdef|0123456789ABCDEF)+",
)

_MEMBER = np.zeros(256, bool)
_MEMBER[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"]] = True
_HEX = re.compile(rb"[0-9a-f]+|[0-9A-F]+")
_ONE_CASE = re.compile(rb"[0-9a-z]+|[0-9A-Z]+")
_MIXED = re.compile(rb"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]+")
#: Pieces that are words with a number.
_NUMBERED = re.compile(rb"[A-Za-z]+[0-9]+|[0-9]+[A-Za-z]+")


def kind_of(x: bytes, min_length: int, allowed: re.Pattern | None) -> str | None:
    """The class by which a piece of a run is judged, None where it is no candidate."""
    if len(x) < min_length or (allowed and allowed.fullmatch(x)):
        return None
    if _HEX.fullmatch(x):
        return "hex"
    if _NUMBERED.fullmatch(x):
        return None
    return "alnum" if _ONE_CASE.fullmatch(x) else "base64" if _MIXED.fullmatch(x) else None


def pieces(run: bytes, min_length: int, allowed: re.Pattern | None) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of what may be keys: for each value between the = of a run first the whole, where that may be one, then what is there between any +/_-."""
    out = []
    for value in re.finditer(rb"[^=]+", run):
        spans = [value.span(), *((value.start() + m.start(), value.start() + m.end()) for m in re.finditer(rb"[A-Za-z0-9]+", value[0]) if m.span() != (0, len(value[0])))]
        out.append([(a, b, kind) for a, b in spans if (kind := kind_of(run[a:b], min_length, allowed))])
    return out


def best_entropy(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The highest Shannon entropy of any window of each span, from counts that change by one character at each step.

    Long spans are cut into parts that overlap by all but one character of a window, so that all
    windows are there and the number of steps is bounded.
    """
    count = np.maximum(1, -(-(ends - starts - window + 1) // PART))
    owner = np.repeat(np.arange(len(starts)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    a = starts[owner] + nth * PART
    best = _best_entropy(data, a, np.minimum(ends[owner], a + PART + window - 1), window)
    out = np.full(len(starts), -1.0)
    np.maximum.at(out, owner, best)
    return out


def _best_entropy(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    order = np.argsort(starts - ends, kind="stable")  # longest first, so that those still running are a prefix
    s, n = starts[order], (ends - starts)[order]
    size = np.minimum(n, window)
    counts = np.zeros((len(s), 128), np.int16)
    c = np.arange(window + 2, dtype=np.float64)
    term = c * np.log2(np.maximum(c, 1))
    total, best = np.zeros(len(s)), np.zeros(len(s))
    for t in range(int(n[0]) if len(n) else 0):
        a = int(np.searchsorted(-n, -t, side="left"))
        at = np.arange(a)
        new = data[s[:a] + t] & 127
        was = counts[at, new]
        total[:a] += term[was + 1] - term[was]
        counts[at, new] = was + 1
        if t >= window:
            old = data[s[:a] + t - window] & 127
            was = counts[at, old]
            total[:a] += term[was - 1] - term[was]
            counts[at, old] = was - 1
        if t + 1 >= window:
            best[:a] = np.maximum(best[:a], np.log2(size[:a]) - total[:a] / size[:a])
        else:
            done = np.flatnonzero(n[:a] == t + 1)
            best[done] = np.log2(size[done]) - total[done] / size[done]
    out = np.empty(len(s))
    out[order] = best
    return out


def find_secrets(docs: DataFrame, min_length: int = MIN_LENGTH, limits: dict = LIMITS, allow: tuple = ALLOW, window: int = WINDOW, piece_limits: dict = PIECES) -> DataFrame:
    """(doc_id, start, length, kind, entropy): runs of letters, digits and +/=_- that look like keys.

    A run of at least min_length characters is of kind hex, if all are hexadecimal digits of one
    case, else base64; it is reported where some window of it reaches the kind's limit and no
    pattern of allow matches the whole of it. Of other runs, the values between = are judged by
    themselves, and what stands between +/_- in them: as hex, alnum (one case) or base64 (both
    cases and digits), with the limits of piece_limits; allow, and words with a number before or
    behind, are left out there too. start counts characters from 0. Null and empty texts and empty
    tables give nothing; repeated rows give their runs once for each row; a run of any length is
    scanned whole; entropies at a limit count. Other columns, of whatever name, are not looked at.
    """
    allowed = re.compile("|".join(f"(?:{x})" for x in allow).encode()) if allow else None

    def run(batch):
        for lo, _, data, offs in texts(batch.column(1)):
            s, e, row_offs = words(data, offs, _MEMBER)
            long = np.flatnonzero(e - s >= min_length)
            if not len(long):
                continue
            raw = data.tobytes()
            keep = [k for k in long.tolist() if not (allowed and allowed.fullmatch(raw, s[k], e[k]))]
            if not keep:
                continue
            keep = np.array(keep)
            s, e, row = s[keep], e[keep], np.searchsorted(row_offs, keep, side="right") - 1
            kind = np.array(["hex" if _HEX.fullmatch(raw, a, b) else "base64" for a, b in zip(s.tolist(), e.tolist())])
            bits = np.round(best_entropy(data, s, e, window), 4)
            good = bits >= np.array([limits[x] for x in kind])
            tries = [(k, n, s[k] + x, s[k] + y, name) for k in np.flatnonzero(~good).tolist() for n, own in enumerate(pieces(raw[s[k] : e[k]], min_length, allowed)) for x, y, name in own]
            more, whole = [], None
            if tries:
                found = np.round(best_entropy(data, np.array([t[2] for t in tries]), np.array([t[3] for t in tries]), window), 4).tolist()
                for (k, n, x, y, name), h in zip(tries, found):
                    if h >= piece_limits[name] and not (whole and whole[:2] == (k, n) and x >= whole[2] and y <= whole[3]):
                        more.append((x, y, row[k], name, h))
                        if whole is None or whole[:2] != (k, n):
                            whole = k, n, x, y
            s, e, row, kind, bits = s[good], e[good], row[good], kind[good], bits[good]
            if more:
                s, e, row, kind, bits = (np.concatenate([a, np.array(b)]) for a, b in zip((s, e, row, kind, bits), zip(*more)))
            if not len(s):
                continue
            chars = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
            cols = [batch.column(0).take(pa.array(row + lo)), pa.array(chars[s] - chars[offs[row]]), pa.array(e - s, pa.int32()), pa.array(kind.tolist(), pa.string()), pa.array(bits)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "kind", "entropy"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, start bigint, length int, kind string, entropy double")


ORACLE = r"""
WITH c AS (
  SELECT doc_id, unnest(range(length(text))) AS i, unnest(string_split(text, '')) AS ch FROM documents
  WHERE regexp_matches(text, '[A-Za-z0-9+/=_-]{20,}')
), m AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM c WHERE regexp_full_match(ch, '[A-Za-z0-9+/=_-]')
), r AS (
  SELECT doc_id, min(i) AS start, count(*) AS n, string_agg(ch, '' ORDER BY i) AS run FROM m GROUP BY doc_id, island HAVING count(*) >= 20
), k AS (
  SELECT *, CASE WHEN regexp_full_match(run, '[0-9a-f]+|[0-9A-F]+') THEN 'hex' ELSE 'base64' END AS kind FROM r
  WHERE NOT regexp_full_match(run, '[0-9]+|[A-Za-z]+|[A-Za-z]+([_/.=+-][A-Za-z]+)+|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|(0123456789)?(abcdefghijklmnopqrstuvwxyz|ABCDEFGHIJKLMNOPQRSTUVWXYZ)+(0123456789)?|(deadbeef|DEADBEEF|0123456789abcdef|0123456789ABCDEF)+')
), w AS (
  SELECT doc_id, start, n, kind, o, substr(run, CAST(o + 1 AS BIGINT), 20) AS win FROM (SELECT *, unnest(range(n - 19)) AS o FROM k)
), f AS (
  SELECT doc_id, start, n, kind, o, ch, count(*) AS q FROM (SELECT *, unnest(string_split(win, '')) AS ch FROM w) GROUP BY ALL
), h AS (SELECT doc_id, start, n, kind, o, log2(20) - sum(q * log2(q)) / 20 AS bits FROM f GROUP BY ALL
), b AS (SELECT doc_id, start, n, kind, round(max(bits), 4) AS entropy FROM h GROUP BY ALL)
SELECT doc_id, start, CAST(n AS INTEGER) AS length, kind, entropy FROM b WHERE entropy >= CASE kind WHEN 'hex' THEN 2.8 ELSE 3.9 END
"""
