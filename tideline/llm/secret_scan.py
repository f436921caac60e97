"""Secret scans: base patterns, and a randomness test battery for strings of unknown form.

A candidate is a long run of the characters that encoded bytes consist of. Its encoding
is inferred from its characters; under the hypothesis that the string is uniform over
that alphabet a chi-squared test, a runs test and a serial-correlation test each give a
p-value, and these are combined. Random strings have p-values spread evenly from 0 to 1,
words and other text have theirs near 0. For each encoding and class of length the
corpus therefore tells how many candidates above a cut are not random, and the smallest
cut that keeps the share of such false discoveries under a bound is used.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tideline.llm.storage import materialize
from tideline.llm.text import hashes, pieces, row_of, tokens, utf8

# Fixed values of the contract: kinds in order, patterns, least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Shortest candidate of the test battery.
LEAST_RANDOM = 20
FALSE_DISCOVERIES = 0.05
#: Of a stratum's candidates, so many must be random for any to count.
LEAST_SHARE = 0.2
LENGTH_CLASSES = (24, 32, 40, 64, 128)
BINS = 50


def _table(pattern: str) -> np.ndarray:
    return np.array([re.match(pattern, chr(i)) is not None and i < 128 for i in range(256)])


_SEPARATOR = _table(r"[:=]")
_HEX = _table(r"[0-9a-f]").astype(np.uint8)
_ENCODED = _table(r"[A-Za-z0-9+/_=-]").astype(np.uint8)
#: Alphabets from narrow to wide: name, characters in code order.
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = [
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("hex_upper", "0123456789ABCDEF"),
    ("lower", _LETTERS),
    ("upper", _LETTERS.upper()),
    ("base32", _LETTERS.upper() + "234567"),
    ("base36", "0123456789" + _LETTERS),
    ("base36_upper", "0123456789" + _LETTERS.upper()),
    ("letters", _LETTERS.upper() + _LETTERS),
    ("base62", _LETTERS.upper() + _LETTERS + "0123456789"),
    ("base64", _LETTERS.upper() + _LETTERS + "0123456789+/"),
    ("base64_url", _LETTERS.upper() + _LETTERS + "0123456789-_"),
]
_SIZES = np.array([len(a) for _, a in ALPHABETS])
_CODES = np.full((len(ALPHABETS), 256), -1, np.int64)
for _i, (_, _alphabet) in enumerate(ALPHABETS):
    _CODES[_i, [ord(c) for c in _alphabet]] = np.arange(len(_alphabet))
#: For each byte the set of alphabets that have it, as bits.
_MEMBER = ((_CODES >= 0) * (1 << np.arange(len(ALPHABETS)))[:, None]).sum(0)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(found)


def _two_sided(z: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(abs(x) / math.sqrt(2)) for x in z])


def battery(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string the place of its encoding in ALPHABETS (-1: none fits), and the combined p-value."""
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    which = np.repeat(np.arange(len(starts)), lengths)
    chars = data[np.arange(int(lengths.sum())) - np.repeat(first, lengths) + np.repeat(starts, lengths)]
    padding = chars == ord("=")
    member = np.bitwise_and.reduceat(np.where(padding, (1 << len(ALPHABETS)) - 1, _MEMBER[chars]), first)
    encoding = np.where(member > 0, np.log2(np.maximum(1, member & -member)).astype(np.int64), -1)
    good = ~padding & (encoding[which] >= 0)
    which, chars = which[good], chars[good]
    code = _CODES[encoding[which], chars]
    n, a = np.bincount(which, minlength=len(starts)).astype(float), _SIZES[encoding].astype(float)
    n = np.maximum(n, 2)
    # Chi-squared for uniformity, by its exact mean and variance, as expected counts are small.
    counts = np.bincount(which * 64 + code, minlength=64 * len(starts)).reshape(-1, 64)
    chi = (counts.astype(float) ** 2).sum(1) * a / n - n
    z_chi = (chi - (a - 1)) / np.sqrt(2 * (a - 1) * (n - 1) / n)
    # Runs of codes in the lower and the upper half of the alphabet: given the halves' sizes.
    same = which[1:] == which[:-1]
    high = code >= a[which] / 2
    runs = 1 + np.bincount(which[1:][same & (high[1:] != high[:-1])], minlength=len(starts))
    up = np.bincount(which, high, len(starts))
    down = n - up
    mean = 1 + 2 * up * down / n
    variance = np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9)
    z_runs = np.where(up * down > 0, (runs - mean) / np.sqrt(variance), np.sqrt(n))
    # Correlation of each code with the next.
    centred = (code - (a[which] - 1) / 2) / np.sqrt((a[which] ** 2 - 1) / 12)
    z_serial = np.bincount(which[1:][same], (centred[1:] * centred[:-1])[same], len(starts)) / np.sqrt(n - 1)
    p = np.stack([_two_sided(z_chi), _two_sided(z_runs), _two_sided(z_serial)])
    # Cauchy combination: holds for dependent tests.
    t = np.tan((0.5 - np.clip(p, 1e-12, 1 - 1e-12)) * np.pi).mean(0)
    return encoding, np.clip(0.5 - np.arctan(t) / np.pi, 0, 1)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    candidate = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("p", pa.float64()), ("string", pa.int64())]))
    for batch in batches:
        text = batch.column("text")
        data, offsets = utf8(text)
        for i, j in pieces(offsets):
            at = offsets[i : j + 1]
            low = int(at[0])
            piece = data[low : int(at[-1])]
            # Rows that a base pattern may match: those with a separator, AKIA or long hexadecimal runs.
            separators = np.searchsorted(at, np.flatnonzero(_SEPARATOR[piece]) + low, "right") - 1
            s, e, pointer = tokens(data, at, _HEX)
            may = np.bincount(separators, minlength=j - i) > 0
            may |= np.bincount(row_of(pointer)[e - s >= LEAST["hex"]], minlength=j - i) > 0
            s, e, pointer = tokens(data, at, _ENCODED)
            rows = row_of(pointer)
            long = e - s >= LEAST_RANDOM
            s, e, rows = s[long], e[long], rows[long]
            encoding, p = battery(data, s, e) if len(s) else (np.zeros(0, int), np.zeros(0))
            may[rows] = True  # AKIA keys of 20 characters stand in such runs
            points = np.concatenate([[0], np.cumsum((piece & 0xC0) != 0x80)])
            cs, ce = points[s - low] - points[at[rows] - low], points[e - low] - points[at[rows] - low]
            string = hashes(data, s, e).view(np.int64)
            stratum = encoding * (len(LENGTH_CLASSES) + 1) + np.searchsorted(LENGTH_CLASSES, e - s, "right")
            base: list[list[tuple]] = [[] for _ in range(j - i)]
            extra: list[list[tuple]] = [[] for _ in range(j - i)]
            for r in np.flatnonzero(may):
                base[r] = base_spans(text[i + int(r)].as_py() or "")
            for k in np.flatnonzero(encoding >= 0):
                r = rows[k]
                if not any(x[0] < ce[k] and cs[k] < x[2] for x in base[r]):
                    extra[r].append({"start": int(cs[k]), "end": int(ce[k]), "stratum": int(stratum[k]), "p": float(p[k]), "string": int(string[k])})
            digest = [hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in x).encode()).hexdigest() for x in base]
            counts = [pa.array([sum(y[1] == k for y in x) for x in base], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), *counts, pa.array(digest, pa.string()), pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in x] for x in base], span), pa.array(extra, candidate)],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "candidates"],
            )


def cuts(histogram: list[tuple[int, int, int]], bound: float = FALSE_DISCOVERIES) -> dict[int, float]:
    """(stratum, bin of p, count) to the least p-value at which the stratum's discoveries count.

    Random strings fill the bins evenly, so those of the upper half give their number;
    what lies above a cut beyond that is not random. Strata without such a cut are left out,
    and those where random strings would be few: there the tail of the others decides.
    """
    counts: dict[int, np.ndarray] = {}
    for stratum, b, n in histogram:
        counts.setdefault(stratum, np.zeros(BINS))[b] += n
    found = {}
    for stratum, n in counts.items():
        random = 2 * n[BINS // 2 :].sum()
        if random < LEAST_SHARE * n.sum():
            continue
        above = n[::-1].cumsum()[::-1]
        passing = [b for b in range(1, BINS // 2) if random * (BINS - b) / BINS >= (1 - bound) * above[b] > 0]
        if passing:
            found[stratum] = passing[0] / BINS
    return found


def secrets(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row for each input row.

    base_sha256 is over the base spans, spans lists these and those that the test battery
    adds (kind random), each kind:start:end in code points, by start, then kind. Null and
    empty texts have no spans: counts 0, an empty list and the digest of no bytes. An
    assign span is the whole match.
    """
    kept = materialize(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scan,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:long,kind:int,end:long>>, candidates array<struct<start:long,end:long,stratum:int,p:double,string:long>>",
    ))
    # Copies of a string count once.
    each = kept.select(F.explode("candidates").alias("c")).select("c.stratum", "c.string", "c.p").groupBy("stratum", "string").agg(F.first("p").alias("p"))
    each = each.select("stratum", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    # At most alphabets x length classes x bins rows.
    limits = cuts([tuple(r) for r in each.groupBy("stratum", "bin").count().collect()])
    return kept.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", _spans(limits).alias("spans"))


def _spans(limits: dict[int, float]) -> Column:
    def passes(c: Column) -> Column:
        out = F.lit(False)
        for stratum, p in sorted(limits.items()):
            out = out | ((c["stratum"] == stratum) & (c["p"] >= p))
        return out

    added = F.transform(F.filter("candidates", passes), lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), c["end"].alias("end")))
    names = F.array(*[F.lit(k) for k in (*KINDS, "random")])
    return F.array_join(F.transform(F.array_sort(F.concat("base", added)), lambda c: F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["start"], c["end"])), ",")
