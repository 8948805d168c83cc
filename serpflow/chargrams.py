"""N-grams of a group's texts as numbers, which are sorted where strings would be hashed one by one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


def numbered(texts: list[str], lo: int, hi: int, words: bool = False) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], list[str]]]:
    """The number of every run of lo to hi characters, or words between spaces, the text it is of, and what turns
    numbers of characters into strings.  Numbers are ordered as the strings are: a space comes before what words hold."""
    parts: list = [t.split() for t in texts] if words else texts
    if words:
        alphabet = sorted(set().union(*parts))
        place = {w: i for i, w in enumerate(alphabet, 1)}
        ids = np.fromiter((place[w] for p in parts for w in p), np.int64, sum(map(len, parts)))
    else:
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        there = np.zeros(0x110000, bool)
        there[points] = True
        alphabet = np.flatnonzero(there)
        place = np.zeros(0x110000, np.int64)
        place[alphabet] = np.arange(1, len(alphabet) + 1)
        ids = place[points]
    bits = int(len(alphabet)).bit_length()
    if bits * hi > 63:
        return _named(parts, lo, hi)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    of, left = np.repeat(np.arange(len(parts)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))
    code, codes, owners = np.zeros(len(ids), np.int64), [], []
    for n in range(1, hi + 1):
        # a shorter string has zeros behind it, and so comes before those that go on
        code[: max(0, len(ids) - n + 1)] |= ids[n - 1 :] << bits * (hi - n)
        if n >= lo:
            codes.append(code[left >= n])
            owners.append(of[left >= n])

    def strings(numbers: np.ndarray) -> list[str]:
        at = (numbers[:, None] >> (bits * np.arange(hi - 1, -1, -1))) & ((1 << bits) - 1)
        ends = np.cumsum((at > 0).sum(1)).tolist()
        flat = alphabet[at[at > 0] - 1].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    return np.concatenate(codes), np.concatenate(owners), strings


def _named(parts: list, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], list[str]]]:
    """numbered(), of texts with so many different characters or words that n-grams don't fit in a number."""
    each = [(t[i : i + n], k) for n in range(lo, hi + 1) for k, t in enumerate(map(tuple, parts) if parts and isinstance(parts[0], list) else parts) for i in range(len(t) - n + 1)]
    names = sorted({g for g, _ in each})
    number = {g: i for i, g in enumerate(names)}
    return np.array([number[g] for g, _ in each], np.int64), np.array([k for _, k in each], np.int64), lambda numbers: [names[i] for i in numbers.tolist()]


def counted(texts: list[str | None], lo: int, hi: int) -> tuple[list[str], np.ndarray]:
    """The different n-grams of all texts, and how often each occurs."""
    codes, _, strings = numbered([t for t in texts if t], lo, hi)
    found, n = np.unique(codes, return_counts=True)
    return strings(found), n


@dataclass(frozen=True)
class Runs:
    """How a group's texts become weighted terms: runs of lo to hi words or characters, how many terms count, 1 +
    ln(count) in place of counts."""

    words: bool
    lo: int
    hi: int
    cap: int | None
    sublinear: bool

    def terms(self, texts: list[str | None], owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Term, owner and count of every term of an owner, terms numbered in order, and how many terms there are."""
        some = [k for k, t in enumerate(texts) if t]
        codes, of, _ = numbered([texts[k] for k in some], self.lo, self.hi, self.words)
        names, term = np.unique(codes, return_inverse=True)
        pair, tf = np.unique(term * owners + owner[some][of], return_counts=True)
        return pair // owners, pair % owners, tf, len(names)

    def weights(self, term: np.ndarray, tf: np.ndarray, n: int, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows have terms that count, and their weights."""
        keep = np.ones(len(term), bool)
        if self.cap is not None and self.cap < len(df):
            counts = np.zeros(len(df), bool)
            counts[np.argsort(-np.bincount(term, tf, len(df)), kind="stable")[: self.cap]] = True
            keep = counts[term]
        tf = tf[keep]
        return keep, (1 + np.log(tf) if self.sublinear else tf) * (np.log((1 + n) / (1 + df[term[keep]])) + 1)

    def sums(self, items: list, texts: list[str | None]) -> tuple[list, np.ndarray, np.ndarray, float]:
        """Items with terms that count, the norm of each, its product with the query (item -1), and the query's norm (0:
        none), of one group.  Rows of one item are one text; each row counts as one of the group."""
        place: dict = {}
        of_row = np.array([place.setdefault(i, len(place)) for i in items], np.int64)
        m, ids, q = len(place), list(place), place.get(-1, -1)
        if not any(texts):
            return [], np.zeros(0), np.zeros(0), 0.0
        term, item, tf, n = self.terms(texts, of_row, m)
        keep, w = self.weights(term, tf, len(items), np.bincount(term, minlength=n))
        term, item = term[keep], item[keep]
        norm = np.sqrt(np.bincount(item, w * w, m))
        asked = np.bincount(term[item == q], w[item == q], n)
        dot = np.bincount(item, w * asked[term], m)
        has = np.flatnonzero(norm > 0)
        return [ids[i] for i in has], norm[has], dot[has], float(norm[q]) if q >= 0 else 0.0

    def vectors(self, items: list, whole: list[str | None], texts: list[str | None], threshold: float) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """Item, term, part of the unit vector and whether its prefix holds it, for terms of several different texts
        (whole) of one group; n-grams come from texts.  The smallest item stands for copies, and all of them count."""
        copies: dict = {}
        for i, t, x in zip(items, whole, texts):
            least, k, _ = copies.get(t, (None, 0, None))
            copies[t] = (i if least is None or (i is not None and i < least) else least, k + 1, x)
        if not any(texts):
            return [], np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
        units: dict = {}
        owner = np.array([units.setdefault((i, k), len(units)) for i, k, _ in copies.values()], np.int64)
        ids: dict = {}
        item_of = np.array([ids.setdefault(i, len(ids)) for i, _ in units], np.int64)
        times = np.array([k for _, k in units], np.int64)
        term, unit, tf, n = self.terms([x for _, _, x in copies.values()], owner, len(units))
        df = np.bincount(term, times[unit], n)
        keep, w = self.weights(term, tf, len(items), df)
        shared = np.bincount(term, minlength=n) > 1
        term, item = term[keep], item_of[unit[keep]]
        norm = np.sqrt(np.bincount(item, w * w, len(ids)))
        keep = shared[term]
        term, item, w = term[keep], item[keep], w[keep]
        order = np.lexsort((-term, -df[term], item))
        term, item, u = term[order], item[order], (w / norm[item])[order]
        run = np.cumsum(u * u)
        first = np.r_[True, item[1:] != item[:-1]][: len(item)]
        run -= np.maximum.accumulate(np.where(first, np.r_[0.0, run[:-1]][: len(run)], 0.0))
        names = list(ids)
        return [names[i] for i in item], term, u, run >= threshold * threshold - 1e-9


def repeated(key: tuple[pa.Scalar, ...], n: int) -> list[pa.Array]:
    """A group's key, once for each of n rows."""
    return [pa.array([k.as_py()] * n, k.type) for k in key]
