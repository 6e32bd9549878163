"""Texts over a token limit, cut into overlapping pieces at natural boundaries.

Dynamic programming over the boundaries of a text finds the cuts that cost
least: each boundary has a penalty (none between paragraphs, more between
sentences, clauses and words, most inside a word), and each piece pays for
being shorter than it could be if all were alike.  No piece has more tokens
than the limit, the overlap included.

A text of at most as many bytes as the limit has no more tokens than that,
since every token of a byte-level vocabulary has at least one byte; only
longer ones are encoded.

Defined results: null, empty and short texts are one piece (none if null or
empty); a text with no boundary is cut between characters; where the token
128 before a cut begins inside a character, the overlap begins with that
character.  Rows with one id are copies.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from fedsql.llm.tokens import counter

PIECES = "doc_id bigint, piece_no int, n_pieces int, start_char bigint, end_char bigint, n_tokens int, overlap_tokens int"
#: Penalty of a cut before the position that the pattern ends at.
BOUNDARIES = ((re.compile(r"\n\s*\n\s*"), 0.0), (re.compile(r"\n\s*"), 0.1), (re.compile(r"[.!?]+[\"')\]]*\s+|[。！？]+[”’）]*"), 0.2), (re.compile(r"[;:,]\s+|[；：，、]"), 0.6), (re.compile(r"\s+"), 1.2))
ANYWHERE = 4.0
IMBALANCE = 4.0


def boundaries(text: str) -> np.ndarray:
    """The penalty of a cut at each character position, infinity where there is no boundary."""
    out = np.full(len(text) + 1, np.inf)
    for pattern, penalty in reversed(BOUNDARIES):  # the lowest stays
        out[[m.end() for m in pattern.finditer(text)]] = penalty
    return out


def least_fees(at: np.ndarray, after: np.ndarray, fee: np.ndarray, room: int) -> tuple[list[float], float]:
    """The least sum of penalties from each place to the end, and from the beginning; infinity where pieces don't fit."""
    last, fees = len(at) - 1, fee.tolist()
    reach = (np.searchsorted(at, after + room, side="right") - 1).tolist()
    left = [np.inf] * last + [0.0]
    near: deque[int] = deque()  # places to go to next: the cheapest is the last of them

    def enter(k: int) -> None:
        v = fees[k] + left[k]
        while near and fees[near[0]] + left[near[0]] >= v:
            near.popleft()
        near.appendleft(k)

    for k in range(last - 1, -1, -1):
        enter(k + 1)
        while near and near[-1] > reach[k]:
            near.pop()
        if near:
            left[k] = fees[near[-1]] + left[near[-1]]
    enter(0)
    first = int(np.searchsorted(at, room, side="right")) - 1
    while near and near[-1] > first:
        near.pop()
    return left, fees[near[-1]] + left[near[-1]] if near else np.inf


def cuts(n: int, places: np.ndarray, penalties: np.ndarray, room: int, begins: np.ndarray, least: int) -> tuple[list[int] | None, float]:
    """Token positions to cut at and their cost, or None and infinity if the places do not suffice.

    ``places``: allowed positions in order, 0 < p < n; ``begins``: for each, where the piece after it starts
    (its overlap included); ``room``: tokens in a piece; ``least``: the number of pieces aimed at.

    The dynamic program looks for ways that cost at most ``spare`` more than the least penalties alone: only pieces
    near the length aimed at, and places from which the rest can stay below, come into them.  A way found so is the
    cheapest of all; where there is none, ``spare`` grows.
    """
    aim = (n + (least - 1) * (places - begins).max(initial=0)) / least
    at, after, fee = np.concatenate([places, [n]]), np.concatenate([begins, [n]]), np.concatenate([penalties, [0.0]])
    left, base = least_fees(at, after, fee, room)
    if not np.isfinite(base):
        return None, np.inf
    spare = 0.25
    while True:
        found, total = _within(at, after, fee, room, aim, left, base + spare + 1e-9, spare)
        if total <= base + spare + 1e-9:
            return found, total
        spare *= 4


def _within(at: np.ndarray, after: np.ndarray, fee: np.ndarray, room: int, aim: float, left: list[float], most: float, spare: float) -> tuple[list[int] | None, float]:
    scale = IMBALANCE**0.5 / room
    off = spare**0.5 / scale + 1e-6  # tokens that a piece may differ from the aim
    longest, shortest = min(room, aim + off), max(0.0, aim - off)
    # the ways so far that are worth going on: where their next piece starts, their cost, the place they end at; all from the beginning
    start, cost, place = np.zeros(len(at) + 1), np.zeros(len(at) + 1), np.full(len(at) + 1, -1)
    come = np.full(len(at), -2)
    ways, low, high, total = 1, 0, 0, np.inf
    for k, (end, own, rest) in enumerate(zip(at.tolist(), fee.tolist(), left)):
        while low < ways and start[low] < end - longest:
            low += 1
        while high < ways and start[high] <= end - shortest:
            high += 1
        if low >= high:
            total = np.inf
            continue
        d = (end - aim - start[low:high]) * scale
        d *= d
        d += cost[low:high]
        j = int(d.argmin())
        total = float(d[j]) + own
        if total + rest <= most:
            come[k] = place[low + j]
            start[ways], cost[ways], place[ways] = after[k], total, k
            ways += 1
    if come[-1] == -2:
        return None, np.inf
    out, k = [], come[-1]
    while k >= 0:
        out.append(int(at[k]))
        k = come[k]
    return out[::-1], total


def split_text(text: str, vocabulary: str, limit: int = 4096, overlap: int = 128) -> list[tuple[int, int, int, int]]:
    """(start character, end character, tokens, tokens of overlap) of each piece."""
    if not text:
        return []
    c = counter(vocabulary)
    raw = text.encode("utf-8", "replace")
    if len(raw) <= limit:
        return [(0, len(text), c.count(text), 0)]
    if (total := c.count(text)) <= limit:
        return [(0, len(text), total, 0)]
    ids = np.array(c.encode(text))
    n = len(ids)
    ends = np.cumsum(c.widths[ids])  # byte position after each token
    begin = np.concatenate([[0], ends])
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    chars = np.concatenate([np.cumsum(lead) - lead, [len(text)]])  # byte -> character it belongs to or begins
    whole = np.concatenate([lead, [True]])
    aligned = whole[np.minimum(begin, len(raw))]
    # where the piece after a cut starts: `overlap` tokens back, further to the character's first token
    back = np.maximum.accumulate(np.where(aligned, np.arange(n + 1), 0))
    starts = back[np.maximum(np.arange(n + 1) - overlap, 0)]
    natural = boundaries(text)
    char_at = chars[np.minimum(begin, len(raw))]
    every = np.flatnonzero(aligned[1:n]) + 1
    least = -(-(n - overlap) // (limit - overlap))
    places = None
    fees = np.minimum(natural[char_at[every]], ANYWHERE)
    levels = sorted({fee for _, fee in BOUNDARIES} | {ANYWHERE})
    for level, finer in zip(levels[2:], [*levels[3:], np.inf]):
        p = every[fees <= level]
        places, cost = cuts(n, p, fees[fees <= level], limit, starts[p], least)
        if cost <= finer + (least - 2) * fees.min(initial=ANYWHERE):  # what any way with a finer cut costs at least
            break
    if places is None:
        raise ValueError("a character takes more tokens than a piece may have")
    out, at = [], 0
    for k, e in enumerate([*places, n]):
        s = int(starts[at]) if k else 0
        out.append((int(char_at[s]), int(char_at[e]) if e < n else len(text), e - s, at - s))
        at = e
    return out


def split_documents(docs: DataFrame, vocabulary: str, limit: int = 4096, overlap: int = 128) -> DataFrame:
    """:data:`PIECES` of ``docs``(doc_id, text)."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for d, t in zip(f["doc_id"], f["text"]):
                parts = split_text(t, vocabulary, limit, overlap) if t else []
                out += [(d, k, len(parts), *p) for k, p in enumerate(parts)]
            yield pd.DataFrame(out, columns=["doc_id", "piece_no", "n_pieces", "start_char", "end_char", "n_tokens", "overlap_tokens"])

    return docs.filter("doc_id is not null and text is not null and text <> ''").select("doc_id", "text").mapInPandas(run, PIECES)
