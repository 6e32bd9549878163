"""Test passages inside a training corpus, by a positional inverted index.

:func:`build_index` cuts the corpus into blocks of documents.  A block is
one row: its terms in order, each with its postings (all positions in the
block, documents one after the other with a gap between), and its documents'
starts.  The index holds every word of every document and does not depend on
the test items, so it is stored once and searched for any.

:func:`search` sends the items, a stated query set in packs of bounded size,
to the blocks.  A passage of 16 words with two edits, or longer with one in
eight, always keeps five neighbouring words, so each five-word phrase of an
item is looked for: the postings of its rarest term in the block, adjusted
by offset, are intersected with the other terms' from rare to common.  Where
a document and item share phrases, :func:`passages` aligns the item with the
document's words around the hits.  No postings are shuffled; what a task
holds is one block.

Defined results: null and empty texts have no words and no leaks; a very
long text is a block of its own; copies of an item or document are each
searched and reported once by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fedsql.llm.words import words
from fedsql.session import shared_path

BLOCK_WORDS = 800_000
GAP = 256
#: Queries sent along with one pass over the index have at most this many words in all.
PACK_WORDS = 400_000
INDEX = "doc_ids array<bigint>, starts array<int>, terms array<string>, ends array<int>, postings binary"


class _Block:
    def __init__(self) -> None:
        self.ids: list[int] = []
        self.starts: list[int] = []
        self.tokens: list[bytes] = []
        self.at: list[np.ndarray] = []
        self.next = 0

    def add(self, doc_id: int, ws: list[bytes]) -> None:
        self.ids.append(doc_id)
        self.starts.append(self.next)
        self.tokens += ws
        self.at.append(np.arange(self.next, self.next + len(ws), dtype=np.int32))
        self.next += len(ws) + GAP

    def row(self) -> tuple:
        codes, terms = pd.factorize(np.array(self.tokens, dtype=object), sort=False)
        order = np.argsort(codes, kind="stable")
        positions = np.concatenate(self.at)[order] if self.at else np.empty(0, np.int32)
        ends = np.cumsum(np.bincount(codes, minlength=len(terms))).astype(np.int32)
        steps = np.diff(positions, prepend=np.int32(0)).astype(np.int32)  # small numbers compress well
        return self.ids, self.starts, [t.decode() for t in terms], ends, steps.tobytes()


def build_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The stored index of ``docs``(doc_id, text): one row for each block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = _Block()
        names = ["doc_ids", "starts", "terms", "ends", "postings"]
        for f in frames:
            for d, t in zip(f["doc_id"], f["text"]):
                if (ws := words(t)):
                    if block.ids and len(block.tokens) + len(ws) > BLOCK_WORDS:
                        yield pd.DataFrame([block.row()], columns=names)
                        block = _Block()
                    block.add(d, ws)
        if block.ids:
            yield pd.DataFrame([block.row()], columns=names)

    spark = docs.sparkSession
    path = path or shared_path(spark, "postings")
    docs.filter("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(run, INDEX).write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(INDEX).parquet(path)


class Pack:
    """Items made ready for the search: their words, and every run of ``gram`` words."""

    def __init__(self, items: list[tuple[int, list[bytes]]], gram: int = 5) -> None:
        self.gram = gram
        self.vocab: dict[str, int] = {}  # by the word as text
        self.items = [(i, np.array([self.vocab.setdefault(w.decode(), len(self.vocab)) for w in ws], np.int64)) for i, ws in items]
        grams: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for k, (_, ws) in enumerate(self.items):
            for at in range(len(ws) - gram + 1):
                grams.setdefault(tuple(ws[at : at + gram]), []).append((k, at))
        self.grams = np.array(list(grams), np.int64).reshape(-1, gram)
        self.where = list(grams.values())


def phrase_hits(pack: Pack, postings: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(item's place in the pack, place in the item, block position) of every shared run of ``gram`` words."""
    if not len(pack.grams):
        return []
    counts = np.array([len(p) for p in postings])[pack.grams]
    out = []
    for g in np.flatnonzero(counts.min(axis=1) > 0):
        order = np.argsort(counts[g], kind="stable")
        terms = pack.grams[g]
        base = postings[terms[order[0]]] - order[0]
        for k in order[1:]:
            p = postings[terms[k]]
            at = np.searchsorted(p, base + k)
            base = base[(at < len(p)) & (p[np.minimum(at, len(p) - 1)] == base + k)]
            if not len(base):
                break
        out += [(k, at, int(b)) for b in base for k, at in pack.where[g]]
    return out


def passages(item: np.ndarray, doc: np.ndarray, least: int = 16, one_in: int = 8, shared_ends: bool = True) -> bool:
    """Whether ``doc`` has at least ``least`` neighbouring words of ``item`` in order with at most one edit in ``one_in``.

    With ``shared_ends`` a passage begins and ends with a word that is the same on both sides; else edits count anywhere.
    For each first word of the item, edit distances to all places of the document are kept row by row.
    """
    n, m = len(item), len(doc)
    if n < least or m < least - least // one_in:
        return False
    same = item[:, None] == doc[None, :]
    step = np.arange(m + 1, dtype=np.int32)
    # all starts side by side: row s is the distance of item[s:i] to the best piece of doc that ends at j
    starts = np.flatnonzero(same.any(axis=1)) if shared_ends else np.arange(n)
    starts = starts[starts <= n - least]
    if not len(starts):
        return False
    dist = np.zeros((len(starts), m + 1), np.int32)
    big = np.int32(10_000)
    for i in range(int(starts[0]), n):
        live = starts <= i
        before = dist[live]
        now = np.empty_like(before)
        now[:, 0] = before[:, 0] + 1
        now[:, 1:] = np.minimum(before[:, :-1] + ~same[i], before[:, 1:] + 1)
        first = starts[live] == i
        if shared_ends and first.any():  # a passage begins with a shared word
            now[first, 0] = big
            now[first, 1:] = np.where(same[i], 0, big)
        now = np.minimum.accumulate(now - step, axis=1) + step
        dist[live] = now
        length = i - starts[live] + 1
        ended = now
        if shared_ends:
            ended = np.where(same[i], before[:, :-1], big)  # and ends with one
            ended = np.where(first[:, None], big, ended)
        if ((length >= least) & (ended.min(axis=1) * one_in <= length)).any():
            return True
        # a start that is hopeless even if all the rest is the same can go
        hopeless = now.min(axis=1) * one_in > n - starts[live]
        if hopeless.any():
            keep = np.ones(len(starts), bool)
            keep[np.flatnonzero(live)[hopeless]] = False
            starts, dist = starts[keep], dist[keep]
            if not len(starts):
                return False
    return False


def search(index: DataFrame, items: DataFrame, least: int = 16, one_in: int = 8, shared_ends: bool = True) -> DataFrame:
    """(doc_id, item_id) of every document of the index with a passage of an item(item_id, text).

    ``items`` is a stated query set; it is sent to the blocks in packs of at most :data:`PACK_WORDS` words.
    """
    edits = least // one_in
    gram = -(-(least - edits) // (edits + 1))
    packs: list[list[tuple[int, list[bytes]]]] = [[]]
    room = PACK_WORDS
    for r in items.filter("item_id is not null and text is not null").dropDuplicates(["item_id"]).toLocalIterator():
        if len(ws := words(r.text)) >= least:
            if packs[-1] and len(ws) > room:
                packs.append([])
                room = PACK_WORDS
            packs[-1].append((r.item_id, ws))
            room -= len(ws)
    out = None
    for p in packs:
        found = index.mapInPandas(_searcher(Pack(p, gram), least, one_in, shared_ends), "doc_id bigint, item_id bigint")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def _searcher(pack: Pack, least: int, one_in: int, shared_ends: bool):  # noqa: ANN202
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for ids, starts, terms, ends, raw in zip(f["doc_ids"], f["starts"], f["terms"], f["ends"], f["postings"]):
                found = search_block(pack, np.asarray(ids), np.asarray(starts), terms, np.asarray(ends), np.cumsum(np.frombuffer(raw, np.int32), dtype=np.int32), least, one_in, shared_ends)
                yield pd.DataFrame(found, columns=["doc_id", "item_id"]).astype("int64")

    return run


def search_block(pack: Pack, ids: np.ndarray, starts: np.ndarray, terms: list[str], ends: np.ndarray, positions: np.ndarray, least: int, one_in: int, shared_ends: bool = True) -> list[tuple[int, int]]:
    none = np.empty(0, np.int32)
    postings = [none] * len(pack.vocab)
    for k, t in enumerate(terms):
        if (v := pack.vocab.get(t)) is not None:
            postings[v] = positions[ends[k - 1] if k else 0 : ends[k]]
    hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k, at, pos in phrase_hits(pack, postings):
        hits.setdefault((int(np.searchsorted(starts, pos, side="right")) - 1, k), []).append((at, pos))
    out = []
    edits = least // one_in
    for (d, k), where in hits.items():
        if len(where) < 2 and least - edits > pack.gram + 2 * (pack.gram - 1):
            continue  # runs of at most gram words and gram - 1 words around two edits are too few
        item = pack.items[k][1]
        end = starts[d + 1] - GAP if d + 1 < len(starts) else None
        # one stretch of the document for each cluster of hits
        where.sort(key=lambda x: x[1] - x[0])
        slack = len(item) // one_in + 1
        clusters: list[list[int]] = []
        for at, pos in where:
            if clusters and pos - at - clusters[-1][1] <= slack:
                clusters[-1][1] = pos - at
                clusters[-1][2] += 1
            else:
                clusters.append([pos - at, pos - at, 1])
        for lo, hi, n in clusters:
            if n < 2 and least - edits > pack.gram + 2 * (pack.gram - 1):
                continue
            lo = max(int(starts[d]), lo - slack)
            hi = hi + len(item) + slack
            if end is not None:
                hi = min(hi, int(end))
            piece = np.full(max(hi - lo, 0), -1, np.int64)
            for v in np.unique(item):
                p = postings[v]
                piece[p[np.searchsorted(p, lo) : np.searchsorted(p, hi)] - lo] = v
            # 16 words with two edits, or a stretch of a longer passage, have 14 of 20 words from the item
            width, edited = least + 2 * edits, (2 * least - 1) // one_in
            near = np.convolve(piece >= 0, np.ones(width, np.int64), "full")
            if near.max(initial=0) >= min(least - edits, width - 2 * edited) and passages(item, piece, least, one_in, shared_ends):
                out.append((int(ids[d]), int(pack.items[k][0])))
                break
    return out
