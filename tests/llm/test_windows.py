"""Blocks of many pieces: how many there are, and that windows are found across them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from nearprint.llm import suffixes, windows
from nearprint.llm.tables import LAST

TEXTS = [
    "the quick brown fox jumps over the lazy dog and runs away from it " * 3, "", "a short one",
    "some words before the quick brown fox jumps over the lazy dog and runs away from it again",
    "über den Fluß und in die Wälder, the quick brown fox jumps over the lazy dog", "ab " * 90, "x ab ab ab " + "ab " * 40,
    "the quick brown fox jumps over the lazy dog and runs away from it " * 2,
]
IDS = [3, 1, 7, 2, 5, 8, 4, LAST]


def spans(kind: str, window: int, gram: int, blocks: int, buckets: int) -> dict[int, list[bool]]:
    """Which units of each text a smaller id covers, by the steps that Spark runs."""
    rank = suffixes.doubled_rank if kind == "bytes" else windows.content_rank
    docs = pa.table({"block": pa.array([i % blocks for i in range(len(IDS))], pa.int64()), "doc": pa.array(IDS, pa.int64()), "text": TEXTS})
    each = [docs.filter(pa.compute.equal(docs["block"], b)) for b in range(blocks)]

    def by_bucket(tables, step):
        rows = pa.concat_tables(tables)
        return pa.concat_tables([step(rows.filter(pa.compute.equal(rows["bucket"], b))) for b in set(rows["bucket"].to_pylist())])

    def of(rows, b):
        return rows.filter(pa.compute.equal(rows["block"], b))

    answers = by_bucket([windows.ask(kind, window, gram, buckets)(part) for part in each], windows.answer)
    sent = [windows.send(kind, window, gram, buckets)(part, of(answers, b)) for b, part in enumerate(each)]
    found = by_bucket(sent, windows.count(kind, window, rank))
    out = {}
    for b, part in enumerate(each):
        part, (start, end), done = windows._sorted(part), windows.stretches(of(found, b), window), 0
        for at, stop, units in windows.pieces(kind, part):
            n = len(units.text)
            own = (start >= done) & (start < done + n)
            under = windows.covered(n, start[own] - done, end[own] - done)
            out |= {part["doc"][k].as_py(): under[units.text == k - at].tolist() for k in range(at, stop)}
            done += n
    return out


def expected(kind: str, window: int) -> dict[int, list[bool]]:
    units = [t.split() if kind == "words" else list(t.encode()) for t in TEXTS]
    seen, out = set(), {}
    for k in np.argsort(IDS).tolist():
        own = [tuple(units[k][i : i + window]) for i in range(len(units[k]) - window + 1)]
        under = [False] * len(units[k])
        for i, one in enumerate(own):
            if one in seen:
                under[i : i + window] = [True] * window
        seen |= set(own)
        out[IDS[k]] = under
    return out


@pytest.mark.parametrize("kind, window, gram", [("bytes", 50, 25), ("words", 6, 3)])
@pytest.mark.parametrize("piece, hot", [(1, 4096), (200, 4096), (1, 1), (200, 1), (1 << 20, 1)])
def test_pieces_of_a_block_are_one_block(monkeypatch, kind, window, gram, piece, hot):
    monkeypatch.setattr(windows, "PIECE_BYTES", piece)
    monkeypatch.setattr(windows, "HOT_RUNS", hot)
    want = expected(kind, window)
    assert any(any(v) for v in want.values())
    for blocks in (1, 3):
        assert spans(kind, window, gram, blocks, 4) == want


def test_blocks_grow_with_the_text_and_not_with_the_documents():
    """A row for each block and bucket is worth its cost: 6 GB in 2,400 buckets, once 28 million rows."""
    text = 10_000_000_000
    assert windows.blocks_of(text, 600) * 2400 < 2_500_000
    assert windows.blocks_of(text, 600) * windows.BLOCK_BYTES >= text
    assert windows.blocks_of(0, 8) == 1
    assert windows.blocks_of(20 * windows.LEAST_BYTES, 200) == 20
