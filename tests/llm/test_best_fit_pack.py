import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from meridian.llm.best_fit_pack import pack, plan_best_fit
from meridian.llm.queries import tokenizer_file


def slow_best_fit(histogram, capacity):
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - length)
            else:
                rooms.append(capacity - length)
    return len(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 50, 2048])
    histogram = {rnd.randint(1, capacity): rnd.randint(1, 50) for _ in range(rnd.randint(1, 60))}
    bins, ranks = {}, {}
    for length, lo, hi, first, each, offset in plan_best_fit(histogram, capacity):
        for rank in range(lo, hi):
            ranks.setdefault(length, set()).add(rank)
            bins.setdefault(first + (rank - lo) // each, []).append((offset + (rank - lo) % each * length, length))
    assert ranks == {length: set(range(n)) for length, n in histogram.items()}
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == slow_best_fit(histogram, capacity)


def test_pieces_hold_the_tokenizers_ids(awkward):
    tokenizer = Tokenizer.from_file(tokenizer_file())
    found = pack(awkward, tokenizer_file(), keep_ids=True).toPandas()
    for r in awkward.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        own = found[found.doc_id.isna() if r.doc_id is None else found.doc_id == r.doc_id].sort_values(["piece"])
        if r.doc_id is None or r.doc_id == 2:
            continue  # several rows share these
        assert [x for piece in own.ids for x in piece] == ids
        assert own.start.tolist() == list(range(0, len(ids), 2048)) and own.length.sum() == len(ids)
        for piece in own.itertuples():
            assert piece.ids_crc32 == zlib.crc32(np.array(piece.ids, "<u4").tobytes())
    assert len(found[found.doc_id == 2]) == 3 and found.doc_id.isna().sum() == 2
    for _, sequence in found.groupby("sequence_id"):
        order = sequence.sort_values("offset")
        assert order.offset.tolist() == [0, *order.length.cumsum().tolist()[:-1]] and order.length.sum() <= 2048


def test_empty_table(none):
    assert pack(none, tokenizer_file()).count() == 0
