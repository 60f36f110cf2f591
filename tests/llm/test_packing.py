import bisect
import random
import zlib

import numpy as np

from seekspark.llm import packing as P
from seekspark.llm import tokens
from tests.llm import cases

PATH = tokens.vocabulary(P.VOCABULARY)


def plain_best_fit(lengths, capacity):
    """Rooms left by a sequential best-fit decreasing pass."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, n)
        bisect.insort(rooms, (rooms.pop(k) if k < len(rooms) else capacity) - n)
    return rooms


def test_same_rooms_as_a_sequential_pass():
    rng = random.Random(6)
    for capacity in (1, 7, 64, 100):
        for _ in range(40):
            lengths = [min(capacity, 1 + int(rng.random() ** 3 * capacity)) for _ in range(rng.randrange(0, 200))]
            runs = P.best_fit_decreasing({n: lengths.count(n) for n in set(lengths)}, capacity)
            used = {}
            for n in set(lengths):
                own = [r for r in runs.tolist() if r[0] == n]
                for rank in range(lengths.count(n)):
                    _, first, seq, each, at = max((r for r in own if r[1] <= rank), key=lambda r: r[1])
                    used.setdefault(seq + (rank - first) // each, []).append((at + (rank - first) % each * n, n))
            for parts in used.values():
                at = 0
                for offset, n in sorted(parts):
                    assert offset == at
                    at += n
                assert at <= capacity
            assert sorted(capacity - sum(n for _, n in p) for p in used.values()) == plain_best_fit(lengths, capacity)


def test_pack_documents(spark):
    texts = cases.TEXTS + [(200 + i, "many words in this text " * (1 + i * 7 % 50)) for i in range(60)]
    rows = P.pack(cases.docs(spark, texts), PATH).collect()
    want = []
    for i, t in texts:
        ids = tokens.load(PATH).encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, n, at, zlib.crc32(np.array(ids[at:at + 4096], "<u4").tobytes()))
                 for n, at in enumerate(range(0, len(ids), 4096))]
    assert sorted(((r.doc_id, r.piece, r.start, zlib.crc32(r.ids)) for r in rows), key=str) == sorted(want, key=str)
    used = {}
    for r in rows:
        assert r.length == len(r.ids) // 4
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(used) == len(plain_best_fit([r.length for r in rows], 4096))


def test_empty(spark):
    assert P.pack(cases.empty(spark), PATH).count() == 0
