import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from matchlens.llm import packing

WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODE = packing.byte_bpe()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeé 's\n\t.,!?1$#<|> ")), max_size=60))
def test_same_ids_as_the_tokenizer(text):
    assert ENCODE(text) == WHOLE.encode(text, add_special_tokens=False).ids


def test_round_trip(docs, rows):
    out = [r.asDict() for r in packing.pack(docs, 1024).collect()]
    want = Counter()
    for i, t, _ in rows:
        ids = [*WHOLE.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for k, a in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[a : first if k == 0 else a + 1024]
            want[(i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in out)
    assert len(by) <= -(-total // 1024) + 2


def test_plan_covers_the_histogram():
    rng = np.random.default_rng(0)
    for case in range(6):
        counts = np.zeros(257, dtype=np.int64)
        for length in rng.integers(1, 257 if case % 2 else 60, 4000 if case else 3):
            counts[length] += 1
        plan = packing.packing_plan(counts, 256)
        made = np.zeros(257, dtype=np.int64)
        for filling, n in plan:
            assert sum(filling) <= 256
            for x in filling:
                made[x] += n
        assert (made == counts).all()
        lower = -(-int((counts * np.arange(257)).sum()) // 256)
        assert sum(n for _, n in plan) <= lower * 1.02 + 1


def test_empty(nothing):
    assert packing.pack(nothing).count() == 0
