"""Mixture-controlled packing: ids, gapless sequences, shares of windows, deficit round-robin in plain Python."""

import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matchlens.llm import windows

WHOLE = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ENCODE = windows.word_bpe()


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.characters(min_codepoint=0xA0, max_codepoint=0x260), st.sampled_from("aeéÉİSs 'stredvml\n\t.,!?1$#<|>½²_")), max_size=60))
def test_same_ids_as_the_tokenizer(text):
    assert np.frombuffer(ENCODE(text), "<u2").tolist() == ids_of(text)


def test_every_plain_character():
    for a in range(0x20, 0x2100):
        for text in (chr(a), f"a{chr(a)}b", f"X{chr(a)}{chr(a)}'s 1{chr(a)}"):
            assert np.frombuffer(ENCODE(text), "<u2").tolist() == ids_of(text), hex(a)


def test_each_token_is_what_its_bytes_are_merged_to():
    """So joining any two parts that are a token gives the same ids as joining by the list of merges."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        model = json.load(file)["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    order, vocabulary = {m: i for i, m in enumerate(merges)}, model["vocab"]
    made = {a + b for a, b in merges}
    assert [vocabulary[a + b] for a, b in merges] == [*range(512, 512 + len(merges))] and len(made) == len(merges)
    assert sorted(i for t, i in vocabulary.items() if t not in made) == [*range(512)]
    assert sorted(windows.merge_ranks(public_tokenizers.path("word_bpe_49k.json")).values()) == sorted(vocabulary.values())
    for token in vocabulary:
        end = token.endswith("</w>")
        parts = [*token.removesuffix("</w>")]
        if end:
            parts[-1] += "</w>"
        while len(parts) > 1:
            _, i = min((order.get(pair, len(order)), i) for i, pair in enumerate(zip(parts, parts[1:])))
            assert (parts[i], parts[i + 1]) in order, token
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert parts == [token]


def test_words_beyond_what_a_worker_could_keep(monkeypatch):
    """Plain texts never go to the tokenizer, however many words are new; long words too."""
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice([*"etaoinshréñß"], n)) for n in rng.integers(1, 24, 20_000)] + ["ab" * 3000, "e" * 5000, "x1y2" * 700]
    text = " ".join(words) + "\n'S 12,5 ''re !!?! " * 3
    want = ids_of(text)
    monkeypatch.setattr(windows, "_READY", {})
    monkeypatch.setattr(Tokenizer, "from_file", lambda path: None)
    assert np.frombuffer(windows.word_bpe()(text), "<u2").tolist() == want


def checked(out, rows, capacity):
    """Pieces cover each row's ids once, sequences are gapless, full or of a power of two."""
    want = Counter((i, tuple([*ids_of(t), 1])) for i, t, _ in rows)
    by_doc, lengths = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        lengths[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in lengths.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and at & (at - 1) == 0
    assert sum(r["length"] for r in out) == sum(len(ids) * n for (_, ids), n in want.items())
    for (i, ids), times in want.items():
        got = sorted((r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i, len(ids)])
        same = sum(n for (j, other), n in want.items() if j == i and len(other) == len(ids))
        assert len(got) % same == 0 or same > 1
        if same == 1:
            at = 0
            for start, length, crc in got:
                assert start == at and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
                at += length
            assert at == len(ids)
        assert times
    return lengths


def test_round_trip(docs, rows):
    checked([r.asDict() for r in windows.pack(docs).collect()], rows, 2048)
    lengths = checked([r.asDict() for r in windows.pack(docs.withColumns({"n": F.lit("x"), "RID": F.lit(1), "parts": F.lit(2), "window": F.lit(0)}), 64, 512, 16).collect()], rows, 64)
    assert sum(sum(x for _, x in p) != 64 for p in lengths.values()) <= 6


def plain(rows, window, packet, weights=None, seed_order=None):
    """Deficit round-robin, a packet at a time: the windows that each document's packets are in."""
    queues, out = defaultdict(list), defaultdict(list)
    for i, n, s in seed_order:
        cuts = [*range(packet, n - packet + 1, packet), n]
        queues[s] += [(i, b - a) for a, b in zip([0, *cuts], cuts)]
    total = {s: sum(n for _, n in q) for s, q in queues.items()}
    share = weights or {s: n / sum(total.values()) for s, n in total.items()}
    whole = sum(share[s] for s in queues)
    deficit, w = dict.fromkeys(queues, 0.0), 0
    while any(queues.values()):
        for s, q in queues.items():
            deficit[s] += window * share[s] / whole
            while q and q[0][1] <= deficit[s] + 1e-6:
                i, n = q.pop(0)
                deficit[s] -= n
                out[i].append(w)
        w += 1
    return out


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0, "c": 0.5, None: 2.0}])
def test_windows_are_those_of_deficit_round_robin(spark, weights):
    rows = [(i, "word " * (1 + i * i * 7 % 433) if i % 11 else None, ["a", "a", "a", "b", "c", None][i % 6]) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = windows.pack(df, 256, 1024, 32, weights=weights).collect()
    checked([r.asDict() for r in out], rows, 256)
    h = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.lit(11), "doc_id", "text").alias("h")).collect()}
    order = [(i, len(ids_of(t)) + 1, s) for i, t, s in sorted(rows, key=lambda r: (r[2] is None, r[2] or "", h[r[0]]))]
    want = plain(rows, 1024, 32, weights, order)
    got = defaultdict(set)
    for r in out:
        got[r.doc_id].add(r.window)
    assert {i: sorted(w) for i, w in got.items()} == {i: sorted(set(w)) for i, w in want.items()}
    # Shares: each source, up to each window, within two packets of its due.
    if weights is None:
        total, held = Counter(), Counter()
        for r in out:
            total[r.source] += r.length
            held[r.source, r.window] += r.length
        for s in total:
            due, so_far = 1024 * total[s] / sum(total.values()), 0
            for w in range(max(r.window for r in out)):
                so_far += held[s, w]
                assert -1e-6 <= (w + 1) * due - so_far < 64
    # Windows are laid one after the other.
    at = sorted((r.sequence_id, r.offset, r.window) for r in out)
    assert [w for _, _, w in at] == sorted(r.window for r in out)


def test_small_sources_stay_whole(spark):
    rows = [(i, "word " * 500, "large") for i in range(200)] + [(900, "some words of a small source " * 5, "small")]
    out = windows.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), 2048, 4096, 128).where("doc_id = 900").collect()
    assert len({r.window for r in out}) == 1  # cut by sequences only


def test_tail():
    for total in (0, 1, 5, 2047, 2048, 2049, 10_000):
        cuts = windows.tail_cuts(total, 2048)
        ends = [*cuts[1:], total] if cuts else []
        assert all((b - a) & (b - a - 1) == 0 and b > a for a, b in zip(cuts, ends)) and (cuts or total % 2048 == 0)


def test_empty_and_wrong(nothing):
    out = windows.pack(nothing)
    assert out.count() == 0 and ", ".join(f"{c} {t}".replace("bigint", "long") for c, t in out.dtypes) == windows.SCHEMA
    with pytest.raises(ValueError):
        windows.pack(nothing, 1000)
