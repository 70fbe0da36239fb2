"""op3: dropout of each occurrence of a chunk."""

from collections import Counter

import numpy as np

from gamelode.llm import piece_dropout


def test_dropout_is_drawn_for_each_occurrence():
    p = piece_dropout.pieces(piece_dropout.default_model())
    texts = ["international " * 40, "x" * 60 + " of international 日本", ""] * 20
    flat, n = piece_dropout.encode_batch(p, texts, range(60), 0.1)
    chunks = [piece_dropout.CHUNKS.findall(" " + t) if t else [] for t in texts]
    keys = piece_dropout.chunk_keys(range(60), np.array(list(map(len, chunks))), piece_dropout.SEED)
    at, want, kinds, ends = 0, [], Counter(), np.cumsum(n)
    for i, c in enumerate(chunks):
        ids = []
        for x in c:
            points = [ord(y) for y in x]
            one = []
            for s, a, _ in piece_dropout.encode_one(p, p.symbol[points].tolist(), int(keys[at]), 0.1):
                one += [s] if s >= 0 else [p.byte0 + y for y in x[a].encode()]
            at += 1
            kinds[x, tuple(one)] += 1
            ids += one
        assert flat[ends[i] - n[i] : ends[i]].tolist() == ids
    assert sum(x == " international" for x, _ in kinds) > 8


def test_side_by_side_and_on_a_heap_are_alike():
    """encode_many against encode_one, chunk by chunk, at several rates."""
    p = piece_dropout.pieces(piece_dropout.default_model())
    rng = np.random.default_rng(5)
    letters = list("etaoinshrdlu  e\u00e9\u00df\u65e5")
    chunks = [" " + "".join(rng.choice(letters, rng.integers(1, 30))).replace(" ", "") for _ in range(300)] + [" international", " x"]
    for rate in (0.1, 0.5, 1.0):
        keys = rng.integers(0, 1 << 63, len(chunks)).astype(np.uint64)
        flat, n = piece_dropout.encode_chunks(p, chunks, keys, rate)
        ends = np.cumsum(n)
        for c, k, e, size in zip(chunks, keys.tolist(), ends, n):
            want = []
            for s, a, _ in piece_dropout.encode_one(p, p.symbol[[ord(y) for y in c]].tolist(), k, rate):
                want += [s] if s >= 0 else [p.byte0 + y for y in c[a].encode()]
            assert flat[e - size : e].tolist() == want
        if rate == 1.0:
            assert (n >= [len(c) for c in chunks]).all()


def test_slices_change_nothing(monkeypatch):
    p = piece_dropout.pieces(piece_dropout.default_model())
    texts = ["the theory of everything " * 30, "a", "", "word " * 200] * 5
    whole = piece_dropout.encode_batch(p, texts, range(20))
    monkeypatch.setattr(piece_dropout, "SPANS", 64)
    monkeypatch.setattr(piece_dropout, "SYMBOLS", 64)
    again = piece_dropout.encode_batch(p, texts, range(20))
    assert all((a == b).all() for a, b in zip(whole, again))
