"""The encoder of op7: search of many parts at once, and what a worker keeps."""

import random
import tracemalloc

import numpy as np

from tideline.llm import piece_codec


def test_parts_of_all_lengths_are_searched_together():
    pieces = piece_codec.load()
    rng = random.Random(3)
    parts = [" ", "\n", " the", " 日本", "é", " a\0b", *("".join(rng.choice("abeinst .é") for _ in range(rng.randint(1, 80))) for _ in range(300))]
    found = piece_codec.many_best_and_gap(pieces, piece_codec.PieceTable(pieces), parts)
    ends = np.cumsum(found.size)
    for k, part in enumerate(parts):
        score, gap, ids = piece_codec.best_and_gap(pieces, part)
        assert (found.score[k], found.gap[k], found.ids[ends[k] - found.size[k] : ends[k]].astype(np.int32).tobytes()) == (score, gap, ids), part


def test_a_worker_keeps_little():
    pieces = piece_codec.load()
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdeinorst") for _ in range(8)) for _ in range(1000)) for _ in range(200)]
    encoder = piece_codec.Encoder(pieces)
    tracemalloc.start()
    try:
        for i in range(0, len(texts), 20):
            encoder.prepare([part for text in texts[i : i + 20] for part in encoder.split(text)])
        kept = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    # 200,000 different words, of which some 120,000 may stay; as tuples in one dictionary all stayed, 50 MB.
    assert kept < 30e6


def test_forgotten_parts_are_found_again(monkeypatch):
    pieces = piece_codec.load()
    texts = ["a word or two", "other words", "a word again", "", "two other words"] * 3
    want = [piece_codec.nbest(pieces, t, 3) for t in texts]
    monkeypatch.setattr(piece_codec, "REMEMBERED", 4)
    encoder = piece_codec.Encoder(pieces)
    for text, all_ in zip(texts, want, strict=True):
        ((scores, ids),) = encoder.encode([encoder.split(text)])
        assert [(s, tuple(i.tolist())) for s, i in zip(scores, ids, strict=True)] == all_


def test_tasks_of_a_worker_share_one_encoder(monkeypatch):
    pieces, made = piece_codec.load(), []

    class Counted(piece_codec.Encoder):
        def __init__(self, *args):
            made.append(1)
            super().__init__(*args)

    class Shared:
        value = pieces

    monkeypatch.setattr(piece_codec, "Encoder", Counted)
    monkeypatch.setattr(piece_codec, "_ENCODERS", {})
    for _ in range(2):
        list(piece_codec._encode(Shared, "some", 3)(iter([])))
    assert len(made) == 1
