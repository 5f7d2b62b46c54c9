"""Words that occur again are not encoded again, however many others come between."""

from obsidra.llm import sentencepieces as sp
from obsidra.llm.queries import PIECE_MODEL


def test_frequent_words_outlive_rare_ones(monkeypatch):
    monkeypatch.setattr(sp, "CACHE_WORDS", 40)
    encoder, plain, calls = sp.Encoder(sp.load(PIECE_MODEL)), sp.Encoder(sp.load(PIECE_MODEL)), []
    forward = encoder.forward
    encoder.forward = lambda word, shared: calls.append(word) or forward(word, shared)
    common = [f"common{c}" for c in "abcdefgh"]
    for n in range(30):
        rare = [f"rare{'abcdefghij'[n % 10]}{'klmnopqrst'[n // 10]}{c}" for c in "uvwxyz"]
        # the common words stand in every other part only
        words = sorted(set(rare + (common if n % 2 == 0 else [])))
        ids, bounds = encoder.encode([" ".join(words)])
        assert ids.tolist() == plain.encode([" ".join(words)])[0].tolist()
        plain.words, plain.older = {}, {}
    assert max(calls.count(sp.MARK + w) for w in common) == 1
    assert len(encoder.words) + len(encoder.older) <= 40
