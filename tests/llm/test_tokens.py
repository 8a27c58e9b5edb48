"""Word ids against the tokenizer itself, on words that mix letters, marks, digits and signs of many scripts."""

import random

from seatwise.llm import packing
from seatwise.llm.queries import TOKENIZER

ODD = "aAzé́İßΣσςÅK'.,!?;:-_()’“…0½²क़ﬁ中한क़̈́ͅŉDž­‍😀 \t\n"


def test_random_odd_texts():
    words, draw = packing.WordIds(TOKENIZER), random.Random(9)
    for _ in range(3000):
        text = "".join(draw.choice(ODD) for _ in range(draw.randrange(1, 30)))
        flat, bounds = words.batch([text.encode()])
        assert flat.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids and bounds.tolist() == [0, len(flat)]


def test_forgotten_words_are_worked_out_again():
    words = packing.WordIds(TOKENIZER, most=20)
    texts = [f"word{i % 37} über{i % 11}, x{i}." for i in range(400)]
    for text in texts:
        flat, _ = words.batch([text.encode()])
        assert flat.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(words.places) < 60
