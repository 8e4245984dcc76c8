"""op 1's encoder: new chunks go to the library many at a time, and the ids are the library's."""

import random

import numpy as np
import public_tokenizers as P

from panelspark.llm.token_blocks import LibraryEncoder

PATH = P.path("byte_bpe_50k.json")
PARTS = ["a", "B", "7", " ", " ", "'", "s", ".", ",", "\n", "\t", "é", "日", "́", "Ġ", "\xa0", "\x1c", "🙂", "<|endoftext|>", "-", "ll"]


def ids(packed):
    return np.frombuffer(packed, dtype="<u2").tolist()


def test_ids_are_the_librarys_also_after_words_were_dropped():
    draw = random.Random(1)
    texts = ["", " ", "a  b", "it's 's 'll", *("".join(draw.choice(PARTS) for _ in range(draw.randint(0, 40))) for _ in range(4000))]
    coder = LibraryEncoder(PATH, limit=1000)
    got = [ids(x) for at in range(0, len(texts), 200) for x in coder.encode_many(texts[at:at + 200], 0)]
    assert got == [e.ids + [0] for e in coder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_new_words_are_encoded_together_and_words_in_use_stay():
    coder = LibraryEncoder(PATH, limit=6000)
    calls, library = [], coder.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **how):
            calls.extend(texts)
            return library.encode_batch_fast(texts, **how)

    coder.tokenizer = Counted()
    used = " ".join(f"in{i}use" for i in range(500))
    list(coder.encode_many([used + " " + used], 0))
    assert len(calls) <= 2  # the first chunk, and the others in one text
    for k in range(4):
        list(coder.encode_many([used, " ".join(f"once{k}x{i}" for i in range(5000))], 0))
    calls.clear()
    list(coder.encode_many([used], 0))
    assert not any("in7use" in text for text in calls)
