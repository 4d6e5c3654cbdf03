"""Word vectors read every byte of words of any length."""

import numpy as np
import pytest


def whole(word):
    from lectern.llm.quality import CLASS, CONTEXTS, index_vectors

    index, w = index_vectors().astype(np.float64), [int(c) for c in b"\x01" + word + b"\x02"]
    total = np.zeros(index.shape[1])
    for a, b, c in zip(w, w[1:], w[2:]):
        total += index[((a | b << 8 | c << 16) * 0x9E3779B1 % 2**32 >> 15) % CONTEXTS]
    for a, b in zip(w, w[1:]):
        a, b = int(CLASS[a]), int(CLASS[b])
        if a != b:
            total += 2 * index[((a << 8 | b) * 0x85EBCA6B % 2**32 >> 13) % CONTEXTS]
    return total / np.sqrt(total @ total)


@pytest.mark.parametrize("n", [1, 2, 5, 251, 252, 253, 254, 255, 256, 257, 506, 507, 508, 509, 510, 1000, 20_000])
def test_vectors_of_long_words(n):
    from lectern.llm.quality import index_vectors, word_vectors

    rng = np.random.default_rng(n)
    words = [bytes(rng.choice(np.frombuffer(b"abcXYZ019$#\xe6\x97\xa5\xc3", np.uint8), n)) for _ in range(3)] + [b"\x01" * n, b"a" * n, b"short"]
    assert np.allclose(word_vectors(words, index_vectors()), [whole(w) for w in words], atol=1e-4)


def test_tail_of_a_text_without_blanks_counts():
    from lectern.llm.quality import Model

    head = "文書の品質を全文で測る".encode() * 30
    model = Model({}, np.zeros((1, 64), np.float32))
    assert not np.allclose(model.features([head])[0], model.features([head + b"$#%&" * 2000])[0], atol=0.05)
