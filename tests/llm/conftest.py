import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, first=0, ids=None):
        ids = ids if ids is not None else range(first, first + len(texts))
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in zip(ids, texts)], DOCS)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, shared passages, odd white space, empties and a null."""
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "to", "in"] * 3 + ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(120)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = sentence(33)
    texts = [sentence(rng.randint(1, 90)) for _ in range(30)]
    texts += [texts[3], texts[3] + " ", texts[3].replace(" ", "\t\n"), texts[7], texts[7]]
    long = sentence(300)
    words = long.split()
    texts += [long, " ".join(w if k != 100 else "changed" for k, w in enumerate(words)), " ".join(w if k % 120 else "edit" for k, w in enumerate(words))]
    texts += [f"{sentence(9)} {passage} {sentence(4)}", f"{passage}", f"{sentence(3)}\n\n{passage}\x0b{passage}", sentence(20) + " ", "one", "one two", "", None, " \t ", "", "x" * 5000]
    return texts
