import random
import re
import string

import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text, pattern=WORDS):
    return pattern.findall((text or "").translate(LOWER))


def shingles(text, k=5):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def prose(rng, n, vocab=400):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(2)) + str(rng.randrange(vocab)) for _ in range(n))


def edited(rng, text, share):
    w = text.split(" ")
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = "x" + str(rng.randrange(10**6))
    return " ".join(w)


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text): prose, exact and near copies, shared passages and lines, odd texts."""
    rng = random.Random(7)
    base = [prose(rng, n) for n in (3, 5, 6, 7, 8, 9, 10, 12, 14, 20, 40, 80, 150, 300)]
    texts = base + [prose(rng, rng.randrange(20, 120)) for _ in range(30)]
    texts += [edited(rng, t, s) for t in base[4:] for s in (0.005, 0.01, 0.02, 0.04) for _ in range(3)]
    texts += [base[9]] * 12 + [base[2]] * 4 + [" ".join(t.split(" ")[:-1]) for t in base[1:9]] + [" ".join(t.split(" ") + ["z"]) for t in base[1:9]]
    shared = prose(rng, 70)
    texts += [prose(rng, 60) + "\n" + shared + "\n" + prose(rng, 60) for _ in range(8)] + [prose(rng, 30) + " " + edited(rng, shared, 0.01) + " " + prose(rng, 40) for _ in range(6)]
    line = prose(rng, 25)
    texts += [prose(rng, 30) + "\n" + (line if i % 2 else edited(rng, line, 0.02)) + "\n" + prose(rng, 20) + "\n\n" for i in range(10)]
    texts += [None, None, "", "   \n\t ", "one", "One", "ONE\n", "Größe ÉTÉ été", "a b c d e", "A B C D E", "a b c d e f"]
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus as a table with the columns of documents and others that clash with inner names."""
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", 2.0, None) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int, tok string, score double, span int").repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
