import random

import pytest


@pytest.fixture(scope="session")
def corpus_rows():
    """A small corpus with shared passages, copies, near copies, ties, nulls, empty, short and repetitive texts."""
    r = random.Random(7)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passages = [say(n) for n in (20, 25, 60, 19, 45)]
    rows = []
    for i in range(120):
        parts = [say(r.randint(0, 50))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(passages), say(r.randint(0, 30))]
        rows.append((i, r.choice([" ", "\n", "\t "]).join(parts)))
    base = say(150)
    for i in range(120, 150):
        words = base.split()
        words[r.randrange(150)] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(i, rows[3][1]) for i in range(150, 160)]
    rows += [(160, None), (161, ""), (162, "   \n\t"), (163, "one"), (164, "one"), (165, "la " * 300), (166, "la " * 40), (167, (passages[2] + " ") * 4), (168, say(8000)), (169, "A" * 5000)]
    rows.append(rows[5])  # a repeated row
    rows.append((None, passages[4]))
    r.shuffle(rows)
    return rows
