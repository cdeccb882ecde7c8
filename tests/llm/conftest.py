from __future__ import annotations

import random

import pytest

WORDS = [a + b + c for a in ("ba", "ke", "lo", "mi") for b in ("ra", "tu", "zen") for c in ("", "x", "dor", "ly")]


@pytest.fixture(scope="session")
def texts():
    """Invented prose with exact and near copies, shared passages, and the odd cases every operator has to stand."""
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    base, passage = [prose(rng.randrange(5, 200)) for _ in range(40)], prose(70)
    found = list(base)
    for t in base[:12]:
        w = t.split()
        for share in (0.02, 0.05, 0.2):
            found.append(" ".join(rng.choice(WORDS) if rng.random() < share else x for x in w))
        found.append(t)
    found += [f"{prose(30)} {passage} {prose(20)}" for _ in range(6)]
    found += [None, "", "", " \n\t ", "one", "one two three four five", "ONE Two three", "é ü ß ñ", "a" * 3000, "na " * 600, "na " * 600, prose(9000), "\x00\x01 null", "<|endoftext|> text"]
    return found


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with a repeated row, a null id and extra columns of names that operators add."""
    rows = [(k, t, "en", f"s{k % 3}", "mine", 1.5, 7) for k, t in enumerate(texts)]
    rows += [rows[3], (None, texts[4], None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, spans string, score double, row int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
