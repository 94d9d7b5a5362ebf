"""Documents of every awkward kind, with extra columns whose names the operators use too."""

import random

import pytest

EXTRA = ["n_words", "kept", "digest", "row", "node", "_md5", "size", "spans", "label", "shard"]


def _prose(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(n))


def edge_documents():
    rng = random.Random(5)
    base = _prose(rng, 400).split()
    docs = [(1, ""), (2, None), (None, _prose(rng, 90)), (None, None), (3, "x"), (4, " \n\t\r\x0b "),
            (5, "A b c"), (6, "a B C"), (7, "one two three four five"), (8, "word " * 3000),
            (9, _prose(rng, 20000)), (10, "é ü z ́x 中文\x1c\x00y"),
            (11, "same line of text with quite a few words here\n" * 3), (12, "z" * 30000),
            (13, "Mail a.b@c.de_d@e.fg or +1 (555) 010-9999, 1.2.3.4.5.6.7.8 or 256.1.1.1; "
                 "4111 1111 1111 1111, 4111-1111-1111-1112 and 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8"),
            (14, "password=abc12345 token = \"0cab398dc11d1a2a11dc6572c8df8bd228c864f3\" 078-05-1120"),
            (15, "+" + "(" * 2000 + "0" * 40 + "@@a@" + "." * 50), (16, "1" * 5000),
            (17, "0001.002.03.255 x@y.z. +12345678 +1234567 +1234567890123456")]
    for i in range(12):                       # near copies at many distances, and exact ones
        words = list(base)
        for _ in range(6 * i):
            words[rng.randrange(len(words))] = _prose(rng, 1)
        docs.append((100 + i, " ".join(words)))
        docs.append((200 + i, " ".join(words).upper() if i % 2 else " ".join(words)))
    for i in range(20):                       # short ones that differ a little
        docs.append((300 + i, " ".join(base[i % 5:12 + i % 7 + i // 5])))
    docs += [docs[19], docs[19], docs[0], docs[1], docs[2], docs[24]]
    docs += [(100, "another text of the same id " * 4)]
    shared = _prose(rng, 60)
    docs += [(400 + i, _prose(rng, 70) + "\n" + shared + "\n" + _prose(rng, 12)) for i in range(6)]
    return docs


@pytest.fixture(scope="session")
def edge_rows():
    return edge_documents()


def frame(spark, rows, kind="doc_id long, text string", extra=True):
    more = ", ".join(f"{c} string" for c in EXTRA) if extra else ""
    full = [(*r, *["?"] * len(EXTRA)) if extra else r for r in rows]
    return spark.createDataFrame(full, kind + (", " + more if extra else "")).repartition(3)


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return frame(spark, edge_rows)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
