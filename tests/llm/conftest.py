"""A small corpus with every odd case that the operators must bear."""

import random

import pytest
from made_up import SYLLABLES, sentence

@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars) rows: plain, copies, near copies, nulls, blanks, long, repeated rows."""
    rng = random.Random(17)
    rows = []
    for i in range(120):
        lang = rng.choice(list(SYLLABLES))
        text = "\n".join(sentence(rng, lang, rng.randint(8, 30)) for _ in range(rng.randint(1, 4)))
        rows.append((i, text, lang, f"src{i % 3}", len(text)))
    base = rows[3][1].replace("\n", " ") + " " + sentence(rng, "en", 60)
    words = base.split(" ")
    rows += [(200 + i, base, "en", "src0", len(base)) for i in range(5)]
    for i in range(6):
        near = list(words)
        near[5 * i] = f"changed{i}"
        rows.append((210 + i, " ".join(near), "en", "src0", 1))
    boiler = "All rights reserved by the owner of this page"
    for i in range(8):
        rows.append((230 + i, f"{sentence(rng, 'en', 12)}\n{boiler}\nPage {i} of 90 in this long document here", "en", "src1", 1))
    rows += [(300, None, "en", "src0", None), (301, "", "de", None, 0), (302, " \n\t ", None, "src2", 4), (303, "1234 5678 !!", "en", "src0", 12), (304, "word", "en", "src0", 4)]
    rows += [(305, sentence(rng, "en", 20000), "en", "src0", 1), (None, "no id here at all", "en", "src0", 1), (306, "twice the same row of text", "en", "src0", 1), (306, "twice the same row of text", "en", "src0", 1)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
