import random

import pytest
from hypothesis import settings

settings.register_profile("llm", deadline=None, max_examples=40)
settings.load_profile("llm")

SYLLABLES = "ing the er on at re th sh ou en st nd ha to or an".split()


def words(draw, n):
    return ["".join(draw.choices(SYLLABLES, k=draw.randint(1, 4))) for _ in range(n)]


def sentences(draw, n):
    w = words(draw, n)
    return " ".join(x + ("." if i % 9 == 8 else "") for i, x in enumerate(w)).capitalize()


@pytest.fixture(scope="session")
def rows():
    """doc_id, text, lang, source, n_chars: copies, near copies, shared passages, nulls, empty and long texts, ties, repeated rows."""
    draw = random.Random(5)
    texts = [sentences(draw, draw.randint(30, 300)) for _ in range(40)]
    base = texts[0].split()
    for i in range(6):  # near copies of one text
        copy = list(base)
        for k in draw.sample(range(len(copy)), 1 + i):
            copy[k] = "other" + str(i)
        texts.append(" ".join(copy))
    passage = sentences(draw, 60)
    texts += [sentences(draw, 40) + "\n" + passage + "\n" + sentences(draw, 20) for _ in range(5)]
    texts += [texts[3], texts[3], texts[3].upper(), texts[4].replace(" ", "\n")]
    texts += [None, "", "   \n\t ", "one", "one", "Two words", "three small words", "a b c d", "x" * 5000, "naïve café ŒUVRE 日本語 text here ﬁn", " ".join(words(draw, 20_000)), "ab " * 3000, "before <|endoftext|> after"]
    out = [(i, t, "en", None if i % 11 == 5 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    out += [(None, texts[1], "en", "s0", 1), (None, None, None, None, None)]  # null ids
    out += [out[2], out[2]]  # repeated rows
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, with extra columns whose names clash with those the operators use inside."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in ("size", "component", "k1", "k2", "fold", "x", "score", "kept", "block", "target", "b1", "own", "part", "rank", "keys", "words", "label"):
        df = df.selectExpr("*", f"'clash' AS {c}")
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
