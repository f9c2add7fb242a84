import random

import pytest

WORDS = "the of and to in la les der die und tion ent ation ing ous café naïve straße ñandú".split()


def prose(rng, n):
    words = [rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choices("abcdefghiklmnoprstuv", k=rng.randrange(2, 9))) for _ in range(n)]
    return " ".join(w + (".\n" if rng.random() < 0.05 else "") for w in words)


#: Nulls, blanks, ties, repeats and odd characters that every operator must take.
EDGES = [None, "", " ", "\n\n", "one", "\x00", "a b c d e", "A B C D E", "word " * 200, "é" * 60, "x" * 5000, "▁ ▁▁ \t\x0b", "日本語 " * 20, "😀" * 30]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): prose, copies, near copies, shared passages, edge cases, one very long text."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(5, 120)) for _ in range(60)]
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(5)]
    texts += [texts[3]] * 4
    for _ in range(12):
        words = texts[5].split(" ") * 2
        words[rng.randrange(len(words))] = "edited"
        texts.append(" ".join(words))
    texts += EDGES + [prose(rng, 20_000)]
    rng.shuffle(texts)
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", "src2", None])) for i, t in enumerate(texts)]
    return rows + [(None, "no id at all " * 10, "en", "src1"), (None, None, None, None), rows[0], rows[0]]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names operators use for themselves."""
    rows = [(*r, len(r[1] or ""), 1.0, "x", [1]) for r in corpus]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, words array<int>"
    return spark.createDataFrame(rows, schema).repartition(3)


def by_row(rows, *keys):
    return sorted(tuple(r[k] for k in keys) for r in rows if r["doc_id"] is not None)
