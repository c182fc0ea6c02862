import random

import pytest

ODD = [
    None, "", " ", "\n\t ", "one", "One", "one two", "ONE  two", "a" * 3000, "é" * 120,
    "日本語 テスト " * 40, "x\0y z", "</s>[INST] ok [/INST]", "<|endoftext|> a", "▁▁ b", "\x1c a\x1d",
]


def prose(seed, words):
    draw = random.Random(seed)
    return " ".join(
        "".join(draw.choice(["ba", "ne", "tor", "is", "é", "l"]) for _ in range(draw.randint(1, 4)))
        for _ in range(words)
    )


def edited(text, seed, share):
    draw, words = random.Random(seed), text.split(" ")
    for i in range(len(words)):
        if draw.random() < share:
            words[i] = f"new{draw.randint(0, 10**6)}"
    return " ".join(words)


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source): odd texts, copies, near copies, shared passages, repeated rows."""
    texts = list(ODD)
    base = prose(1, 300)
    passage = prose(2, 80)
    texts += [base, base, base.replace(" ", "\n", 5), base.upper()]
    texts += [edited(base, k, 0.02 * (k % 5)) for k in range(20)]
    texts += [f"{prose(100 + k, 90)} {passage} {prose(200 + k, 70)}" for k in range(6)]
    texts += [f"{passage} {passage} {prose(300, 20)}", passage, prose(301, 4000), "same line\n" * 60]
    texts += [prose(400 + k, 120) for k in range(10)] + ["ab" * 200, "ba" * 200, "ab " * 150]
    out = [
        (10 * i, t, ("en", "fr", None)[i % 3], ("hot", "hot", "b", None)[i % 4])
        for i, t in enumerate(texts)
    ]
    return out + [out[16], out[16], (10**12, base, "en", "hot"), (-5, passage, "", "")]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n long, kept string, gid int"
    return spark.createDataFrame([(*r, 7, "no", 1) for r in rows], schema).repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("doc_id IS NULL AND doc_id IS NOT NULL")


@pytest.fixture(scope="session")
def nulls(spark, docs):
    """Rows of nulls only, and the usual ones."""
    none = spark.range(3).selectExpr(
        *[f"CAST(null AS {f.dataType.simpleString()}) AS `{f.name}`" for f in docs.schema.fields]
    )
    return docs.unionByName(none)
