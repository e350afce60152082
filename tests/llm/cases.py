"""Small documents with the awkward cases, and frames made of them."""

import random

SF = "/root/testdata/sf0.001"


def awkward() -> list[tuple]:
    rnd = random.Random(7)
    vocab = ["the", "of", "Änd", "in", "zebra", "x1", "foo-bar", "ñandú", "日本", "a", "b9", "Qu"]
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(5, 90))) for _ in range(12)]
    rows = []
    for i in range(40):
        text = rnd.choice(base)
        if i % 3 == 0:
            words = text.split(" ")
            words[rnd.randrange(len(words))] = f"w{i}"
            text = " ".join(words)
        if i % 5 == 0:
            text = text + "\n\t " + rnd.choice(base)
        rows.append((i, text))
    rows += [(40, None), (41, ""), (42, "   \n\t"), (43, "one"), (44, base[0]), (44, base[0]), (45, base[0] * 40), (None, base[1]), (46, "ab" * 400), (47, "ab" * 400), (48, "tok   en \x1f\x85 \U0001f600 <|endoftext|>"), (49, " ".join(f"u{j}" for j in range(3000)))]
    return [(i, t, ("en", "fr", None)[k % 3], "src", len(t or "")) for k, (i, t) in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None):
    """The rows in several partitions, with columns whose names operators use inside."""
    df = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
    return df.selectExpr("*", "1 AS part", "'x' AS key", "0 AS row", "2 AS bucket", "'y' AS blob", "3 AS grp").repartition(3)
