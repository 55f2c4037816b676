"""Small tables with awkward rows."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_docs():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rnd = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "ünï", "λόγος", "语言"]
    text = lambda n: " ".join(rnd.choice(words) + str(rnd.randrange(99)) for _ in range(n))
    long = text(30_000)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, long, "fr", None, len(long)), (4, long, None, "a", len(long)),
        (5, " \t\n", "en", "b", 3), (6, "one", "en", "b", 3), (6, "one", "en", "b", 3), (None, "no id here", None, None, None), (None, None, None, None, None),
        (7, "x" * 5000, "de", "c", 5000), (8, "😀 emoji nbsp em", "es", "ü", 10),
    ]
    base = text(200)
    rows += [(10 + i, base, "en", "hot", len(base)) for i in range(30)]
    for i in range(30):
        w = base.split(" ")
        w[rnd.randrange(200)] = f"edit{i}"
        rows.append((100 + i, " ".join(w), "en", "hot", 0))
    rows += [(200 + i, text(rnd.randrange(1, 300)), rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", "c", None]), 1) for i in range(60)]
    return rows


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def saved(spark, tmp_path, rows, schema=SCHEMA, name="documents"):
    frame(spark, rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
